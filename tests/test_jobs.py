import pytest
from pyspark.sql import functions as F

from codeloom.operators import projects as P
from codeloom.operators import stats as S
from codeloom.operators.refine import refine_dataset
from codeloom.plans import extraction
from codeloom.plans.inputs import RULES, c_sources, table
from codeloom.session import scratch_path
from codeloom.streaming import buckets as B
from codeloom.streaming import scan
from compare import rows


@pytest.mark.parametrize("n", [1, 2, 3, 10, 11, 997])
def test_percentiles(spark, n):
    import numpy as np
    values = [float((i * 37) % 101) / 4 for i in range(n)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert np.allclose(list(S.exact_percentiles(df, "x").first()), np.percentile(values, [25, 50, 75]))


@pytest.mark.parametrize("most", [1, 7, 300])
def test_percentiles_rank_no_more_than_a_bound(spark, monkeypatch, most):
    """Continuous values, heavy ties, and bounds that tie: narrowed until few are left."""
    import numpy as np
    rnd = np.random.default_rng(4)
    for values in (rnd.normal(size=3000), np.repeat([1.0, 2.0], [1500, 1501]), np.r_[np.zeros(1000), rnd.normal(size=500), np.full(900, 3.0)],
                   np.repeat(rnd.normal(size=5), 400)):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "x double").repartition(3)
        probs = (0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0)
        got = S.exact_percentiles(df, "x", probs, most=most).first()
        assert np.allclose(list(got), np.percentile(values, [100 * p for p in probs]))


def test_percentile_brackets_end_small(spark):
    import numpy as np
    values = np.random.default_rng(6).normal(size=20_000)
    df = spark.createDataFrame([(float(v),) for v in values], "x double").cache()
    wide = {9_999: S._Bracket(float(values.min()), float(values.max()), 0, len(values))}
    for _ in range(2):
        wide = S._narrowed(df, wide)
    assert wide[9_999].inside < 100 and wide[9_999].low <= np.sort(values)[9_999] <= wide[9_999].high
    empty = S.exact_percentiles(df.filter("x > 100"), "x").first()
    assert list(empty) == [None] * 3


def test_incremental_extraction(spark, sf):
    sources = c_sources(spark, sf).drop("doc_id").limit(20).cache()
    first = extraction.save_extraction(extraction.run_extraction(sources, RULES), scratch_path(spark, "ext"))
    assert first.projects.filter("status <> 'Complete'").count() == 0
    again = extraction.run_extraction(sources, RULES, projects=first.projects)
    assert again.statements.count() == 0 and again.functions.count() == 0
    todo = first.projects.withColumn("status", F.lit(P.NOT_STARTED))
    rest = extraction.run_extraction(sources, RULES, projects=todo, scanned=first.scanned)
    assert rest.functions.count() == 0 and rest.scanned.count() == 20


def test_saving_a_run_with_nothing_to_do_keeps_the_tables(spark, sf):
    sources, root = c_sources(spark, sf).drop("doc_id").limit(20).cache(), scratch_path(spark, "kept")
    first = extraction.save_extraction(extraction.run_extraction(sources, RULES), root)
    want = [sorted(map(str, t.collect())) for t in first]
    again = extraction.save_extraction(
        extraction.run_extraction(sources, RULES, projects=first.projects, scanned=first.scanned), root)
    assert [sorted(map(str, t.select(*f.columns).collect())) for t, f in zip(again, first)] == want
    assert first.statements.count() > 0 and first.functions.count() > 0


def test_stream_takes_new_files_only(spark, tmp_path):
    inbox, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    one = lambda name: spark.createDataFrame([(name, "call tag_1(x);")], "path string, text string")

    def run():
        files = spark.readStream.schema("path string, text string").parquet(inbox)
        scan.stream_scan(files, RULES, out, state).awaitTermination()
        return sorted(r.file for r in spark.read.parquet(out).collect())

    one("a.c").write.mode("append").parquet(inbox)
    assert run() == ["a.c"]
    one("b.c").write.mode("append").parquet(inbox)
    assert run() == ["a.c", "b.c"]
    assert run() == ["a.c", "b.c"]


PARTS = [[("x", "Benign", 1), ("y", "Benign", 2)], [("x", "CWE-1", 3)], [("x", "Benign", 4), ("z", "-", 5), ("z", "Benign", 6)]]
SCHEMA = "code string, cwe string, id int"


def test_stream_refine_equals_batch(spark, tmp_path):
    inbox, refined, state = (str(tmp_path / x) for x in ("in", "refined", "state"))
    for part in PARTS:
        spark.createDataFrame(part, SCHEMA).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(inbox)
        scan.stream_refine(stream, refined, state, order=["id"], buckets=4).awaitTermination()
    batch = refine_dataset(spark.createDataFrame(sum(PARTS, []), SCHEMA), ["id"])
    assert rows(B.read_buckets(spark, refined).select("code", "cwe", "id")) == rows(batch.select("code", "cwe", "id"))


def _merged(fresh, old):
    return refine_dataset(fresh if old is None else old.unionByName(fresh), ["id"])


def test_a_batch_rewrites_its_buckets_only(spark, tmp_path):
    root = str(tmp_path / "t")
    many = spark.range(300).select(F.concat(F.lit("k"), "id").alias("code"), F.lit("Benign").alias("cwe"), F.col("id").cast("int").alias("id"))
    B.update_buckets(many, root, 0, "code", _merged, buckets=32)
    one = spark.createDataFrame([("k7", "CWE-1", 999)], SCHEMA)
    B.update_buckets(one, root, 1, "code", _merged, buckets=32)
    assert len(B._folders(spark, f"{root}/batch=1", "_bucket")) == 1
    newest = B.newest_buckets(spark, root)
    assert len(newest) == 32 and sum("batch=1/" in p for p in newest.values()) == 1
    assert spark.read.parquet(f"{root}/batch=1").count() < 60
    want = {(f"k{i}", "Benign") for i in range(300)} - {("k7", "Benign")} | {("k7", "CWE-1")}
    assert {(r.code, r.cwe) for r in B.read_buckets(spark, root).collect()} == want


def test_a_repeated_batch_starts_from_the_same_state(spark, tmp_path):
    """A batch that ran half, or whole, and runs again leaves one copy; one that never ended is not seen."""
    root = str(tmp_path / "t")
    frames = [spark.createDataFrame(p, SCHEMA) for p in PARTS]
    B.update_buckets(frames[0], root, 0, "code", _merged, buckets=2)
    for _ in range(2):
        B.update_buckets(frames[1], root, 1, "code", _merged, buckets=2)
    half = tmp_path / "t" / "batch=2" / "_bucket=0"
    half.mkdir(parents=True)
    (half / "part-0.parquet").write_bytes(b"not finished")
    assert {(r.code, r.cwe) for r in B.read_buckets(spark, root).collect()} == {("x", "CWE-1"), ("y", "Benign")}
    B.update_buckets(frames[2], root, 2, "code", _merged, buckets=2)
    want = refine_dataset(spark.createDataFrame(sum(PARTS, []), SCHEMA), ["id"])
    assert rows(B.read_buckets(spark, root).select("code", "cwe", "id")) == rows(want.select("code", "cwe", "id"))


def test_replaced_buckets_are_deleted(spark, tmp_path):
    root = str(tmp_path / "t")
    for number in range(6):
        B.update_buckets(spark.createDataFrame([("x", "CWE-1", number)], SCHEMA), root, number, "code", _merged, buckets=4, keep=2)
    B.update_buckets(spark.createDataFrame([("other", "CWE-1", 1)], SCHEMA), root, 6, "code", _merged, buckets=4, keep=2)
    assert len(B._folders(spark, root, "batch")) <= 4
    assert {(r.code, r.id) for r in B.read_buckets(spark, root).collect()} == {("x", 0), ("other", 1)}


def test_stream_status_reads_projects_not_batches(spark, tmp_path):
    inbox, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    schema = "project string, status string, ts int"
    assert scan.current_status(spark, out).count() == 0
    for ts in range(5):
        spark.createDataFrame([(f"p{ts % 2}", f"s{ts}", ts)], schema).coalesce(1).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(inbox)
        scan.stream_status(stream, out, state, "ts", buckets=2).awaitTermination()
    assert rows(scan.current_status(spark, out)) == [("p0", "s4"), ("p1", "s3")]
    assert len(B.newest_buckets(spark, out)) <= 2


def test_status(spark):
    known = P.register_projects(spark.createDataFrame([("a",), ("b",)], "project string"))
    assert {r.status for r in known.collect()} == {P.NOT_STARTED}
    updates = spark.createDataFrame([("a", P.COMPLETE)], "project string, status string")
    after = P.set_status(known, updates)
    assert [r.project for r in P.filter_todo_projects(after).collect()] == ["b"]
    asked = spark.createDataFrame([("a",), ("q",)], "project string")
    assert rows(P.get_status(asked, after)) == [("a", P.COMPLETE), ("q", P.UNKNOWN)]
