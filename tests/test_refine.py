import pytest
from pyspark.sql import functions as F

from codeloom.operators import refine as R
from codeloom.operators import sampling as S
from codeloom.operators.scale import global_row_number, running_totals
from compare import rows


def test_refine(spark):
    data = [("x", "Benign"), ("x", "CWE-1"), ("x", "CWE-1"), ("x", "CWE-2"), ("y", "Benign"), ("y", "Benign"),
            ("z", "-"), ("z", "Benign")]
    df = spark.createDataFrame(data, "code string, cwe string")
    want = [("x", "CWE-1"), ("x", "CWE-2"), ("y", "Benign"), ("z", "-"), ("z", "Benign")]
    once = R.refine_dataset(df)
    assert rows(once) == want
    assert rows(R.refine_dataset(once)) == want


def test_keep_first_limits_groups_before_the_shuffle(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 999, "hot").otherwise("cold").alias("k"), "id")
    first = R.dedup_keep_first(df, ["k"], ["id"])
    assert rows(first) == [("cold", 999), ("hot", 0)]
    plan = first._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and plan.index("Exchange") < plan.rindex("WindowGroupLimit")


def test_ambiguous_and_clean(spark):
    df = spark.createDataFrame([("p", 0), ("p", 1), ("q", 0)], "code string, label int")
    assert rows(R.drop_ambiguous(df)) == [("q", 0)]
    messy = spark.createDataFrame(
        [("int  a;", 1), ("int\ta;", 1), ("short", 1), ("long  b;", None), ("x = 1;;", 0), ("x =  1;;", 1)],
        "code string, label int")
    clean = R.clean_labelled_rows(messy)
    assert rows(clean) == [("int a;", 1)]
    R.assert_unique(clean, "code")
    with pytest.raises(AssertionError):
        R.assert_unique(messy, "label")


def test_identical(spark):
    a = spark.createDataFrame([("aaaaaa", 1), ("bbbbbb", 0)], "code string, label int")
    same = R.datasets_identical(a, a).first()
    assert (same.same_counts, same.identical) == (True, True)
    b = spark.createDataFrame([("aaaaaa", 1), ("cccccc", 0)], "code string, label int")
    other = R.datasets_identical(a, b).first()
    assert (other.n_left, other.n_right, other.n_merged, other.identical) == (2, 2, 3, False)


def test_split_is_exact(spark):
    for n, test in ((11, 4), (0, 0), (1, 1), (1000, 300)):
        out = S.train_test_split(spark.range(n).toDF("id"), "id")
        counts = {r.split: r["count"] for r in out.groupBy("split").count().collect()}
        assert counts.get("test", 0) == test and counts.get("train", 0) == n - test
        assert out.select("id").distinct().count() == n


def test_benign_sample(spark):
    code = "\n".join(["abcdef  %d\t x" % i for i in range(8)] + ["short"])
    df = spark.createDataFrame([(1, "f", code)], "id int, file string, code string")
    out = S.sample_benign_lines(df, "id").collect()
    assert len(out) == 2
    assert all(r.line == "unknown" and "  " not in r.context and "\t" not in r.context for r in out)


def test_oversample(spark):
    df = spark.createDataFrame([(i, "a" if i < 10 else "b" if i < 13 else "c") for i in range(20)], "id int, y string")
    out = S.oversample_minority(df, "y", "id")
    assert {r.y: r["count"] for r in out.groupBy("y").count().collect()} == {"a": 10, "b": 10, "c": 7}
    assert out.filter("y = 'b'").groupBy("id").count().agg(F.min("count"), F.max("count")).first() == (3, 4)


def test_cap(spark):
    funs = spark.createDataFrame([(i, "f" if i < 30 else "g") for i in range(60)], "id int, file string")
    finds = spark.createDataFrame([("f",)] * 40 + [("g",)] * 5, "file string")
    out = S.cap_functions(funs, finds, "id", max_functions=20, max_findings=30)
    assert {r.file: r["count"] for r in out.groupBy("file").count().collect()} == {"f": 10, "g": 30}


def test_ranks_and_totals(spark):
    df = spark.range(500).select((F.col("id") * 7919 % 1000).alias("v"))
    ranked = global_row_number(df, [F.asc("v")]).orderBy("v").collect()
    assert [r["rank"] for r in ranked] == list(range(1, 501))
    sums = running_totals(df, [F.asc("v")], {"upto": "v"}).orderBy("v").collect()
    total = 0
    for r in sums:
        total += r.v
        assert r.upto == total


def test_refining_dealt_rows_moves_them_no_more(spark):
    data = [(k, c, i) for i, (k, c) in enumerate(
        [("x", "Benign"), ("x", "CWE-1"), ("x", "CWE-1"), (None, "Benign"), (None, "CWE-2"), ("y", None), ("y", "Benign"), ("z", None)] * 3)]
    df = spark.createDataFrame(data, "code string, cwe string, id int")
    dealt = df.withColumn("b", F.pmod(F.xxhash64("code"), F.lit(3))).repartition("b")
    got = R.refine_dataset(dealt, ["id"], within=["b"])
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    by_text = lambda df: sorted(map(str, df.collect()))
    assert by_text(got.drop("b")) == by_text(R.refine_dataset(df, ["id"]))


def test_refining_labelled_rows_moves_them_once(spark):
    data = [(k, c, i) for i, (k, c) in enumerate(
        [("x", "Benign"), ("x", "CWE-1"), ("x", "CWE-1"), (None, "Benign"), (None, "CWE-2"), ("y", "-"), ("y", "Benign"), ("", "Benign")] * 3)]
    df = spark.createDataFrame(data, "code string, cwe string, id int")
    got = R.refine_dataset(df, ["id"], labelled=True)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("Exchange") < plan.rindex("WindowGroupLimit")
    by_text = lambda df: sorted(map(str, df.collect()))
    assert by_text(got) == by_text(R.refine_dataset(df, ["id"])) and len(by_text(got)) == 5
