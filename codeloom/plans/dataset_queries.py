"""Queries for joins, statistics, refinement, sampling, features, training and streams."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import labels as L
from codeloom.functions import text as X
from codeloom.functions.cfunctions import extract_functions
from codeloom.operators import containment, cvematch, embeddings, evaluation, findings, labelling, nearmiss
from codeloom.operators import projects as prj
from codeloom.operators import refine, sampling, stats
from codeloom.operators.tfidf import tfidf
from codeloom.plans import extraction, training
from codeloom.plans.inputs import (
    C_FILES, C_LINES, FN, LATEST, RULES, SHARED, ST, binary_sql, c_sources, labelled_documents,
    lines_sql, project_events, quoted, shared_files, shared_findings, squeeze_sql, statements,
    status_of_event, table, trim_sql)
from codeloom.plans.registry import query
from codeloom.plans.source_queries import CATEGORIES, SAFE_SQL, SEQ_SQL, _categories, c_tokens_sql, simple_sql
from codeloom.session import scratch_path
from codeloom.sources import reports
from codeloom.sources.tables import export_code_label
from codeloom.streaming import scan
from codeloom.streaming.buckets import read_buckets

# --- joins --------------------------------------------------------------------------------------


@query("label_functions", SHARED + f"""
, fs AS (SELECT *, {squeeze_sql("code")} AS body FROM sf_fun),
ff AS (SELECT *, {squeeze_sql("context")} AS norm FROM sf_find),
x AS (SELECT s.file, code, context, cwe, length(context) > 1 AND contains(body, norm) AS hit
      FROM fs s JOIN ff ON s.file = ff.file)
SELECT DISTINCT file, code, CASE WHEN hit THEN context ELSE '' END AS context,
       CASE WHEN hit THEN cwe ELSE 'Benign' END AS cwe FROM x""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return labelling.label_functions(shared_files(spark, sf), shared_findings(spark, sf))


@query("match_passages", f"""
SELECT DISTINCT doc_id, item_id FROM documents d, benchmark b
WHERE length(b.text) > 1 AND contains({squeeze_sql("d.text")}, {squeeze_sql("b.text")})""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    passages = table(spark, sf, "benchmark").select("item_id", F.col("text").alias("passage"))
    return containment.match_passages(
        table(spark, sf, "documents"), passages, "doc_id", "text", "item_id", "passage")


# Names of three lengths, cut from the statements, that descriptions may contain.
_NAMES_SQL = """names AS (SELECT DISTINCT 'git/' || CASE doc_id % 3 WHEN 0 THEN left(context, 4)
  WHEN 1 THEN left(context, 9) ELSE left(context, 14) || '+' END AS project FROM st WHERE length(context) >= 14
  AND NOT contains(context, '/'))"""


@query("projects_in_cve", ST + f""", {_NAMES_SQL}
SELECT project, EXISTS (SELECT 1 FROM documents d WHERE contains(lower(d.text), lower(project[5:]))) AS in_cve FROM names""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    s = statements(spark, sf).filter((F.length("context") >= 14) & ~F.contains("context", F.lit("/")))
    kind = F.col("doc_id") % 3
    name = F.when(kind == 0, F.left("context", F.lit(4))).when(kind == 1, F.left("context", F.lit(9))).otherwise(
        F.concat(F.left("context", F.lit(14)), F.lit("+")))
    return cvematch.projects_in_cve(
        table(spark, sf, "documents").select("doc_id", F.col("text").alias("description")),
        s.select(F.concat(F.lit("git/"), name).alias("project")), record_id="doc_id")


@query("projects_in_cve_regex", """
SELECT DISTINCT 'nation/' || n_name AS project,
  EXISTS (SELECT 1 FROM documents d WHERE regexp_matches(lower(d.text), lower(n_name))) AS in_cve FROM nation""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return cvematch.projects_in_cve(
        table(spark, sf, "documents").select("doc_id", F.col("text").alias("description")),
        table(spark, sf, "nation").select(F.concat(F.lit("nation/"), "n_name").alias("project")),
        record_id="doc_id", regex=True)


_COUNTS_SQL = f"""sc AS (SELECT project, {binary_sql("cwe")} AS cwe, count(*) AS n FROM st GROUP BY ALL),
fc AS (SELECT project, {binary_sql("cwe")} AS cwe, count(*) AS n FROM fn GROUP BY ALL)"""


@query("join_distribution", ST + f""", {_COUNTS_SQL}
SELECT sc.project, sc.cwe, sc.n AS statements, fc.n AS functions FROM sc JOIN fc
ON sc.project = fc.project AND sc.cwe = fc.cwe""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return stats.join_distribution(
        stats.project_label_counts(statements(spark, sf)), stats.project_label_counts(labelled_documents(spark, sf)))


@query("rank_align", ST + """,
s AS (SELECT row_number() OVER (ORDER BY n DESC, cwe) AS rank, cwe, n FROM (SELECT cwe, count(*) AS n FROM st GROUP BY 1)),
f AS (SELECT row_number() OVER (ORDER BY n DESC, cwe) AS rank, cwe, n FROM (SELECT project AS cwe, count(*) AS n FROM fn GROUP BY 1))
SELECT coalesce(s.rank, f.rank) AS rank, s.cwe AS statement_cwe, s.n AS statements, f.cwe AS function_cwe, f.n AS functions
FROM (SELECT * FROM s WHERE rank <= 10) s FULL JOIN (SELECT * FROM f WHERE rank <= 10) f ON s.rank = f.rank""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return stats.rank_align(
        statements(spark, sf), labelled_documents(spark, sf).select(F.col("project").alias("cwe")))


def _vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.explode(X.simple_tokens(F.col("text"))).alias("token"))


VOCAB = f"""WITH tok AS (SELECT doc_id, UNNEST({simple_sql("text")}) AS token FROM documents),
voc AS (SELECT token, count(*) AS n FROM tok GROUP BY token)
"""


@query("lookup_embeddings", VOCAB.replace("tok AS", "tok AS MATERIALIZED").replace("voc AS", "voc AS MATERIALIZED") + """,
ix AS MATERIALIZED (SELECT token, row_number() OVER (ORDER BY n DESC, token) - 1 AS idx FROM voc),
vec AS MATERIALIZED (SELECT i.token, embedding FROM embeddings e JOIN ix i ON e.vec_id * 2 = i.idx)
SELECT ix.idx, ix.token, round(coalesce(CAST(v.embedding[1] AS DOUBLE), 0), 6) AS first,
       round(coalesce(CAST(v.embedding[64] AS DOUBLE), 0), 6) AS last, CAST(64 AS BIGINT) AS dim
FROM ix LEFT JOIN vec v ON ix.token = v.token""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    index = embeddings.word_index(_vocabulary(spark, sf))
    known = table(spark, sf, "embeddings").select((F.col("vec_id") * 2).alias("idx"), "embedding")
    vectors = index.join(known, "idx").select("token", F.col("embedding").alias("vector"))
    found = embeddings.lookup_embeddings(index, vectors, num_words=1_000_000, dim=64)
    at = lambda i: F.round(F.element_at("vector", i), 6)
    return found.select("idx", "token", at(1).alias("first"), at(64).alias("last"),
                        F.size("vector").cast("bigint").alias("dim"))


# --- counts and distributions -------------------------------------------------------------------

_CATEGORY_COUNTS = CATEGORIES + """, cc AS (
  SELECT CASE WHEN category = name OR name = '-' THEN category ELSE name END AS category, cwe, n AS count
  FROM (SELECT category, name, cwe, count(*) AS n FROM cat WHERE category IS NOT NULL GROUP BY ALL))
"""


@query("category_cwe_counts", _CATEGORY_COUNTS + "SELECT * FROM cc")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return stats.category_cwe_counts(_categories(spark, sf))


@query("category_cwe_rollup", _CATEGORY_COUNTS + """
SELECT category, cwe, sum(count)::BIGINT AS count, CAST(grouping(category, cwe) AS BIGINT) AS level
FROM cc GROUP BY ROLLUP (category, cwe)""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return stats.category_cwe_rollup(stats.category_cwe_counts(_categories(spark, sf)))


@query("top_k", _CATEGORY_COUNTS + """
SELECT category, cwe, sum(count)::BIGINT AS count FROM cc GROUP BY ALL ORDER BY 3 DESC, 1, 2 LIMIT 10""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    counts = stats.category_cwe_counts(_categories(spark, sf)).groupBy("category", "cwe").agg(
        F.sum("count").alias("count"))
    return stats.top_k(counts, "count", 10, ["category", "cwe"])


@query("project_label_counts", ST + f"""
SELECT project, {binary_sql("cwe")} AS cwe, count(*) AS count FROM st GROUP BY ALL""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return stats.project_label_counts(statements(spark, sf))


_PIVOT = """SELECT project, sum(CASE WHEN cwe = 'Benign' THEN 1 END)::BIGINT AS "Benign",
  sum(CASE WHEN cwe <> 'Benign' THEN 1 END)::BIGINT AS "Vulnerable" FROM st GROUP BY project"""


@query("project_label_pivot", ST + _PIVOT)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return stats.project_label_pivot(stats.project_label_counts(statements(spark, sf)))


@query("append_total", ST + f""", p AS ({_PIVOT})
SELECT * FROM p UNION ALL SELECT 'TOTAL', sum("Benign")::BIGINT, sum("Vulnerable")::BIGINT FROM p""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return stats.append_total(stats.project_label_pivot(stats.project_label_counts(statements(spark, sf))))


@query("label_counts", ST + "SELECT cwe AS label, count(*) AS n FROM st GROUP BY cwe")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return stats.label_counts(export_code_label(statements(spark, sf)))


@query("class_count", ST + "SELECT count(DISTINCT cwe) AS n_classes FROM st")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return stats.class_count(statements(spark, sf), "cwe")


@query("benign_vulnerable_counts", ST + """
SELECT count(*) FILTER (cwe = 'Benign') AS benign, count(*) FILTER (cwe <> 'Benign') AS vulnerable FROM st""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return stats.benign_vulnerable_counts(statements(spark, sf))


@query("table_shape", ST + "SELECT count(*) AS n_rows, CAST(7 AS BIGINT) AS n_columns FROM st")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return stats.table_shape(statements(spark, sf))


@query("table_shape_of_project", FN + """
SELECT count(*) AS n_rows, CAST(6 AS BIGINT) AS n_columns FROM fn WHERE project = 'src3'""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return stats.table_shape(labelled_documents(spark, sf), "src3")


@query("distinct_counts", ST + """
SELECT 'statement' AS granularity, count(*) AS n_rows, count(DISTINCT context) AS n_distinct FROM st
UNION ALL SELECT 'function', count(*), count(DISTINCT code) FROM fn""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    s = stats.distinct_counts(statements(spark, sf), "context").withColumn("granularity", F.lit("statement"))
    f = stats.distinct_counts(labelled_documents(spark, sf), "code").withColumn("granularity", F.lit("function"))
    return s.unionByName(f)


def _describe_sql(source: str, x: str) -> str:
    return f"""SELECT count({x}) AS count, round(avg({x}), 6) AS mean, round(stddev_samp({x}), 6) AS std,
  CAST(min({x}) AS DOUBLE) AS min, CAST(quantile_cont({x}, 0.25) AS DOUBLE) AS p25,
  CAST(quantile_cont({x}, 0.5) AS DOUBLE) AS p50, CAST(quantile_cont({x}, 0.75) AS DOUBLE) AS p75,
  CAST(max({x}) AS DOUBLE) AS max FROM {source}"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in ("mean", "std")})


@query("describe_numeric", _describe_sql("events", "value"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(stats.describe_numeric(table(spark, sf, "events"), "value"))


@query("statement_length_stats", ST + ", n AS (SELECT length(context) AS x FROM st WHERE length(context) BETWEEN 11 AND 150) "
       + _describe_sql("n", "x"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    lengths = statements(spark, sf).filter(X.in_length_band(F.col("context"))).select(F.length("context").alias("x"))
    return _rounded(stats.describe_numeric(lengths, "x", derived=True))


_TOKEN_COUNTS = f"WITH n AS (SELECT len({simple_sql('text')}) AS x FROM documents) "


def _token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.size(X.simple_tokens(F.col("text"))).alias("x"))


@query("token_count_stats", _TOKEN_COUNTS + _describe_sql("n", "x"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(stats.describe_numeric(_token_counts(spark, sf), "x", derived=True))


def _histogram_sql(source: str, x: str) -> str:
    return f"""SELECT CAST(least(floor(({x} - lo) / ((hi - lo) / 20)), 19) AS BIGINT) AS bin, count(*) AS n
FROM {source}, (SELECT CAST(min({x}) AS DOUBLE) AS lo, CAST(max({x}) AS DOUBLE) AS hi FROM {source}) s GROUP BY 1"""


@query("token_count_histogram", _TOKEN_COUNTS + ", m AS (SELECT x FROM n WHERE x <= 1024) " + _histogram_sql("m", "x"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return stats.histogram(_token_counts(spark, sf).filter("x <= 1024"), "x")


@query("histogram", _histogram_sql("events", "value"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return stats.histogram(table(spark, sf, "events"), "value")


def _feature_sql(c: str) -> str:
    return f"""SELECT '{c}' AS feature, (SELECT count({c}) FROM fn) AS count, (SELECT count(DISTINCT {c}) FROM fn) AS "unique",
  regexp_extract(v, '[^/]*$') AS top, n AS freq
  FROM (SELECT {c} AS v, count(*) AS n FROM fn GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1)"""


@query("describe_categorical", FN + " UNION ALL ".join(_feature_sql(c) for c in ("project", "file", "lang", "cwe")))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return stats.describe_categorical(labelled_documents(spark, sf), ["project", "file", "lang", "cwe"])


@query("min_length", ST + "SELECT min(length(context)) AS min_length FROM st")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return stats.min_length(statements(spark, sf))


@query("top_cwe_by_function", FN + """
SELECT cwe, count(*) AS count FROM fn WHERE cwe <> 'Benign' GROUP BY cwe ORDER BY 2 DESC, 1 LIMIT 10""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return stats.top_cwe_by_function(labelled_documents(spark, sf))


# --- order --------------------------------------------------------------------------------------


@query("sort_desc", FN + "SELECT doc_id, code, cwe FROM fn ORDER BY code DESC, cwe DESC")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return stats.sort_desc(labelled_documents(spark, sf).select("doc_id", "code", "cwe"), "code", "cwe")


@query("limit_rows", "SELECT doc_id, text FROM documents ORDER BY doc_id LIMIT 100")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return stats.limit_rows(table(spark, sf, "documents").select("doc_id", "text"), 100, "doc_id")


@query("sorted_lengths", ST + """
SELECT doc_id, line, length(context) AS length FROM (SELECT * FROM st ORDER BY doc_id, line LIMIT 20)""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    s = statements(spark, sf).withColumn("line", F.col("line").cast("bigint"))
    return stats.sorted_lengths(s, "context", 20, "doc_id", "line")


# --- duplicates and conflicts -------------------------------------------------------------------


@query("dedup_keep_first", ST + """
SELECT context, cwe, doc_id, line FROM st QUALIFY row_number() OVER (PARTITION BY context, cwe ORDER BY doc_id, line) = 1""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    s = statements(spark, sf).select("context", "cwe", "doc_id", F.col("line").cast("bigint").alias("line"))
    return refine.dedup_keep_first(s, ["context", "cwe"], ["doc_id", "line"])


_REFINED = """SELECT {key}, cwe, doc_id, project FROM (
  SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY cwe DESC) AS rn FROM (
    SELECT * FROM {source} QUALIFY row_number() OVER (PARTITION BY {key}, cwe ORDER BY {order}) = 1))
WHERE NOT (rn > 1 AND cwe = 'Benign')"""


@query("refine_dataset", FN + _REFINED.format(key="code", source="fn", order="doc_id"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    f = labelled_documents(spark, sf).select("code", "cwe", "doc_id", "project")
    return refine.refine_dataset(f, ["doc_id"])


@query("refine_statements", ST + _REFINED.format(key="context", source="st", order="doc_id, line"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    s = statements(spark, sf).select("context", "cwe", "doc_id", "line", "project")
    return refine.refine_dataset(s, ["doc_id", "line"]).drop("line")


@query("drop_ambiguous", """
SELECT text AS code, min(source) AS label FROM documents GROUP BY text HAVING count(DISTINCT source) = 1""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return refine.drop_ambiguous(_by_source(spark, sf))


def _by_source(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("text").alias("code"), F.col("source").alias("label"))


@query("assert_unique", "SELECT text, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def _(spark: SparkSession, sf: str) -> DataFrame:
    refine.assert_unique(table(spark, sf, "documents"), "doc_id")
    return refine.duplicated_keys(table(spark, sf, "documents"), "text")


def _clean_sql(where: str) -> str:
    code = squeeze_sql("text", " ")
    return f"""SELECT code, min(source) AS label FROM (SELECT DISTINCT {code} AS code, source FROM documents WHERE {where})
WHERE source IS NOT NULL AND length(code) > 5 GROUP BY code HAVING count(DISTINCT source) = 1"""


@query("clean_labelled_rows", _clean_sql("true"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return refine.clean_labelled_rows(_by_source(spark, sf))


def _two_sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Two datasets that overlap and hold every document: short ones, and English or long ones."""
    d = table(spark, sf, "documents").select(F.col("text").alias("code"), F.col("source").alias("label"), "lang", "n_chars")
    return (d.filter(_LEFT).select("code", "label"), d.filter(_RIGHT).select("code", "label"))


_LEFT, _RIGHT = "n_chars < 2500", "lang = 'en' OR n_chars >= 2500"
_SIDES = f"WITH a AS ({_clean_sql(_LEFT)}), b AS ({_clean_sql(_RIGHT)}), " + \
    "m AS (SELECT code, min(label) AS label FROM (SELECT * FROM a UNION SELECT * FROM b) GROUP BY code HAVING count(DISTINCT label) = 1) "


@query("merge_datasets", _SIDES + "SELECT * FROM m")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return refine.merge_datasets(*_two_sides(spark, sf))


@query("datasets_identical", _SIDES + """
SELECT l.n AS n_left, r.n AS n_right, x.n AS n_merged, x.n = l.n AND x.n = r.n AS same_counts,
  NOT EXISTS (SELECT * FROM a EXCEPT SELECT * FROM b) AND NOT EXISTS (SELECT * FROM b EXCEPT SELECT * FROM a) AS identical
FROM (SELECT count(*) AS n FROM a) l, (SELECT count(*) AS n FROM b) r, (SELECT count(*) AS n FROM m) x""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return refine.datasets_identical(*_two_sides(spark, sf))


@query("difference", f"""
SELECT DISTINCT text AS code FROM documents WHERE {_LEFT} AND text NOT IN (SELECT text FROM documents WHERE {_RIGHT})""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    left, right = _two_sides(spark, sf)
    return refine.difference(left.select("code").distinct(), right, "code")


@query("append_benign", FN + """
SELECT file, cwe, CAST(NULL AS VARCHAR) AS tool, lang AS category FROM fn WHERE cwe <> 'Benign'
UNION ALL SELECT file, cwe, 'sampling', NULL FROM fn WHERE cwe = 'Benign'""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    f = labelled_documents(spark, sf)
    left = findings.vulnerable(f).select("file", "cwe", F.lit(None).cast("string").alias("tool"), F.col("lang").alias("category"))
    right = findings.benign(f).select("file", "cwe", F.lit("sampling").alias("tool"))
    return findings.append_benign(left, right)


# --- samples and splits -------------------------------------------------------------------------


@query("sample_benign_lines", FN + f""", q AS (SELECT doc_id, file, {lines_sql("code")} AS parts FROM fn),
w AS (SELECT doc_id, file, UNNEST(range(len(parts))) AS i, UNNEST(parts) AS s FROM q),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY md5('41:' || doc_id || ':' || i)) AS rn,
             count(*) OVER (PARTITION BY doc_id) AS n FROM w WHERE length(s) > 5)
SELECT doc_id, file, 'unknown' AS line, {trim_sql(squeeze_sql("s", " "))} AS context, 'Benign' AS cwe, 'sampling' AS tool
FROM r WHERE rn <= floor(n * 0.25)""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    f = labelled_documents(spark, sf).select("doc_id", "file", "code", "cwe")
    return sampling.sample_benign_lines(f, "doc_id")


@query("sample_statement_sizes", FN + f""", q AS (SELECT doc_id, UNNEST({lines_sql("code")}) AS s FROM fn),
w AS (SELECT DISTINCT doc_id, length(s) AS size FROM q WHERE length(s) BETWEEN 1 AND 151),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY md5('0:' || doc_id || ':' || size)) AS rn,
             count(*) OVER (PARTITION BY doc_id) AS n FROM w)
SELECT doc_id, size FROM r WHERE rn <= CASE WHEN n > 5 THEN 5 ELSE n - 1 END""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.sample_statement_sizes(
        labelled_documents(spark, sf).select("doc_id", "code"), "doc_id", min_len=1
    ).withColumn("size", F.col("size").cast("bigint"))


@query("cap_functions", """
WITH f AS (SELECT doc_id, source AS file FROM documents), g AS (SELECT 'src' || (user_id % 10) AS file FROM events),
big AS (SELECT file FROM f GROUP BY file HAVING count(*) > 12 INTERSECT SELECT file FROM g GROUP BY file HAVING count(*) > 30)
SELECT doc_id, file FROM f WHERE file NOT IN (SELECT file FROM big)
UNION ALL SELECT doc_id, file FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY md5('20:' || doc_id)) AS rn
  FROM f WHERE file IN (SELECT file FROM big)) WHERE rn <= 10""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    f = table(spark, sf, "documents").select("doc_id", F.col("source").alias("file"))
    g = table(spark, sf, "events").select(F.concat(F.lit("src"), F.col("user_id") % 10).alias("file"))
    return sampling.cap_functions(f, g, "doc_id", max_functions=12, max_findings=30)


@query("train_test_split", """
SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5('30:' || doc_id)) <= ceil((SELECT count(*) FROM documents) * CAST(0.3 AS DOUBLE))
  THEN 'test' ELSE 'train' END AS split FROM documents""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.train_test_split(table(spark, sf, "documents").select("doc_id"), "doc_id")


@query("oversample_minority", FN + """, c AS (SELECT cwe, count(*) AS n FROM fn GROUP BY cwe),
lo AS (SELECT cwe, n FROM c ORDER BY n, cwe LIMIT 1), hi AS (SELECT max(n) AS top FROM c),
r AS (SELECT doc_id, fn.cwe, row_number() OVER (ORDER BY md5('0:' || doc_id)) AS rn, lo.n, hi.top
      FROM fn JOIN lo ON fn.cwe = lo.cwe, hi)
SELECT doc_id, cwe, CAST(UNNEST(range(top // n + CASE WHEN rn <= top % n THEN 1 ELSE 0 END)) AS INTEGER) AS copy FROM r
UNION ALL SELECT doc_id, cwe, 0 FROM fn WHERE cwe NOT IN (SELECT cwe FROM lo)""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.oversample_minority(labelled_documents(spark, sf).select("doc_id", "cwe"), "cwe", "doc_id")


@query("nearmiss_undersample", """
WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
lo AS (SELECT label, count(*) AS n FROM e GROUP BY label ORDER BY n, label LIMIT 1),
d AS (SELECT a.vec_id, a.label, list_distance(a.v, b.v) AS dist FROM e a, e b
      WHERE a.label <> (SELECT label FROM lo) AND b.label = (SELECT label FROM lo)),
k AS (SELECT vec_id, label, dist, row_number() OVER (PARTITION BY vec_id ORDER BY dist) AS rn FROM d),
m AS (SELECT vec_id, label, round(avg(dist), 6) AS dist FROM k WHERE rn <= 3 GROUP BY vec_id, label),
r AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY dist, vec_id) AS rn FROM m)
SELECT vec_id, label FROM r WHERE rn <= (SELECT n FROM lo)
UNION ALL SELECT vec_id, label FROM e WHERE label = (SELECT label FROM lo)""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return nearmiss.nearmiss_undersample(
        table(spark, sf, "embeddings"), "label", "vec_id", "embedding").select("vec_id", "label")


# --- features -----------------------------------------------------------------------------------


@query("index_labels", """
SELECT doc_id, CAST(dense_rank() OVER (ORDER BY source) - 1 AS INTEGER) AS label_index FROM documents""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", F.col("source").alias("label"))
    return embeddings.index_labels(d).select("doc_id", "label_index")


@query("one_hot", """
WITH i AS (SELECT doc_id, dense_rank() OVER (ORDER BY source) - 1 AS ix FROM documents),
k AS (SELECT count(DISTINCT source) AS n FROM documents)
SELECT doc_id, array_to_string(list_transform(range(n), lambda j: CASE WHEN j = ix THEN 1 ELSE 0 END), ',') AS hot,
  CAST(ix AS INTEGER) AS back FROM i, k""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    d = embeddings.index_labels(table(spark, sf, "documents").select("doc_id", F.col("source").alias("label")))
    n = stats.class_count(table(spark, sf, "documents"), "source").scalar()
    return d.withColumn("n", n).select("doc_id", L.one_hot(F.col("label_index"), F.col("n")).alias("v")).select(
        "doc_id", F.array_join("v", ",").alias("hot"), L.argmax(F.col("v")).alias("back"))


@query("decode_labels", """
WITH classes AS (SELECT lang, row_number() OVER (ORDER BY lang) - 1 AS i FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL)),
s AS (SELECT vec_id, embedding[1:4] AS v, embedding[1] AS score FROM embeddings),
t AS (SELECT *, CAST(list_position(v, list_max(v)) - 1 AS INTEGER) AS best FROM s)
SELECT vec_id, best, lang AS decoded, CASE WHEN score > 0.05 THEN 'Vulnerable' ELSE 'Benign' END AS binary
FROM t LEFT JOIN classes ON i = best""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Four scores of a row decoded to a language, and one to a binary label."""
    langs = table(spark, sf, "documents").select(F.col("lang").alias("label")).filter("label IS NOT NULL").distinct()
    binary = spark.createDataFrame([("Benign",), ("Vulnerable",)], "label string")
    e = table(spark, sf, "embeddings").select("vec_id", F.slice("embedding", 1, 4).alias("v"), F.col("embedding")[0].alias("score"))
    e = e.withColumn("best", L.argmax(F.col("v")))
    e = embeddings.decode_labels(e, F.col("best"), embeddings.index_labels(langs))
    return embeddings.decode_labels(
        e, L.threshold_scores(F.col("score"), 0.05), embeddings.index_labels(binary), "binary").select(
        "vec_id", "best", "decoded", "binary")


@query("threshold_scores", "SELECT event_id, CASE WHEN value / 100 > 0.5 THEN 1 ELSE 0 END AS pred FROM events")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", L.threshold_scores(F.col("value") / 100).alias("pred"))


@query("tfidf", f"""
WITH t AS (SELECT doc_id, UNNEST(regexp_extract_all(lower(text), {quoted(X.TFIDF_TOKEN)})) AS term FROM documents),
c AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
v AS (SELECT term, count(*) AS df FROM c GROUP BY term ORDER BY sum(tf) DESC, term LIMIT 3000),
w AS (SELECT doc_id, c.term, tf * (ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + df)) + 1) AS w FROM c JOIN v ON c.term = v.term)
SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM w""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", X.code_tokens_regex(F.col("text")).alias("tokens"))
    return tfidf(d, "doc_id", "tokens").withColumn("weight", F.round("weight", 6))


@query("word_index", VOCAB + "SELECT row_number() OVER (ORDER BY n DESC, token) - 1 AS idx, token, n FROM voc")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return embeddings.word_index(_vocabulary(spark, sf))


MERGES = 60


def _merges_sql() -> str:
    """Tables of the merges, one after the other: words as rows of marked symbols, of whose neighbours the most
    frequent pair is joined at each step."""
    o, c = (quoted(m) for m in embeddings.MARKS)
    tables = [f"""toks AS MATERIALIZED (SELECT doc_id, {c_tokens_sql("text")} AS tokens FROM documents),
w0 AS MATERIALIZED (SELECT word, regexp_replace(word, '(.)', {o} || '\\1' || {c}, 'gs') AS s, n FROM (
  SELECT word, count(*) AS n FROM (SELECT UNNEST(tokens) AS word FROM toks) WHERE length(word) > 0 GROUP BY word))"""]
    for i in range(MERGES):
        tables.append(f"""a{i} AS (SELECT string_split(substr(s, 2, length(s) - 2), {c} || {o}) AS a, n FROM w{i}),
p{i} AS MATERIALIZED (SELECT p[1] AS l, p[2] AS r FROM (SELECT UNNEST(list_zip(a[:-2], a[2:])) AS p, n FROM a{i} WHERE len(a) > 1)
  GROUP BY ALL HAVING sum(n) >= 2 ORDER BY sum(n) DESC, l, r LIMIT 1),
w{i + 1} AS MATERIALIZED (SELECT word, replace(s, {o} || l || {c} || {o} || r || {c}, {o} || l || r || {c}) AS s, n FROM w{i}, p{i})""")
    found = " UNION ALL ".join(f"SELECT {i} AS rank, l, r FROM p{i}" for i in range(MERGES))
    return "WITH " + ",\n".join(tables) + f",\nmerges AS ({found})\n"


def _merges(spark: SparkSession, sf: str):
    words = table(spark, sf, "documents").select(F.explode(X.code_tokens_c(F.col("text"))).alias("word"))
    return embeddings.bpe_train(words, num_merges=MERGES)


@query("bpe_train", _merges_sql() + 'SELECT CAST(rank AS INTEGER) AS rank, l AS "left", r AS "right" FROM merges')
def _(spark: SparkSession, sf: str) -> DataFrame:
    _, merges = _merges(spark, sf)
    return spark.createDataFrame([(i, l, r) for i, (l, r) in enumerate(merges)], "rank int, left string, right string")


@query("bpe_encode", _merges_sql() + f""",
letters AS (SELECT DISTINCT UNNEST(string_split(word, '')) AS token FROM w0),
vocab AS (SELECT token, min(id) AS id FROM (
  SELECT token, 4 + row_number() OVER (ORDER BY token) AS id FROM letters
  UNION ALL SELECT l || r, 5 + (SELECT count(*) FROM letters) + row_number() OVER (ORDER BY rank) - 1 FROM (
    SELECT l, r, rank FROM merges QUALIFY row_number() OVER (PARTITION BY l || r ORDER BY rank) = 1)) GROUP BY token),
pieces AS (SELECT word, string_split(substr(s, 2, length(s) - 2), {quoted(embeddings.MARKS[1] + embeddings.MARKS[0])}) AS parts FROM w{MERGES}),
coded AS (SELECT word, CASE WHEN v.id IS NOT NULL THEN [v.id] ELSE list_transform(parts, lambda p: coalesce(known[p], 3)) END AS ids
  FROM pieces LEFT JOIN vocab v ON v.token = word, (SELECT map(list(token), list(id)) AS known FROM vocab)),
placed AS (SELECT doc_id, UNNEST(tokens[:1022]) AS word, UNNEST(range(len(tokens[:1022]))) AS place FROM toks),
bodies AS (SELECT doc_id, flatten(list(ids ORDER BY place))[:1022] AS ids FROM placed JOIN coded USING (word) GROUP BY doc_id),
every AS (SELECT doc_id, list_concat([0], coalesce(ids, []), [2]) AS ids FROM toks LEFT JOIN bodies USING (doc_id))
SELECT doc_id, array_to_string(list_concat(ids, list_transform(range(1024 - len(ids)), lambda x: 1)), ',') AS ids FROM every""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    vocab, merges = _merges(spark, sf)
    d = table(spark, sf, "documents").select("doc_id", X.code_tokens_c(F.col("text")).alias("tokens"))
    return embeddings.bpe_encode(d, "tokens", vocab, merges, pad_to=1024).select(
        "doc_id", F.array_join("ids", ",").alias("ids"))


@query("word2vec", VOCAB + "SELECT token AS word, CAST(100 AS INTEGER) AS dim, true AS reloads FROM voc WHERE n >= 5")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors as trained, held against the same model saved and loaded."""
    d = table(spark, sf, "documents").select(X.simple_tokens(F.col("text")).alias("tokens"))
    model, path = embeddings.train_word2vec(d, "tokens"), scratch_path(spark, "vectors")
    embeddings.save_word2vec(model, path)
    vectors = lambda m, name: m.getVectors().select("word", vector_to_array("vector").alias(name))
    return vectors(model, "v").join(vectors(embeddings.load_word2vec(path), "again"), "word").select(
        "word", F.size("v").alias("dim"), (F.col("v") == F.col("again")).alias("reloads"))


# --- function extraction ------------------------------------------------------------------------


@query("extract_functions", C_FILES + """
SELECT file, CAST(0 AS INTEGER) AS fn_no, CAST(3 AS INTEGER) AS start_line, main_code AS code FROM c_text
UNION ALL SELECT file, 1, CAST(3 + length(main_code) - length(replace(main_code, chr(10), '')) + 3 AS INTEGER), tag_code FROM c_text""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return extract_functions(c_sources(spark, sf))


EXTRACTED = C_LINES + f""",
both_fun AS (SELECT file, project, main_code AS code FROM c_text UNION ALL SELECT file, project, tag_code FROM c_text),
labelled AS (
  SELECT DISTINCT f.file, f.project, f.code,
    CASE WHEN hit THEN x.cwe ELSE 'Benign' END AS cwe FROM both_fun f
  JOIN (SELECT DISTINCT file, context, cwe FROM c_find) x ON f.file = x.file,
  LATERAL (SELECT length(x.context) > 1 AND contains({squeeze_sql("f.code")}, {squeeze_sql("x.context")}) AS hit)),
kept AS (SELECT file, project, context, cwe FROM c_find WHERE contains(context, ';')),
fl AS (SELECT file, project, code, {lines_sql("code")} AS parts FROM both_fun WHERE file IN (SELECT file FROM kept)),
fw AS (SELECT file, project, code, UNNEST(range(len(parts))) AS i, UNNEST(parts) AS s FROM fl),
fr AS (SELECT *, row_number() OVER (PARTITION BY file, code ORDER BY md5('41:' || md5(file || chr(10) || code) || ':' || i)) AS rn,
              count(*) OVER (PARTITION BY file, code) AS n FROM fw WHERE length(s) > 5),
stmt AS (SELECT file, project, context, cwe FROM kept UNION ALL
         SELECT file, project, {trim_sql(squeeze_sql("s", " "))}, 'Benign' FROM fr WHERE rn <= floor(n * 0.25)),
rf AS (SELECT * FROM (SELECT *, max(cwe) OVER (PARTITION BY code) AS top FROM
         (SELECT * FROM labelled QUALIFY row_number() OVER (PARTITION BY code, cwe ORDER BY project, file) = 1))
       WHERE NOT (cwe = 'Benign' AND top > 'Benign')),
rs AS (SELECT * FROM (SELECT *, max(cwe) OVER (PARTITION BY context) AS top FROM
         (SELECT * FROM stmt QUALIFY row_number() OVER (PARTITION BY context, cwe ORDER BY project, file) = 1))
       WHERE NOT (cwe = 'Benign' AND top > 'Benign'))
"""


@query("run_extraction", EXTRACTED + """
SELECT 'function' AS granularity, project, cwe, count(*) AS n FROM rf GROUP BY ALL
UNION ALL SELECT 'statement', project, cwe, count(*) FROM rs GROUP BY ALL
UNION ALL SELECT 'project', source, 'Complete', 1 FROM (SELECT DISTINCT source FROM documents)""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    out = extraction.run_extraction(c_sources(spark, sf).drop("doc_id"), RULES)
    count = lambda df, name: df.groupBy("project", "cwe").agg(F.count("*").alias("n")).select(
        F.lit(name).alias("granularity"), "project", "cwe", "n")
    return count(out.functions, "function").unionByName(count(out.statements, "statement")).unionByName(
        count(out.projects.withColumnRenamed("status", "cwe"), "project"))


@query("run_extraction_twice", EXTRACTED + """
SELECT 'function' AS granularity, project, cwe, count(*) AS n FROM rf GROUP BY ALL
UNION ALL SELECT 'statement', project, cwe, count(*) FROM rs GROUP BY ALL
UNION ALL SELECT 'file', 'scanned', '', count(*) FROM c_text
UNION ALL SELECT 'project', source, 'Complete', 1 FROM (SELECT DISTINCT source FROM documents)""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """First the sources of English documents, then all that is left; saved below one root."""
    root, sources = scratch_path(spark, "runs"), c_sources(spark, sf)
    english = table(spark, sf, "documents").filter("lang = 'en'").select("doc_id")
    some = sources.join(english, "doc_id", "left_semi").drop("doc_id")
    first = extraction.save_extraction(extraction.run_extraction(some, RULES), root)
    out = extraction.save_extraction(
        extraction.run_extraction(sources.drop("doc_id"), RULES, scanned=first.scanned), root)
    count = lambda df, name: df.groupBy("project", "cwe").agg(F.count("*").alias("n")).select(
        F.lit(name).alias("granularity"), "project", "cwe", "n")
    files = out.scanned.agg(F.count("*").alias("n")).select(
        F.lit("file").alias("granularity"), F.lit("scanned").alias("project"), F.lit("").alias("cwe"), "n")
    return count(out.functions, "function").unionByName(count(out.statements, "statement")).unionByName(
        count(out.projects.withColumnRenamed("status", "cwe"), "project")).unionByName(files)


# The same job with the rules' findings as reports: FlawFinder's with a context, CppCheck's with a line, RATS' without either.
_REPORTED = C_LINES + """, c_rep AS (
  SELECT file, project, line, context, cwe FROM c_find WHERE name <> 'tagged'
  UNION ALL SELECT file, project, line, '-', 'CWE-unknown' FROM c_find WHERE name = 'tagged')""" + EXTRACTED[
    len(C_LINES):].replace("c_find", "c_rep")


@query("extraction_from_reports", _REPORTED + """
SELECT 'function' AS granularity, project, cwe, count(*) AS n FROM rf GROUP BY ALL
UNION ALL SELECT 'statement', project, cwe, count(*) FROM rs GROUP BY ALL
UNION ALL SELECT 'file', 'scanned', '', count(*) FROM c_text
UNION ALL SELECT 'project', source, 'Complete', 1 FROM (SELECT DISTINCT source FROM documents)""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    root, sources = scratch_path(spark, "reports"), c_sources(spark, sf).drop("doc_id")
    found = findings.scan_rules(findings.split_statements(
        sources.select(F.col("path").alias("file"), "project", "text"), first=1), RULES)
    cell = {"File": "file", "Line": "line", "CWEs": "cwe", "Context": "context"}
    found.filter("name = 'article'").select(*[
        F.col(cell[n]).alias(n) if n in cell else F.lit("x").alias(n) for n in reports.FLAWFINDER_CSV.fieldNames()
    ]).write.csv(f"{root}/flawfinder", header=True, quote='"', escape='"', quoteAll=True)
    at = F.struct(F.col("file").alias("_file"), F.col("line").alias("_line"), F.lit("1").alias("_column"))
    found.filter("name = 'ending'").select(
        F.col("name").alias("_id"), F.substring_index("cwe", "-", -1).alias("_cwe"), F.array(at).alias("location"),
    ).write.format("xml").option("rowTag", "error").option("rootTag", "errors").save(f"{root}/cppcheck")
    found.filter("name = 'tagged'").select(
        F.lit("High").alias("severity"), F.array(F.struct(F.col("file").alias("name"), F.array("line").alias("line"))).alias("file"),
    ).write.format("xml").option("rowTag", "vulnerability").option("rootTag", "rats_output").save(f"{root}/rats")
    out = extraction.extraction_from_reports(
        sources, reports.read_flawfinder(spark, f"{root}/flawfinder"), reports.read_cppcheck(spark, f"{root}/cppcheck"),
        reports.read_rats(spark, f"{root}/rats"))
    count = lambda df, name: df.groupBy("project", "cwe").agg(F.count("*").alias("n")).select(
        F.lit(name).alias("granularity"), "project", "cwe", "n")
    files = out.scanned.agg(F.count("*").alias("n")).select(
        F.lit("file").alias("granularity"), F.lit("scanned").alias("project"), F.lit("").alias("cwe"), "n")
    return count(out.functions, "function").unionByName(count(out.statements, "statement")).unionByName(
        count(out.projects.withColumnRenamed("status", "cwe"), "project")).unionByName(files)


# --- training and evaluation --------------------------------------------------------------------


def _scores(spark: SparkSession, sf: str) -> DataFrame:
    """Scores in (0, 1) with ties, and a truth that leans towards high scores."""
    return table(spark, sf, "events").select(
        "event_id", (F.floor("value") / (F.floor("value") + 40)).alias("score"),
        F.when((F.col("value") > 60) | (F.col("event_type") == "error"), 1).otherwise(0).alias("truth"))


SCORES = """WITH sc AS (SELECT event_id, floor(value) / (floor(value) + 40) AS score,
  CASE WHEN value > 60 OR event_type = 'error' THEN 1 ELSE 0 END AS truth FROM events)
"""


@query("evaluate", SCORES + """, p AS (SELECT *, CASE WHEN score > 0.5 THEN 1 ELSE 0 END AS pred,
  least(greatest(score, 1e-7), 1 - 1e-7) AS pr FROM sc),
g AS (SELECT score, sum(truth) AS pos, count(*) - sum(truth) AS neg FROM sc GROUP BY score),
a AS (SELECT pos, neg, sum(neg) OVER (ORDER BY score) AS upto FROM g)
SELECT count(*) AS n, round(avg(CASE WHEN truth = pred THEN 1 ELSE 0 END), 6) AS accuracy,
  round(count(*) FILTER (truth = 1 AND pred = 1) / count(*) FILTER (pred = 1), 6) AS precision,
  round(count(*) FILTER (truth = 1 AND pred = 1) / count(*) FILTER (truth = 1), 6) AS recall,
  round(avg(-CASE WHEN truth = 1 THEN ln(pr) ELSE ln(1 - pr) END), 6) AS loss,
  round((SELECT sum(pos * (upto - neg / 2)) / (sum(pos) * sum(neg)) FROM a), 6) AS auc FROM p""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    out = evaluation.evaluate(_scores(spark, sf), "truth", "score")
    return out.withColumns({c: F.round(c, 6) for c in out.columns if c != "n"})


REPORT = """, pairs AS (SELECT label AS t, CAST(list_position(embedding[1:10], list_max(embedding[1:10])) - 1 AS INTEGER) AS p FROM embeddings),
lab AS (SELECT t AS l FROM pairs UNION SELECT p FROM pairs),
per AS (SELECT l, (SELECT count(*) FROM pairs WHERE t = l) AS support, (SELECT count(*) FROM pairs WHERE p = l) AS predicted,
               (SELECT count(*) FROM pairs WHERE t = l AND p = l) AS hits FROM lab),
m AS (SELECT CAST(l AS VARCHAR) AS row, CASE WHEN predicted > 0 THEN hits / predicted ELSE 0 END AS precision,
             CASE WHEN support > 0 THEN hits / support ELSE 0 END AS recall,
             2 * hits / (support + predicted) AS f1, support, hits FROM per)
"""


def _predicted_classes(spark: SparkSession, sf: str) -> DataFrame:
    """The class of the largest of the first ten coordinates, as a prediction of the label."""
    return table(spark, sf, "embeddings").select(
        F.col("label").alias("t"), L.argmax(F.slice("embedding", 1, 10)).alias("p"))


@query("classification_report", "WITH " + REPORT[2:] + """
SELECT row, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM m
UNION ALL SELECT 'accuracy', round(sum(hits) / sum(support), 6), round(sum(hits) / sum(support), 6), round(sum(hits) / sum(support), 6), sum(support)::BIGINT FROM m
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), sum(support)::BIGINT FROM m
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6),
  round(sum(f1 * support) / sum(support), 6), sum(support)::BIGINT FROM m""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    out = evaluation.classification_report(_predicted_classes(spark, sf), "t", "p")
    return out.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query("label_distribution", "WITH " + REPORT[2:] + """
SELECT CAST(l AS VARCHAR) AS label, support AS actual, predicted FROM per""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.label_distribution(_predicted_classes(spark, sf), "t", "p")


def _training_rows(spark: SparkSession, sf: str) -> DataFrame:
    f = labelled_documents(spark, sf)
    return f.select("doc_id", "code", L.binary_name(F.col("cwe")).alias("label"))


_TRAINING = FN + f""", t AS (SELECT doc_id, {binary_sql("cwe")} AS label FROM fn),
held AS (SELECT * FROM t QUALIFY row_number() OVER (ORDER BY md5('30:' || doc_id)) <= ceil((SELECT count(*) FROM fn) * CAST(0.3 AS DOUBLE)))
"""


@query("train_random_forest", _TRAINING + """
SELECT count(*) AS n, (SELECT count(*) FROM fn) - count(*) AS n_train, true AS learnt FROM held""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Held-out and training rows, and whether the forest is right on the latter more often than naming
    their most frequent label would be."""
    rows = sampling.train_test_split(_training_rows(spark, sf), "doc_id")
    model = training.train_random_forest(rows.filter("split = 'train'"))
    both = training.accuracy(model, rows.filter("split = 'train'")).select(F.struct("*").alias("t")).scalar()
    train = rows.filter("split = 'train'").groupBy("label").agg(F.count("*").alias("c"))
    most = train.agg((F.max("c") / F.sum("c")).alias("share")).scalar()
    return training.accuracy(model, rows.filter("split = 'test'")).withColumn("t", both).select(
        "n", F.col("t.n").alias("n_train"), (F.col("t.accuracy") > most).alias("learnt"))


def _id_rows(spark: SparkSession, sf: str) -> DataFrame:
    return training.process_data(_training_rows(spark, sf), "doc_id")


@query("train_dnn", _TRAINING + "SELECT label, count(*) AS n, true AS of_a_class FROM held GROUP BY label")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Held-out rows of each label, and whether each got one of the two classes."""
    rows = _id_rows(spark, sf)
    model = training.train_dnn(rows.filter("split = 'train'"), "X", "label_index", 2)
    return training.predict_ids(model, rows.filter("split = 'test'"), "X").groupBy("label").agg(
        F.count("*").alias("n"), F.bool_and(F.col("prediction").isin(0.0, 1.0)).alias("of_a_class"))


@query("train_multi_dnn")
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = _id_rows(spark, sf)
    model = training.train_multi_dnn(
        rows.filter("split = 'train'"), "X", "label_index", 2, layers=[40, 30, 20, 10, 5], iterations=5)
    return training.predict_ids(model, rows.filter("split = 'test'"), "X").groupBy("label", "prediction").agg(
        F.count("*").alias("n"))


@query("learning_curve", FN + """, t AS (SELECT doc_id, ('0x' || left(md5('30:' || doc_id), 8))::BIGINT % 4 AS fold,
  ('0x' || left(md5('31:' || doc_id), 8))::BIGINT / 4294967296.0 AS share FROM fn),
steps AS (SELECT CAST(f AS INTEGER) AS fold, fraction FROM range(4) r(f), (SELECT UNNEST([CAST(0.1 AS DOUBLE), 0.325, 0.55, 0.775, 1.0]) AS fraction))
SELECT s.fraction, s.fold, count(*) FILTER (t.fold <> s.fold AND share <= s.fraction) AS n_train,
  count(*) FILTER (t.fold = s.fold) AS n_test, true AS scored FROM steps s, t GROUP BY ALL""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """All five sizes in four folds, with forests of 20 trees."""
    curve = training.learning_curve(_training_rows(spark, sf), "doc_id", folds=4, trees=20, depth=10)
    return curve.select("fraction", "fold", "n_train", "n_test", (
        F.col("train_score").between(0, 1) & F.col("test_score").between(0, 1)).alias("scored"))


@query("vectorize_functions")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """The widths of all rows and vectors, at the vocabulary and sizes that the operator has by itself."""
    out = training.vectorize_functions(c_sources(spark, sf).select("path", F.col("text").alias("code")))
    sizes = out.rows.select(F.lit("rows").alias("part"), F.size("X").alias("width"))
    sizes = sizes.unionByName(out.embeddings.select(F.lit("embeddings").alias("part"), F.size("vector").alias("width")))
    return sizes.groupBy("part", "width").agg(F.count("*").alias("n"))


@query("process_data", FN + f""", x AS (SELECT doc_id, {binary_sql("cwe")} AS label, code FROM fn),
s AS (SELECT *, {SAFE_SQL} AS safe FROM x)
SELECT doc_id, label, CASE WHEN label = 'Benign' THEN 0 ELSE 1 END AS label_index, array_to_string({SEQ_SQL}, ',') AS ids,
  CASE WHEN row_number() OVER (ORDER BY md5('30:' || doc_id)) <= ceil((SELECT count(*) FROM fn) * CAST(0.3 AS DOUBLE)) THEN 'test' ELSE 'train' END AS split
FROM s""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    f = labelled_documents(spark, sf).select("doc_id", "code", F.col("cwe").alias("label"))
    return training.process_data(f, "doc_id", kind="binary").select(
        "doc_id", "label", "label_index", F.array_join("X", ",").alias("ids"), "split")


@query("process_data_balanced", FN + f""", x AS (SELECT {binary_sql("cwe")} AS label FROM fn),
c AS (SELECT label, count(*) AS n FROM x GROUP BY label)
SELECT label, (SELECT min(n) FROM c) AS n, CAST(150 AS BIGINT) AS width FROM c""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """The same, reduced to as many rows of each label as the smaller one has."""
    f = labelled_documents(spark, sf).select("doc_id", "code", F.col("cwe").alias("label"))
    out = training.process_data(f, "doc_id", kind="binary", balance=True)
    return out.groupBy("label").agg(F.count("*").alias("n"), F.max(F.size("X")).cast("bigint").alias("width"))


# --- streams ------------------------------------------------------------------------------------


def _stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    # A glob, so that the table may be one file or a folder of files.
    at_rest = spark.read.parquet(f"{sf}/{name}.parquet")
    stream = spark.readStream.schema(at_rest.schema).parquet(f"{sf}/{name}.parque[t]")
    cores = spark.sparkContext.defaultParallelism
    return stream.repartition(cores) if at_rest.rdd.getNumPartitions() < cores else stream


@query("stream_scan", f"""WITH p AS (SELECT source || '/' || doc_id AS file, {lines_sql("text")} AS parts FROM documents),
l AS (SELECT file, UNNEST(range(1, len(parts) + 1)) AS line, UNNEST(parts) AS context FROM p)
SELECT file, CAST(line AS VARCHAR) AS line, 'CWE-120' AS cwe, {trim_sql("context")} AS context FROM l
WHERE regexp_matches(context, {quoted(RULES[0]["pattern"])})
UNION ALL SELECT file, CAST(line AS VARCHAR), 'CWE-20', {trim_sql("context")} FROM l
WHERE regexp_matches(context, {quoted(RULES[1]["pattern"])})""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    root = scratch_path(spark, "scan")
    files = _stream(spark, sf, "documents").select(F.concat_ws("/", "source", "doc_id").alias("path"), "text")
    scan.stream_scan(files, RULES, f"{root}/out", f"{root}/state").awaitTermination()
    return spark.read.parquet(f"{root}/out").select("file", "line", "cwe", "context")


def _in_batches(spark: SparkSession, sf: str, name: str, files: int = 4) -> DataFrame:
    """A table as a stream of some micro-batches: its rows in so many files, one of them at a time."""
    at_rest = spark.read.parquet(f"{sf}/{name}.parquet")
    path = scratch_path(spark, name)
    at_rest.repartition(files).write.parquet(path)
    return spark.readStream.schema(at_rest.schema).option("maxFilesPerTrigger", 1).parquet(path)


@query("stream_refine", """
WITH fn AS (SELECT text AS code, CASE WHEN n_chars > 1500 THEN 'CWE-1' ELSE 'Benign' END AS cwe, doc_id, source AS project FROM documents)
""" + _REFINED.format(key="code", source="fn", order="doc_id"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    root = scratch_path(spark, "refine")
    rows = _in_batches(spark, sf, "documents").select(
        F.col("text").alias("code"), F.when(F.col("n_chars") > 1500, "CWE-1").otherwise("Benign").alias("cwe"),
        "doc_id", F.col("source").alias("project"))
    scan.stream_refine(rows, f"{root}/refined", f"{root}/state", ["doc_id"], buckets=64).awaitTermination()
    return read_buckets(spark, f"{root}/refined")


@query("stream_status", LATEST + " SELECT project, status FROM latest")
def _(spark: SparkSession, sf: str) -> DataFrame:
    root = scratch_path(spark, "status")
    events = _in_batches(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("project"), status_of_event(F.col("event_type")).alias("status"),
        "ts", "event_id")
    scan.stream_status(events, f"{root}/out", f"{root}/state", "ts", "event_id", buckets=16).awaitTermination()
    return scan.current_status(spark, f"{root}/out")


@query("latest_status", LATEST + " SELECT project, status FROM latest")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return prj.latest_status(project_events(spark, sf), "ts", "event_id")
