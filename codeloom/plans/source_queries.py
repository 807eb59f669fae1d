"""Queries for readers, writers and single-column operators."""

from __future__ import annotations

import io
import os
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import labels as L
from codeloom.functions import text as X
from codeloom.operators import findings as fnd
from codeloom.operators import projects as prj
from codeloom.plans.inputs import (
    C_FILES, C_LINES, EVENTS, FN, LATEST, RULES, ST, binary_sql, c_sources, labelled_documents,
    lines_sql, project_events, quoted, squeeze_sql, statements, table, trim_sql)
from codeloom.plans.registry import query
from codeloom.plans.training import train_random_forest
from codeloom.schemas import FINDING_COLUMNS
from codeloom.session import scratch_path, staged
from codeloom.sources import archives, cve, reports, tables, trees

# --- sources ------------------------------------------------------------------------------------

def _written(rows: DataFrame, root: str, pack: Callable[..., bytes] | None = None) -> None:
    """Write files below ``root`` from rows (path, content), or (path, ids, texts) packed into one archive each.

    A task that is repeated writes the same files again.
    """
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, *cells in batch.itertuples(index=False, name=None):
                target = f"{root}/{path}"
                if target.startswith(("/", "file:")):
                    os.makedirs(os.path.dirname(target.removeprefix("file://").removeprefix("file:")), exist_ok=True)
                with archives.open_file(target, "wb") as file:
                    file.write(cells[0].encode() if pack is None else pack(*cells))
            yield batch[["path"]]

    rows.mapInPandas(write, "path string").write.format("noop").mode("overwrite").save()


@query("read_source_tree", """
SELECT source || '/f' || doc_id || CASE doc_id % 3 WHEN 0 THEN '.c' ELSE '.H' END AS file,
       CASE doc_id % 3 WHEN 0 THEN 'c' ELSE 'h' END AS lang, 'unit' AS project, length(text) AS n_chars, md5(text) AS digest
FROM documents WHERE doc_id % 3 < 2""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as files of a folder, every third of a kind that is no source."""
    root = scratch_path(spark, "tree")
    suffix = F.element_at(F.array(F.lit(".c"), F.lit(".H"), F.lit(".txt")), (F.col("doc_id") % 3 + 1).cast("int"))
    _written(table(spark, sf, "documents").select(
        F.concat("source", F.lit("/f"), F.col("doc_id").cast("string"), suffix).alias("path"), "text"), root)
    files = trees.read_source_tree(spark, root, "unit")
    return files.select(F.regexp_extract("path", "([^/]+/[^/]+)$", 1).alias("file"), "lang", "project",
                        F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("digest"))


def _packed(ids: list[int], texts: list[str]) -> bytes:
    """An archive of three entries per text, packed in turn by each method."""
    box = io.BytesIO()
    with zipfile.ZipFile(box, "w") as archive:
        archive.mkdir("src")
        for doc_id, text in zip(ids, texts):
            method = (zipfile.ZIP_DEFLATED, zipfile.ZIP_STORED, zipfile.ZIP_BZIP2, zipfile.ZIP_LZMA)[doc_id % 4]
            archive.writestr(f"src/d{doc_id}.C", text, method)
            archive.writestr(f"README{doc_id}", "none")
            archive.writestr(f"inc/d{doc_id}.h", "int use(int);")
    return box.getvalue()


@query("read_zip_sources", """
SELECT 'a' || (doc_id // 64) || '.zip' AS archive, 'src/d' || doc_id || '.C' AS path, 'c' AS lang,
       length(text) AS n_chars, md5(text) AS digest FROM documents
UNION ALL
SELECT 'a' || (doc_id // 64) || '.zip', 'inc/d' || doc_id || '.h', 'h', 13, md5('int use(int);') FROM documents""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Archives of 64 neighbouring documents each, read in ranges of a few entries."""
    root = scratch_path(spark, "archives")
    boxes = table(spark, sf, "documents").groupBy(F.floor(F.col("doc_id") / 64).alias("b")).agg(
        F.sort_array(F.collect_list(F.struct("doc_id", "text"))).alias("d"))
    _written(boxes.select(F.concat(F.lit("a"), F.col("b").cast("string"), F.lit(".zip")).alias("path"), "d.doc_id", "d.text"),
             root, _packed)
    return trees.read_zip_sources(spark, f"{root}/*.zip", range_bytes=20_000).select(
        F.substring_index("archive", "/", -1).alias("archive"), "path", "lang",
        F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("digest"))


@query("decode_source", "SELECT doc_id, md5(text) AS from_utf8, md5(text) AS from_latin1 FROM documents")
def _(spark: SparkSession, sf: str) -> DataFrame:
    raw = table(spark, sf, "documents").select(
        "doc_id", F.encode("text", "UTF-8").alias("u"), F.encode("text", "ISO-8859-1").alias("l"))
    return raw.select("doc_id", F.md5(trees.decode_source(F.col("u"))).alias("from_utf8"),
                      F.md5(trees.decode_source(F.col("l"))).alias("from_latin1"))


@query("read_flawfinder", ST + """
SELECT file, CAST(line AS VARCHAR) AS line, cwe, context, 'FlawFinder' AS tool FROM st""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "flawfinder")
    s = statements(spark, sf)
    cell = {"File": F.col("file"), "Line": F.col("line").cast("string"), "CWEs": F.col("cwe"),
            "Context": F.col("context"), "Category": F.col("lang")}
    s.select(*[cell.get(n, F.lit("x")).alias(n) for n in reports.FLAWFINDER_CSV.fieldNames()]).write.csv(
        path, header=True, quote='"', escape='"', quoteAll=True)
    return fnd.flawfinder_columns(reports.read_flawfinder(spark, path)).select(
        "file", "line", "cwe", "context", "tool")


@query("read_cppcheck", ST + """
SELECT file, CAST(line AS INTEGER) AS line, 'CppCheck' AS tool, lang AS name,
       CASE WHEN cwe = 'CWE-120' THEN 'CWE-120' ELSE 'CWE-unknown' END AS cwe FROM st""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "cppcheck")
    at = F.transform(X.split_lines(F.col("code")), lambda s, i: F.struct(
        F.col("file").alias("_file"), i.cast("string").alias("_line"), F.lit("1").alias("_column")))
    labelled_documents(spark, sf).select(
        F.col("lang").alias("_id"), F.lit("style").alias("_severity"), F.col("file").alias("_file0"),
        F.when(F.col("cwe") == "CWE-120", "120").alias("_cwe"), at.alias("location"),
    ).write.format("xml").option("rowTag", "error").option("rootTag", "errors").save(path)
    found = fnd.prefix_cwe(reports.read_cppcheck(spark, path))
    return found.select("file", "line", "tool", F.col("id").alias("name"), "cwe")


@query("read_rats", ST + """
SELECT file, CAST(line AS INTEGER) AS line, lang AS category, project AS msg, 'CWE-unknown' AS cwe,
       'Rats' AS tool FROM st""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "rats")
    numbers = F.transform(X.split_lines(F.col("code")), lambda s, i: i.cast("string"))
    labelled_documents(spark, sf).select(
        F.lit("High").alias("severity"), F.col("lang").alias("type"), F.col("project").alias("message"),
        F.array(F.struct(F.col("file").alias("name"), numbers.alias("line"))).alias("file"),
    ).write.format("xml").option("rowTag", "vulnerability").option("rootTag", "rats_output").save(path)
    return fnd.rats_columns(reports.read_rats(spark, path)).select(
        "file", "line", "category", "msg", "cwe", "tool")


def _bucketed_reports(rows: DataFrame, item, bucket) -> DataFrame:
    """JSON arrays of at most 64 neighbouring items each."""
    return rows.select(bucket.alias("b"), item.alias("item")).groupBy("b").agg(
        F.collect_list("item").alias("items"))


@query("read_infer", "SELECT source AS file, doc_id AS line, lang AS bug_type, 'infer' AS tool FROM documents")
def _(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "infer")
    item = F.struct(F.col("source").alias("file"), F.col("doc_id").alias("line"), F.col("lang").alias("bug_type"))
    _bucketed_reports(table(spark, sf, "documents"), item, F.floor(F.col("doc_id") / 64)).select(
        F.to_json("items").alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return reports.read_infer(spark, path, "file string, line bigint, bug_type string")


def _cve_feed(spark: SparkSession, sf: str) -> DataFrame:
    """Feeds made from documents: one record per document, 64 records per feed file. Records whose
    quality label is 0 have an empty reference list; unlabelled ones have none at all."""
    path = scratch_path(spark, "cve")
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    ref = F.struct(F.concat(F.lit("http://x/"), "doc_id").alias("url"))
    refs = F.when(F.col("quality") == 1, F.array(ref)).when(
        F.col("quality") == 0, F.slice(F.array(ref), 1, 0))
    item = F.struct(
        F.struct(
            F.struct(F.concat(F.lit("CVE-"), "doc_id").alias("ID")).alias("CVE_data_meta"),
            F.struct(refs.alias("reference_data")).alias("references"),
            F.struct(F.array(F.struct(F.lit("en").alias("lang"), F.col("text").alias("value"))).alias(
                "description_data")).alias("description"),
        ).alias("cve"),
        F.struct(F.array(F.struct(F.lit("OR").alias("operator"))).alias("nodes")).alias("configurations"),
        F.struct(F.struct(
            F.struct(F.col("lang").alias("vectorString"), (F.col("n_chars") / 2).alias("baseScore")).alias("cvssV2"),
            F.col("source").alias("severity"), (F.col("toxic") == 1).alias("obtainAllPrivilege"),
        ).alias("baseMetricV2")).alias("impact"),
        F.lit("2020-01-01T00:00Z").alias("publishedDate"))
    feeds = _bucketed_reports(d, item, F.floor(F.col("doc_id") / 64))
    feeds.select(F.to_json(F.struct(F.lit("CVE").alias("CVE_data_type"), F.col("items").alias("CVE_Items"))).alias(
        "value")).write.option("maxRecordsPerFile", 1).text(path)
    return cve.read_cve_feeds(spark, path)


@query("read_cve_feeds", "SELECT 'CVE-' || doc_id AS cve_id, n_chars FROM documents")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _cve_feed(spark, sf).select(F.explode("CVE_Items").alias("i")).select(
        F.col("i.cve.CVE_data_meta.ID").alias("cve_id"),
        F.length(F.col("i.cve.description.description_data")[0]["value"]).cast("bigint").alias("n_chars"))


@query("flatten_cve", """
SELECT 'CVE-' || d.doc_id AS cve_id, '2020-01-01T00:00Z' AS published_date, source AS severity,
       lang AS cvss2_vector_string, CAST(n_chars / 2 AS DOUBLE) AS score,
       CASE WHEN l.doc_id IS NOT NULL THEN CASE WHEN toxic = 1 THEN 'true' ELSE 'false' END END AS obtain_all_privilege,
       CASE WHEN quality = 1 THEN '[{"url":"http://x/' || d.doc_id || '"}]' END AS reference_json,
       '[{"operator":"OR"}]' AS nodes, CAST(34 AS BIGINT) AS n_columns
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE quality IS NULL OR quality = 1""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    flat = cve.cast_all_string(cve.flatten_cve(_cve_feed(spark, sf)))
    return flat.select(
        "cve_id", "published_date", "severity", "cvss2_vector_string",
        F.col("cvss2_base_score").cast("double").alias("score"), "obtain_all_privilege", "reference_json",
        "nodes", F.lit(len(flat.columns)).cast("bigint").alias("n_columns"))


@query("read_labelled_csv", FN + "SELECT DISTINCT code, cwe AS label FROM fn WHERE code IS NOT NULL")
def _(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "labelled")
    tables.export_code_label(labelled_documents(spark, sf)).write.csv(
        path, header=True, quote='"', escape='"', quoteAll=True)
    return tables.read_labelled_csv(spark, path)


@query("export_code_label", FN + "SELECT code, cwe AS label FROM fn")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return tables.export_code_label(labelled_documents(spark, sf))


@query("write_dataset_csv", ST + "SELECT DISTINCT context AS code, cwe AS label FROM st")
def _(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "dataset")
    tables.write_dataset_csv(tables.export_code_label(statements(spark, sf)), path)
    return spark.read.schema("code string, label string").csv(
        path, header=True, multiLine=True, quote='"', escape='"')


@query("append_table", FN + "SELECT project, count(*) AS n, sum(length(code))::BIGINT AS chars FROM fn GROUP BY project")
def _(spark: SparkSession, sf: str) -> DataFrame:
    root = scratch_path(spark, "function")
    f = labelled_documents(spark, sf)
    tables.append_table(f.filter("cwe = 'Benign'"), root)
    tables.append_table(f.filter("cwe <> 'Benign'"), root)
    return tables.read_table(spark, root).groupBy("project").agg(
        F.count("*").alias("n"), F.sum(F.length("code")).alias("chars"))


@query("append_after_replace", FN + """SELECT project, count(*) AS n, sum(length(code))::BIGINT AS chars FROM fn GROUP BY project""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    root = scratch_path(spark, "appended")
    f = labelled_documents(spark, sf)
    tables.append_table(f.filter("cwe = 'Benign'"), root, batch="first")
    tables.replace_table(tables.read_table(spark, root), root)
    for _again in range(2):  # a repeated batch counts once
        tables.append_table(f.filter("cwe <> 'Benign'"), root, batch="second")
    return tables.read_table(spark, root).groupBy("project").agg(
        F.count("*").alias("n"), F.sum(F.length("code")).alias("chars"))


@query("replace_table", FN + "SELECT code, cwe, min(doc_id) AS doc_id FROM fn WHERE cwe <> 'Benign' GROUP BY code, cwe")
def _(spark: SparkSession, sf: str) -> DataFrame:
    root = scratch_path(spark, "replaced")
    tables.replace_table(labelled_documents(spark, sf).select("code", "cwe", "doc_id"), root)
    old = tables.read_table(spark, root)
    tables.replace_table(
        fnd.vulnerable(old).groupBy("code", "cwe").agg(F.min("doc_id").alias("doc_id")), root)
    return tables.read_table(spark, root)


SAFE_SQL = "regexp_replace(code, '[^\\t-\\r\\x20-\\x7e]', '', 'g')"
_ALPHA = quoted(X.ALPHABET)


def ids_sql(expr: str) -> str:
    return f"list_transform(string_split({expr}, ''), lambda c: strpos({_ALPHA}, c))"


SEQ_SQL = (f"CASE WHEN length(safe) > 150 THEN {ids_sql('right(safe, 150)')} "
           f"WHEN safe = '' THEN list_transform(range(150), lambda i: 0) "
           f"ELSE list_concat({ids_sql('safe')}, list_transform(range(150 - length(safe)), lambda i: 0)) END")


@query("save_vectors", FN + f""", s AS (SELECT doc_id, cwe, {SAFE_SQL} AS safe FROM fn)
SELECT cwe AS y, array_to_string({SEQ_SQL}, ',') AS ids FROM s""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "vectors")
    f = labelled_documents(spark, sf)
    tables.save_vectors(f.select(X.char_sequence(F.col("code")).alias("X"), F.col("cwe").alias("y")), path)
    return tables.load_vectors(spark, path).select("y", F.array_join("X", ",").alias("ids"))


@query("save_model", FN + "SELECT count(*) AS n, count(*) AS n_equal, TRUE AS sums_to_one FROM fn")
def _(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "model")
    f = tables.export_code_label(labelled_documents(spark, sf))
    model = train_random_forest(f)
    tables.save_model(model, path)
    # Written once each, so that no task of the comparison holds a model.
    at = lambda m, name: staged(m.transform(f.withColumn("row", F.xxhash64("code", "label"))).select(
        "row", F.col("prediction").alias(name), vector_to_array("probability").alias(f"{name}_p")).distinct(), name)
    both = f.withColumn("row", F.xxhash64("code", "label")).join(at(model, "one"), "row").join(
        at(tables.load_model(path), "two"), "row")
    total = F.aggregate("two_p", F.lit(0.0), lambda s, x: s + x)
    return both.agg(
        F.count("*").alias("n"), F.count_if((F.col("one") == F.col("two")) & (F.col("one_p") == F.col("two_p"))).alias("n_equal"),
        F.bool_and(F.abs(total - 1) < 1e-9).alias("sums_to_one"))


# --- findings -----------------------------------------------------------------------------------

def _three_reports(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    s = statements(spark, sf).withColumn("line", F.col("line").cast("string"))
    none = F.lit(None).cast("string")
    flawfinder = s.select(
        F.col("file").alias("File"), F.col("line").alias("Line"), F.col("lang").alias("Category"),
        F.col("project").alias("Warning"), F.lit("try").alias("Suggestion"), F.lit("note").alias("Note"),
        F.when(F.col("cwe") != "Benign", F.col("cwe")).alias("CWEs"), F.col("context").alias("Context"),
        F.lit("1").alias("Fingerprint"), F.lit("FlawFinder").alias("tool"))
    cppcheck = s.select(
        "file", "line", F.col("lang").alias("id"), F.col("project").alias("msg"), F.lit("v").alias("verbose"),
        none.alias("info"), F.lit("true").alias("inconclusive"), F.col("cwe"), F.lit("CppCheck").alias("tool"))
    rats = s.select(
        "file", F.when(F.col("cwe") == "CWE-120", F.col("line")).alias("line"), F.lit("High").alias("severity"),
        F.col("lang").alias("type"), F.col("project").alias("message"), F.lit("CWE-unknown").alias("cwe"),
        F.lit("Rats").alias("tool"))
    return flawfinder, cppcheck, rats


def _finding_sql(source: str, where: str, **cells: str) -> str:
    return ("SELECT " + ", ".join(f"{cells.get(c, quoted('-'))} AS \"{c}\"" for c in FINDING_COLUMNS)
            + f" FROM {source} WHERE {where}")


THREE_SQL = "\nUNION ALL\n".join([
    _finding_sql("st", "cwe <> 'Benign'", file="file", line="CAST(line AS VARCHAR)", category="lang", msg="project",
                 note="'try  note'", cwe="cwe", context=trim_sql("context"), tool="'FlawFinder'"),
    _finding_sql("st", "true", file="file", line="CAST(line AS VARCHAR)", name="lang", msg="project", cwe="cwe",
                 tool="'CppCheck'"),
    _finding_sql("st", "cwe = 'CWE-120'", file="file", line="CAST(line AS VARCHAR)", severity="'High'",
                 category="lang", msg="project", cwe="'CWE-unknown'", tool="'Rats'"),
])


@query("normalize_findings", ST + THREE_SQL)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return fnd.normalize_findings(*_three_reports(spark, sf))


@query("union_findings", ST + """
SELECT file, line, lang AS category, cwe, context, CAST(NULL AS VARCHAR) AS severity FROM st
UNION ALL SELECT file, line, lang, CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), 'High' FROM st""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    s = statements(spark, sf).withColumn("line", F.col("line").cast("bigint"))
    left = s.select("file", "line", F.col("lang").alias("category"), "cwe", "context")
    right = s.select(F.lit("High").alias("severity"), F.col("lang").alias("category"), "line", "file")
    return fnd.union_findings(left, right)


@query("prefix_cwe", """
WITH e AS (SELECT doc_id, 'f' || (doc_id // 4) AS file, CASE WHEN n_chars > 2000 THEN CAST(n_chars AS VARCHAR) END AS cwe
           FROM documents),
x AS (SELECT doc_id, file, cwe, max(cwe) OVER (PARTITION BY file) AS any_cwe FROM e)
SELECT doc_id, file, CASE WHEN any_cwe IS NULL THEN 'CWE-unknown' ELSE 'CWE-' || cwe END AS cwe FROM x""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return fnd.prefix_cwe(d.select(
        "doc_id", F.concat(F.lit("f"), F.floor(F.col("doc_id") / 4).cast("string")).alias("file"),
        F.when(F.col("n_chars") > 2000, F.col("n_chars").cast("string")).alias("cwe")))


def _page_lines(spark: SparkSession, sf: str) -> DataFrame:
    return fnd.split_statements(table(spark, sf, "pages").select("page_id", F.col("html").alias("text")))


PAGE_LINES = f"""WITH p AS (SELECT page_id, {lines_sql("html")} AS parts FROM pages),
pl AS (SELECT page_id, CAST(UNNEST(range(len(parts))) AS BIGINT) AS line, UNNEST(parts) AS context FROM p)
"""


@query("filter_statement_context", PAGE_LINES + "SELECT page_id, line, context FROM pl WHERE contains(context, ';')")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return fnd.filter_statement_context(_page_lines(spark, sf)).select(
        "page_id", F.col("line").cast("bigint").alias("line"), "context")


@query("attach_context", ST + """,
f AS (SELECT DISTINCT doc_id, file, line // 2 * 3 AS line FROM st)
SELECT f.file, f.line, coalesce(st.context, '') AS context FROM f
LEFT JOIN st ON f.file = st.file AND f.line = st.line + 1""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    f = labelled_documents(spark, sf)
    asked = statements(spark, sf).select(
        "file", (F.floor(F.col("line") / 2) * 3).alias("line")).distinct()
    return fnd.attach_context(asked, f, "file", "code")


def _rule_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Findings of the example rules in the C files."""
    sources = c_sources(spark, sf).select(F.col("path").alias("file"), "project", "text")
    return fnd.scan_rules(fnd.split_statements(sources, first=1), RULES)


@query("scan_rules", C_LINES + """
SELECT file, CAST(line AS VARCHAR) AS line, context, name, cwe, level, category, msg, project, 'rules' AS tool
FROM c_find""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _rule_rows(spark, sf).select(
        "file", "line", "context", "name", "cwe", "level", "category", "msg", "project", "tool")


# --- text ---------------------------------------------------------------------------------------

@query("collapse_whitespace", f"SELECT doc_id, {trim_sql(squeeze_sql('text', ' '))} AS code FROM documents")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        "doc_id", X.trim_space(X.collapse_whitespace(F.col("text"))).alias("code"))


@query("strip_all_whitespace", f"SELECT doc_id, {squeeze_sql('text')} AS code FROM documents")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", X.strip_all_whitespace(F.col("text")).alias("code"))


def uncommented_sql(expr: str) -> str:
    """A block comment runs to the first end mark after its start, a line comment to the line's end."""
    block, line = r"/\*(?s:.*?)\*/", r"//[^\n]*"
    return f"translate(regexp_replace({expr}, '{block}|{line}', '', 'g'), chr(10) || chr(9), '')"


@query("strip_comments", C_FILES + f"""
SELECT file, {uncommented_sql("text")} AS code FROM c_text
UNION ALL
SELECT url, {uncommented_sql("html")} FROM pages""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    code = c_sources(spark, sf).select(F.col("path").alias("file"), "text").unionByName(
        table(spark, sf, "pages").select(F.col("url").alias("file"), F.col("html").alias("text")))
    return code.select("file", X.strip_comments(F.col("text")).alias("code"))


@query("filter_min_length", ST + "SELECT doc_id, line, context FROM st WHERE length(context) > 5")
def _(spark: SparkSession, sf: str) -> DataFrame:
    s = statements(spark, sf)
    return s.filter(X.longer_than(F.col("context"), 5)).select(
        "doc_id", F.col("line").cast("bigint").alias("line"), "context")


@query("filter_length_band", ST + """
SELECT doc_id, line, length(context) AS n FROM st WHERE length(context) < 151 AND length(context) > 10""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return statements(spark, sf).filter(X.in_length_band(F.col("context"))).select(
        "doc_id", F.col("line").cast("bigint").alias("line"), F.length("context").cast("bigint").alias("n"))


@query("split_statements", ST + "SELECT doc_id, line, context FROM st")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return statements(spark, sf).select("doc_id", F.col("line").cast("bigint").alias("line"), "context")


@query("path_basename", "SELECT page_id, regexp_extract(url, '[^/]*$') AS name FROM pages")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", X.path_basename(F.col("url")).alias("name"))


@query("concat_non_null", """
SELECT d.doc_id, CASE WHEN coalesce(CAST(quality AS VARCHAR), CAST(nullif(toxic, 0) AS VARCHAR)) IS NOT NULL
  THEN concat_ws(',', CAST(quality AS VARCHAR), CAST(nullif(toxic, 0) AS VARCHAR)) END AS joined
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left")
    return d.select("doc_id", X.concat_non_null(
        F.col("quality").cast("string"), F.nullif("toxic", F.lit(0)).cast("string")).alias("joined"))


@query("cast_all_string", """
SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(ts AS VARCHAR) AS ts, CAST(user_id AS VARCHAR) AS user_id,
       event_type, CAST(value AS VARCHAR) AS value, props FROM events""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return cve.cast_all_string(table(spark, sf, "events"))


@query("char_ids", FN + f""", s AS (SELECT doc_id, {SAFE_SQL} AS safe FROM fn)
SELECT doc_id, CASE WHEN safe = '' THEN '' ELSE array_to_string({ids_sql('safe')}, ',') END AS ids FROM s""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        "doc_id", F.array_join(X.char_ids(F.col("text")), ",").alias("ids"))


@query("pad_ids", FN + f""", s AS (SELECT doc_id, {SAFE_SQL} AS safe FROM fn)
SELECT doc_id, array_to_string({SEQ_SQL}, ',') AS ids FROM s""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        "doc_id", F.array_join(X.char_sequence(F.col("text")), ",").alias("ids"))


_REPEATED = "|".join(f"{ch}{ch}+" for ch in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
_CLEAN = (r"array_to_string(list_transform(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+'), "
          f"lambda w: CASE WHEN regexp_full_match(w, '{_REPEATED}|[A-Za-z]') THEN '' ELSE w END), '')")


@query("rf_clean_text", f"SELECT doc_id, {_CLEAN} AS code FROM documents")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", X.rf_clean_text(F.col("text")).alias("code"))


@query("code_tokens_regex", f"""
SELECT doc_id, array_to_string(regexp_extract_all(lower(text), {quoted(X.TFIDF_TOKEN)}), '~') AS tokens FROM documents""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        "doc_id", F.array_join(X.code_tokens_regex(F.col("text")), "~").alias("tokens"))


_ESCAPED = X.C_TOKEN.replace(r'"[^"\n]*"', r'"[^"\\\n]*(?:\\.[^"\\\n]*)*"').replace(
    r"'[^'\n]*'", r"'[^'\\\n]*(?:\\.[^'\\\n]*)*'")


def c_tokens_sql(expr: str) -> str:
    return f"list_transform(regexp_extract_all({expr}, {quoted(_ESCAPED)}), lambda t: replace(t, ' ', ''))"


@query("code_tokens_c", C_FILES + f"""
SELECT file, array_to_string({c_tokens_sql("text")}, chr(31)) AS tokens FROM c_text
UNION ALL SELECT url, array_to_string({c_tokens_sql("html")}, chr(31)) FROM pages""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    code = c_sources(spark, sf).select(F.col("path").alias("file"), "text").unionByName(
        table(spark, sf, "pages").select(F.col("url").alias("file"), F.col("html").alias("text")))
    return code.select("file", F.array_join(X.code_tokens_c(F.col("text")), "\x1f").alias("tokens"))


@query("normalize_text", r"""
SELECT doc_id, replace(regexp_replace(text, '\p{Mn}+', '', 'g'), ' ', 'Ä') AS code FROM documents""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", X.normalize_text(F.col("text")).alias("code"))


def simple_sql(expr: str) -> str:
    return (f"list_filter(regexp_extract_all(lower({expr}), {quoted(X.ALPHABETIC)}), "
            "lambda w: length(w) BETWEEN 2 AND 15 AND NOT starts_with(w, '_'))")


@query("simple_tokens", f"SELECT doc_id, array_to_string({simple_sql('text')}, ' ') AS tokens FROM documents")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        "doc_id", F.array_join(X.simple_tokens(F.col("text")), " ").alias("tokens"))


# --- labels -------------------------------------------------------------------------------------

@query("binary_label", FN + f"SELECT doc_id, {binary_sql('cwe')} AS label FROM fn")
def _(spark: SparkSession, sf: str) -> DataFrame:
    f = labelled_documents(spark, sf).select("doc_id", F.col("cwe").alias("label"))
    return L.binary_label(f)


@query("binary_rows", FN + "SELECT DISTINCT code, CASE WHEN cwe = 'Benign' THEN 0 ELSE 1 END AS label FROM fn")
def _(spark: SparkSession, sf: str) -> DataFrame:
    f = labelled_documents(spark, sf)
    return f.select("code", L.binary_flag(F.col("cwe")).alias("label")).dropDuplicates()


@query("map_label", """
SELECT d.doc_id, CASE CASE WHEN toxic = 1 THEN 'Vulnerable Code' WHEN toxic = 0 THEN 'Benign Code' ELSE lang END
  WHEN 'Vulnerable Code' THEN 1 WHEN 'Benign Code' THEN 0 END AS label
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    spelled = F.when(F.col("toxic") == 1, "Vulnerable Code").when(
        F.col("toxic") == 0, "Benign Code").otherwise(F.col("lang"))
    return d.select("doc_id", L.map_label(spelled, L.SPELLED_LABELS).alias("label"))


@query("clean_cwe_label", """
WITH x AS (SELECT d.doc_id, CASE WHEN toxic = 1 AND quality = 0 THEN ['CWE-20', 'CWE-unknown', 'CWE-20']
                                 WHEN toxic = 1 THEN ['CWE-20'] ELSE ['CWE-unknown'] END AS c
           FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
SELECT doc_id, CASE WHEN len(c) > 1 THEN 'CWE-20' ELSE c[1] END AS plain,
       CASE WHEN len(c) > 1 THEN '[''CWE-20'']' ELSE '[''' || c[1] || ''']' END AS shown FROM x""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    raw = F.when((F.col("toxic") == 1) & (F.col("quality") == 0), F.array(*map(F.lit, ["CWE-20", "CWE-unknown", "CWE-20"]))).when(
        F.col("toxic") == 1, F.array(F.lit("CWE-20"))).otherwise(F.array(F.lit("CWE-unknown")))
    return d.select("doc_id", L.cwe_list_repr(L.clean_cwe_list(raw)).alias("shown")).select(
        "doc_id", L.plain_cwe(F.col("shown")).alias("plain"), "shown")


def _categories(spark: SparkSession, sf: str) -> DataFrame:
    """Statements with a category, a name that equals it, hides it, or is a gap, and a label. As for
    sampled benign rows, documents without a label have no category."""
    d = table(spark, sf, "documents").join(
        table(spark, sf, "labels").withColumn("has", F.lit(True)), "doc_id", "left")
    kind = F.col("doc_id") % 3
    return d.select(
        "doc_id", F.when(F.col("has"), F.col("lang")).alias("category"),
        F.when(kind == 0, F.col("lang")).when(kind == 1, "-").otherwise(F.col("source")).alias("name"),
        F.when(F.col("toxic") == 1, "CWE-120").when(F.col("quality") == 0, "CWE-unknown").otherwise("Benign").alias("cwe"))


CATEGORIES = """WITH cat AS (
  SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN lang END AS category,
         CASE d.doc_id % 3 WHEN 0 THEN lang WHEN 1 THEN '-' ELSE source END AS name,
         CASE WHEN toxic = 1 THEN 'CWE-120' WHEN quality = 0 THEN 'CWE-unknown' ELSE 'Benign' END AS cwe
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
"""


@query("relabel_category", CATEGORIES + """
SELECT doc_id, CASE WHEN category = name OR name = '-' THEN category ELSE name END AS category FROM cat""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _categories(spark, sf).select(
        "doc_id", L.relabel_category(F.col("category"), F.col("name")).alias("category"))


@query("drop_null_rows", """
SELECT d.doc_id, lang, quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE quality IS NOT NULL""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return d.select("doc_id", "lang", "quality").dropna(subset=["quality"])


@query("filter_vulnerable", FN + "SELECT doc_id, cwe FROM fn WHERE cwe <> 'Benign'")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return fnd.vulnerable(labelled_documents(spark, sf)).select("doc_id", "cwe")


# --- projects -----------------------------------------------------------------------------------

_ID_SQL = "CAST('0x' || md5(project)[1:4] AS BIGINT)"


def _known_projects(spark: SparkSession, sf: str) -> DataFrame:
    """Latest status of the projects that are not complete; the others count as not known yet."""
    return prj.filter_todo_projects(prj.latest_status(project_events(spark, sf), "ts", "event_id"))


KNOWN = LATEST + ", known AS (SELECT * FROM latest WHERE status <> 'Complete')"


@query("new_projects", KNOWN + """
SELECT DISTINCT project FROM ev WHERE project NOT IN (SELECT project FROM known)""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return prj.new_projects(project_events(spark, sf), _known_projects(spark, sf))


@query("register_projects", KNOWN + f"""
SELECT {_ID_SQL} AS project_id, project, status FROM known
UNION ALL
SELECT {_ID_SQL}, project, 'Not Started' FROM (SELECT DISTINCT project FROM ev) WHERE project NOT IN (SELECT project FROM known)""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    known = _known_projects(spark, sf).withColumn("project_id", L.project_id(F.col("project")))
    return prj.register_projects(project_events(spark, sf), known)


@query("project_ids", EVENTS + f" SELECT DISTINCT project, {_ID_SQL} AS project_id FROM ev")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return project_events(spark, sf).select("project", L.project_id(F.col("project")).alias("project_id")).distinct()


@query("set_status", KNOWN + """
SELECT p.project, coalesce(k.status, 'Not Started') AS status FROM (SELECT DISTINCT project FROM ev) p
LEFT JOIN known k ON p.project = k.project""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    fresh = prj.register_projects(project_events(spark, sf))
    return prj.set_status(fresh, _known_projects(spark, sf)).select("project", "status")


@query("get_status", KNOWN + """
SELECT p.project, coalesce(k.status, 'Unknown') AS status FROM (SELECT DISTINCT project FROM ev) p
LEFT JOIN known k ON p.project = k.project""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return prj.get_status(project_events(spark, sf).select("project").distinct(), _known_projects(spark, sf))


@query("filter_todo_projects", LATEST + " SELECT project, status FROM latest WHERE status <> 'Complete'")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return prj.filter_todo_projects(prj.latest_status(project_events(spark, sf), "ts", "event_id"))


@query("remaining_files", FN + """
SELECT file FROM fn WHERE file NOT IN (SELECT file FROM fn WHERE cwe <> 'Benign')""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    f = labelled_documents(spark, sf).select("file", "cwe")
    return prj.remaining_files(f.select("file"), fnd.vulnerable(f))
