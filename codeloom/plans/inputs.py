"""The dataset tables of the engine, bound to the given tables, in DataFrame form and as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import text as X
from codeloom.operators.findings import split_statements
from codeloom.operators.projects import COMPLETE, IN_PROGRESS, NOT_STARTED
from codeloom.operators.scale import spread_small


_TEXT_TABLES = {"documents", "pages", "conversations"}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    return spread_small(df) if name in _TEXT_TABLES else df


def quoted(text: str) -> str:
    """A SQL string literal (DuckDB keeps backslashes as they are)."""
    return "'" + text.replace("'", "''") + "'"


SPACES_SQL = quoted(f"[{X.SPACE_CHARS}]+")


def squeeze_sql(expr: str, by: str = "") -> str:
    return f"regexp_replace({expr}, {SPACES_SQL}, {quoted(by)}, 'g')"


def trim_sql(expr: str) -> str:
    edges = quoted(rf"^[{X.SPACE_CHARS}]+|[{X.SPACE_CHARS}]+\z")
    return f"regexp_replace({expr}, {edges}, '', 'g')"


def lines_sql(expr: str) -> str:
    """List of lines, without the empty piece after a final line end."""
    ends = quoted(rf"\r\n|[{X.LINE_END_CHARS}]")
    parts = f"string_split_regex({expr}, {ends})"
    return f"(CASE WHEN {parts}[-1] = '' THEN {parts}[:-2] ELSE {parts} END)"


# --- functions and statements -------------------------------------------------------------------

def labelled_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Function table: (doc_id, file, code, project, lang, cwe)."""
    d, l = table(spark, sf, "documents"), table(spark, sf, "labels")
    cwe = F.when(F.col("toxic") == 1, "CWE-120").when(F.col("quality") == 0, "CWE-unknown").otherwise("Benign")
    return d.join(l, "doc_id", "left").select(
        "doc_id", F.concat_ws("/", "source", "doc_id").alias("file"), F.col("text").alias("code"),
        F.col("source").alias("project"), "lang", cwe.alias("cwe"))


FN = """WITH fn AS (
  SELECT d.doc_id, d.source || '/' || d.doc_id AS file, d.text AS code, d.source AS project, d.lang,
         CASE WHEN l.toxic = 1 THEN 'CWE-120' WHEN l.quality = 0 THEN 'CWE-unknown' ELSE 'Benign' END AS cwe
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
"""


def statements(spark: SparkSession, sf: str) -> DataFrame:
    """Statement table: the lines of every document, counted from 0."""
    return split_statements(labelled_documents(spark, sf), text="code")


ST = FN + f""", fn_lines AS (SELECT *, {lines_sql("code")} AS parts FROM fn),
st AS (SELECT doc_id, file, project, lang, cwe,
              CAST(UNNEST(range(len(parts))) AS BIGINT) AS line, UNNEST(parts) AS context FROM fn_lines)
"""


def binary_sql(expr: str) -> str:
    return f"CASE WHEN {expr} = 'Benign' THEN 'Benign' ELSE 'Vulnerable' END"


# --- C sources ----------------------------------------------------------------------------------

def c_sources(spark: SparkSession, sf: str) -> DataFrame:
    """One C file per document: its sentences as the statements of a function, and a small second
    function. (doc_id, path, project, text)"""
    body = F.replace("text", F.lit("."), F.lit(";"))
    doc = F.col("doc_id").cast("string")
    text = F.concat(
        F.lit("#include <unit.h>\nint use(int); /* { */\nstatic int fn_"), doc, F.lit("(int n)\n{\n"), body,
        F.lit("\n  return n;\n}\n\n// next {\nint tag_"), doc, F.lit("(void) { return '{' + "), doc, F.lit("; }\n"))
    return table(spark, sf, "documents").select(
        "doc_id", F.concat(F.col("source"), F.lit("/f"), doc, F.lit(".c")).alias("path"),
        F.col("source").alias("project"), text.alias("text"))


C_FILES = """WITH c_fun AS (
  SELECT doc_id, source || '/f' || doc_id || '.c' AS file, source AS project,
         'static int fn_' || doc_id || '(int n)' || chr(10) || '{' || chr(10) || replace(text, '.', ';')
           || chr(10) || '  return n;' || chr(10) || '}' AS main_code,
         'int tag_' || doc_id || '(void) { return ''{'' + ' || doc_id || '; }' AS tag_code
  FROM documents),
c_text AS (
  SELECT *, '#include <unit.h>' || chr(10) || 'int use(int); /* { */' || chr(10) || main_code || chr(10)
            || chr(10) || '// next {' || chr(10) || tag_code || chr(10) AS text FROM c_fun)"""

# Example rules; a real rule set is the caller's.
RULES = [
    dict(name="ending", pattern="(tion|ment|ing)[,;]", cwe="CWE-120", level="4", category="buffer",
         msg="ends a clause"),
    dict(name="article", pattern="^(The|La|Der|El) ", cwe="CWE-20", level="2", category="input",
         msg="opens a line"),
    dict(name="tagged", pattern=r"tag_[0-9]+\(", cwe="CWE-676", level="1", category="tagged", msg="tag"),
]
RULES_SQL = "rules(name, pattern, cwe, level, category, msg) AS (VALUES " + ", ".join(
    "(" + ", ".join(quoted(r[c]) for c in ("name", "pattern", "cwe", "level", "category", "msg")) + ")"
    for r in RULES) + ")"
C_LINES = C_FILES + f""", c_parts AS (SELECT *, {lines_sql("text")} AS parts FROM c_text),
c_line AS (SELECT doc_id, file, project, CAST(UNNEST(range(1, len(parts) + 1)) AS BIGINT) AS line,
                  UNNEST(parts) AS raw FROM c_parts),
{RULES_SQL},
c_find AS (
  SELECT c.doc_id, c.file, c.project, c.line, {trim_sql("c.raw")} AS context, r.name, r.cwe, r.level,
         r.category, r.msg
  FROM c_line c JOIN rules r ON regexp_matches(c.raw, r.pattern))"""


# --- files with several functions and findings ---------------------------------------------------

def shared_files(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as functions, eight neighbours to a file."""
    return table(spark, sf, "documents").select(
        F.concat(F.lit("f"), F.floor(F.col("doc_id") / 8).cast("string")).alias("file"),
        F.col("text").alias("code"))


def shared_findings(spark: SparkSession, sf: str) -> DataFrame:
    """Lines that open with an article, as findings of those files."""
    lines = split_statements(table(spark, sf, "documents").select("doc_id", "text"))
    return lines.filter(F.rlike("context", F.lit(RULES[1]["pattern"]))).select(
        F.concat(F.lit("f"), F.floor(F.col("doc_id") / 8).cast("string")).alias("file"),
        "context", F.lit("CWE-20").alias("cwe"))


SHARED = f"""WITH sf_fun AS (SELECT DISTINCT 'f' || (doc_id // 8) AS file, text AS code FROM documents),
sf_parts AS (SELECT doc_id, {lines_sql("text")} AS parts FROM documents),
sf_line AS (SELECT doc_id, UNNEST(parts) AS context FROM sf_parts),
sf_find AS (SELECT DISTINCT 'f' || (doc_id // 8) AS file, context, 'CWE-20' AS cwe FROM sf_line
            WHERE regexp_matches(context, {quoted(RULES[1]["pattern"])}))"""


# --- project events -----------------------------------------------------------------------------

# The step of a project that each kind of event stands for.
STEPS = {"signup": NOT_STARTED, "view": IN_PROGRESS, "click": IN_PROGRESS, "error": IN_PROGRESS,
         "purchase": COMPLETE}


def status_of_event(event_type: Column) -> Column:
    out = F.when(event_type == "signup", STEPS["signup"])
    for kind, step in list(STEPS.items())[1:]:
        out = out.when(event_type == kind, step)
    return out


def project_events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("project"), status_of_event(F.col("event_type")).alias("status"),
        "ts", "event_id", "value")


EVENTS = "WITH ev AS (SELECT CAST(user_id AS VARCHAR) AS project, CASE event_type " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in STEPS.items()) + " END AS status, ts, event_id, value FROM events)"
LATEST = EVENTS + ", latest AS (SELECT project, arg_max(status, (ts, event_id)) AS status FROM ev GROUP BY project)"
