"""The extraction job: sources and findings to refined statement and function tables."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from codeloom.functions.cfunctions import extract_functions, functions_in
from codeloom.functions.text import has_statement
from codeloom.operators.findings import (
    append_benign, attach_context, explode_findings, filter_statement_context, findings_in_text, normalize_findings,
    prefix_cwe)
from codeloom.operators.labelling import (
    BLOCK_FINDINGS, PART_CHARS, Matcher, identified, label_functions, squeezed)
from codeloom.operators.projects import (
    COMPLETE, filter_todo_projects, register_projects, remaining_files, set_status)
from codeloom.operators.refine import refine_dataset
from codeloom.operators.sampling import sample_benign_lines
from codeloom.schemas import BENIGN, FINDING_COLUMNS
from codeloom.session import staged
from codeloom.sources.tables import read_table, replace_table, table_exists


ORDER = {"statements": ["project", "file", "line", "name"], "functions": ["project", "file", "context"]}


class Extraction(NamedTuple):
    statements: DataFrame
    functions: DataFrame
    projects: DataFrame
    scanned: DataFrame


# Rows that the cutting step turns into Python objects at a time.
_SLICE_ROWS = 64

_FUNCTIONS = T.ArrayType(T.StructType([
    T.StructField("code", T.StringType()),
    T.StructField("sample", T.ArrayType(T.StringType())),
    T.StructField("labels", T.ArrayType(T.StructType([
        T.StructField("context", T.StringType()), T.StructField("cwe", T.StringType())]))),
]))


def _benign_sample(file: str, code: str, threshold: int, ratio: float, seed: int) -> list[str]:
    """The lines that ``sample_benign_lines`` takes of a function."""
    fun = hashlib.md5(f"{file}\n{code}".encode("utf-8", "surrogatepass")).hexdigest()
    order = sorted((hashlib.md5(f"{seed}:{fun}:{i}".encode()).hexdigest(), line)
                   for i, line in enumerate(code.splitlines()) if len(line) > threshold)
    return [re.sub(r"\s+", " ", line).strip() for _, line in order[:int(len(order) * ratio)]]


def _labels(matcher: Matcher, code: str) -> list[dict[str, str]]:
    """One label per weakness, by its least context, and ``Benign`` if no label sorts after it: refining keeps no other."""
    hits = matcher.hits(squeezed(code))
    best: dict[str, str] = {}
    for context, cwe in map(matcher.findings.__getitem__, hits):
        best[cwe] = min(best.get(cwe, context), context)
    if len(hits) < len(matcher.findings) and not any(cwe is not None and cwe > BENIGN for cwe in best):
        best[BENIGN] = ""
    return [{"context": context, "cwe": cwe} for cwe, context in best.items()]


def cut_and_label(sources: DataFrame, rules: Sequence[dict[str, str]], mark: str = ";", threshold: int = 5,
                  ratio: float = 0.25, seed: int = 41) -> DataFrame:
    """(file, project, found, functions) of the sources (path, text, project) in which a rule matches.

    ``found`` is the array of findings; ``functions`` the distinct functions with their labels and, if a
    finding of the file is a statement, their sampled benign lines. All of it is made inside the row of
    the source, so its text is read once and never shuffled.
    """
    rows = sources.select(
        F.col("path").alias("file"), "project", "text", findings_in_text(F.col("text"), rules).alias("found"))
    # Sources without findings go below and without their text: a filter here would search every text once more.
    rows = rows.withColumn("pairs", F.array_distinct(F.transform(
        "found", lambda x: F.struct(x["context"].alias("context"), x["rule"]["cwe"].alias("cwe"))))).withColumn(
        "text", F.when(F.size("found") > 0, F.col("text")))
    return _cut(rows, ["file", "project", "found"], mark, threshold, ratio, seed)


def _cut(rows: DataFrame, keep: Sequence[str], mark: str, threshold: int, ratio: float, seed: int) -> DataFrame:
    """(*keep, functions) of the rows (file, text, pairs, *keep) that have a text; ``pairs`` are the findings
    (context, cwe) of the file."""
    schema = T.StructType([*(rows.schema[c] for c in keep), T.StructField("functions", _FUNCTIONS)])
    arrow = to_arrow_schema(schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _SLICE_ROWS):
                part = batch.slice(at, _SLICE_ROWS)
                part = part.filter(pc.is_valid(part.column("text")))
                out = []
                for file, text, pairs in zip(*(part.column(c).to_pylist() for c in ("file", "text", "pairs"))):
                    matcher = Matcher((p["context"], p["cwe"]) for p in pairs)
                    sampled = any(mark in p["context"] for p in pairs)
                    out.append([
                        {"code": code, "labels": _labels(matcher, code),
                         "sample": _benign_sample(file, code, threshold, ratio, seed) if sampled else []}
                        for code in dict.fromkeys(code for _, code in functions_in(text))])
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in keep), pa.array(out, type=arrow.field("functions").type)], schema=arrow)

    return rows.select(*dict.fromkeys(["file", *keep, "text", "pairs"])).mapInArrow(cut, schema)


def _sampled_lines(cut: DataFrame) -> DataFrame:
    lines = cut.select("file", "project", F.explode("functions.sample").alias("s")).select(
        "file", "project", F.explode("s").alias("context"))
    return lines.select(
        "file", "project", F.lit("unknown").alias("line"), "context", F.lit(BENIGN).alias("cwe"), F.lit("sampling").alias("tool"))


def _statement_rows(cut: DataFrame, mark: str) -> DataFrame:
    """Findings with a statement mark, and the sampled benign lines."""
    marked = cut.withColumn("found", F.filter("found", lambda x: has_statement(x["context"], mark)))
    return append_benign(explode_findings(marked, "found", extra=["project"]), _sampled_lines(cut))


def _function_rows(cut: DataFrame) -> DataFrame:
    return cut.select("file", "project", F.inline("functions")).select(
        "file", "code", "project", F.inline("labels")).select("file", "code", "context", "cwe", "project")


def label_sources(sources: DataFrame, findings: DataFrame, mark: str = ";", threshold: int = 5,
                  ratio: float = 0.25, seed: int = 41) -> tuple[DataFrame, DataFrame]:
    """Unrefined (statements, functions) of sources (path, text, project).

    Functions come from files with findings and are labelled by all of them. Statements are the
    findings with a statement mark, and benign lines of the functions in files that have such a
    finding. Equal functions of a file give equal samples, so each is sampled once. Functions are
    cut out of the sources once and staged, because labelling and sampling both read them.
    """
    with_findings = findings.select(F.col("file").alias("path")).distinct()
    bodies = staged(identified(extract_functions(
        sources.join(with_findings, "path", "left_semi"), keep=["project"]), ["project"]), "functions")
    functions = label_functions(bodies, findings, carry=["project"])

    kept = filter_statement_context(findings, mark)
    sampled = sample_benign_lines(
        bodies.join(kept.select("file").distinct(), "file", "left_semi"), "_fun", threshold, ratio, seed)
    statements = append_benign(kept.select(*FINDING_COLUMNS, "project"), sampled.drop("_fun"))
    return statements, functions


def label_reported(sources: DataFrame, findings: DataFrame, mark: str = ";", threshold: int = 5, ratio: float = 0.25,
                   seed: int = 41, most: int = BLOCK_FINDINGS, chars: int = PART_CHARS) -> tuple[DataFrame, DataFrame]:
    """What ``label_sources`` gives, but for rows that refining drops, with each source's text moved once.

    The findings of a file travel to its row, where functions are cut, labelled and sampled. Files with more than
    ``most`` findings or ``chars`` characters go by ``label_sources``, which holds no file whole.
    """
    files = findings.select(F.col("file").alias("path"))
    large = files.groupBy("path").agg(F.count("*").alias("n")).filter(F.col("n") > most).select("path").unionByName(
        sources.filter(F.length("text") > chars).select("path")).distinct()
    large = staged(large.join(files, "path", "left_semi"), "large")
    some = not large.isEmpty()
    small, few = sources, findings
    if some:
        small = sources.join(large, "path", "left_anti")
        few = findings.join(large.withColumnRenamed("path", "file"), "file", "left_anti")
    pairs = few.groupBy("file").agg(F.collect_set(F.struct("context", "cwe")).alias("pairs"))
    rows = small.withColumnRenamed("path", "file").select("file", "project", "text").join(pairs, "file")
    cut = staged(_cut(rows, ["file", "project"], mark, threshold, ratio, seed), "cut", compression="zstd")
    kept = filter_statement_context(few, mark).select(*FINDING_COLUMNS, "project")
    statements, functions = append_benign(kept, _sampled_lines(cut)), _function_rows(cut)
    if some:
        more = label_sources(
            sources.join(large, "path", "left_semi"),
            findings.join(large.withColumnRenamed("path", "file"), "file", "left_semi"), mark, threshold, ratio, seed)
        statements, functions = statements.unionByName(more[0]), functions.unionByName(more[1].select(*functions.columns))
    return statements, functions


def run_extraction(sources: DataFrame, rules: Sequence[dict[str, str]],
                   projects: DataFrame | None = None, scanned: DataFrame | None = None,
                   **options) -> Extraction:
    """The whole job: register projects, take the files still to do, find, label, sample, refine, and
    mark the projects complete. ``scanned`` lists files (``file``) done before; the result's lists
    these and the ones done now, whether or not anything was found in them."""
    registered = register_projects(sources.select("project"), projects)
    left = sources
    if projects is not None:
        left = left.join(filter_todo_projects(registered).select("project"), "project", "left_semi")
    if scanned is not None:
        left = remaining_files(left.withColumnRenamed("path", "file"), scanned).withColumnRenamed(
            "file", "path")
    cut = staged(cut_and_label(left, rules, **options), "cut")
    statements, functions = _statement_rows(cut, options.get("mark", ";")), _function_rows(cut)
    return _extraction(left, registered, scanned, statements, functions)


def extraction_from_reports(sources: DataFrame, flawfinder: DataFrame | None = None, cppcheck: DataFrame | None = None,
                            rats: DataFrame | None = None, projects: DataFrame | None = None, rats_context: bool = False,
                            **options) -> Extraction:
    """The whole job with the findings of analyzers in place of rules; reports as their readers give them.

    CppCheck's weaknesses get their prefix and its findings the line they point at, RATS' findings
    only with ``rats_context`` (without one they label nothing); then all have one schema. Findings in
    files that ``sources`` (path, text, project) lacks are left out.
    """
    if cppcheck is not None:
        cppcheck = attach_context(prefix_cwe(cppcheck), sources)
    if rats is not None and rats_context:
        rats = attach_context(rats, sources)
    known = sources.select(F.col("path").alias("file"), "project").distinct()
    findings = staged(normalize_findings(flawfinder, cppcheck, rats).join(known, "file"), "findings", compression="zstd")
    statements, functions = label_reported(sources, findings, **options)
    return _extraction(sources, register_projects(sources.select("project"), projects), None, statements, functions, labelled=True)


def _extraction(left: DataFrame, registered: DataFrame, scanned: DataFrame | None, statements: DataFrame,
                functions: DataFrame, labelled: bool = False) -> Extraction:
    done = left.select("project").distinct().withColumn("status", F.lit(COMPLETE))
    files = left.select(F.col("path").alias("file"))
    if scanned is not None:
        files = files.unionByName(scanned.select("file"))
    return Extraction(
        refine_dataset(statements, order=ORDER["statements"], labelled=labelled),
        refine_dataset(functions, order=ORDER["functions"], labelled=labelled),
        set_status(registered, done), files.distinct())


def save_extraction(result: Extraction, root: str) -> Extraction:
    """Write the tables as new versions below ``root`` and read them back.

    Statements and functions of earlier runs stay: old and new rows are refined together, which
    gives what one run over all sources gives. Projects and scanned files replace the old ones,
    with rows that only the old ones have.
    """
    spark = result.statements.sparkSession
    saved = []
    for name, df in zip(Extraction._fields, result):
        path = f"{root}/{name}"
        old = load_table(spark, path, df.schema)
        if old is not None and name in ORDER:
            df = refine_dataset(old.unionByName(df), order=ORDER[name])
        elif old is not None:
            key = "project" if name == "projects" else "file"
            df = df.unionByName(old.join(df.select(key), key, "left_anti"))
        replace_table(df, path)
        saved.append(read_table(spark, path))
    return Extraction(*saved)


def load_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame | None:
    """A table of an earlier run, None if there is none."""
    return read_table(spark, path, schema) if table_exists(spark, path) else None
