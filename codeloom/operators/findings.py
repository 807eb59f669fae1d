"""Analyzer findings in one schema, and findings from caller-supplied rules."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.text import has_statement, split_lines, trim_space
from codeloom.schemas import BENIGN, FINDING_COLUMNS, MISSING, REPORT_ONLY_COLUMNS, UNKNOWN_CWE


def split_statements(df: DataFrame, text: str = "text", first: int = 0,
                     line: str = "line", context: str = "context") -> DataFrame:
    """One row per line; ``first`` is the number of the first line."""
    others = [c for c in df.columns if c != text]
    return df.select(*others, F.posexplode(split_lines(F.col(text))).alias("_n", context)).select(
        *others, (F.col("_n") + first).alias(line), context)


def prefix_cwe(df: DataFrame, unknown_for_null: bool = False) -> DataFrame:
    """``CWE-`` before each number. A file whose findings name no weakness gets ``CWE-unknown``;
    a null beside a number stays null, or becomes unknown with ``unknown_for_null``.

    Only rows without a number need to know about their file, so only they are joined.
    """
    named = df.filter(F.col("cwe").isNotNull()).withColumn("cwe", F.concat(F.lit("CWE-"), "cwe"))
    bare = df.filter(F.col("cwe").isNull())
    if unknown_for_null:
        return named.unionByName(bare.withColumn("cwe", F.lit(UNKNOWN_CWE)))
    files = df.filter(F.col("cwe").isNotNull()).select("file", F.lit(True).alias("_named")).distinct()
    bare = bare.join(files, "file", "left").withColumn(
        "cwe", F.when(F.col("_named").isNull(), F.lit(UNKNOWN_CWE))).drop("_named")
    return named.unionByName(bare.select(*df.columns))


# Line numbers that are looked up in one row at a time.
LINE_BLOCK = 4096


def attach_context(findings: DataFrame, sources: DataFrame, file: str = "path",
                   text: str = "text") -> DataFrame:
    """The text of line ``line`` (1-based) of each finding's file; ``''`` where there is no such line.

    The numbers asked for in a file travel to its row, in blocks of at most ``LINE_BLOCK``, and only the
    lines asked for leave it.
    """
    at = F.col("line").cast("int")
    wanted = findings.select("file", at.alias("_at")).filter("_at > 0").groupBy(
        "file", F.floor(F.col("_at") / LINE_BLOCK).alias("_block")).agg(F.collect_set("_at").alias("_wanted"))
    texts = sources.select(F.col(file).alias("file"), F.col(text).alias("_text")).join(wanted.drop("_block"), "file")
    pick = lambda lines: F.transform("_wanted", lambda n: F.struct(n.alias("_at"), F.get(lines, n - 1).alias("_line_text")))
    found = F.transform(F.array(split_lines(F.col("_text"))), pick)[0]  # the text is split once
    return (
        findings.drop("context").withColumn("_at", at)
        .join(texts.select("file", F.inline(found)), ["file", "_at"], "left")
        .withColumn("context", F.coalesce("_line_text", F.lit("")))
        .drop("_at", "_line_text")
    )


def _lower_names(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({c: c.lower() for c in df.columns})


def flawfinder_columns(df: DataFrame) -> DataFrame:
    df = _lower_names(df).withColumnsRenamed({"cwes": "cwe", "warning": "msg"})
    return df.withColumn("note", F.concat_ws("  ", "suggestion", "note"))


def cppcheck_columns(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({"info": "note", "id": "name"}).drop("verbose")


def rats_columns(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({"message": "msg", "type": "category"})


def union_findings(*reports: DataFrame) -> DataFrame:
    """All rows of all reports; a column that a report lacks is null there."""
    first, *others = reports
    for other in others:
        first = first.unionByName(other, allowMissingColumns=True)
    return first


def to_finding_schema(df: DataFrame) -> DataFrame:
    """The 15 columns as text: rows without line or cwe dropped, gaps marked, context trimmed."""
    df = df.drop(*REPORT_ONLY_COLUMNS)
    have = {c: F.col(f"`{c}`").cast("string") for c in df.columns}
    df = df.filter(F.col("line").isNotNull() & F.col("cwe").isNotNull())
    return df.select(*[
        F.coalesce(have[c], F.lit(MISSING)).alias(c) if c in have else F.lit(MISSING).alias(c)
        for c in FINDING_COLUMNS
    ]).withColumn("context", trim_space(F.col("context")))


def normalize_findings(flawfinder: DataFrame | None = None, cppcheck: DataFrame | None = None,
                       rats: DataFrame | None = None) -> DataFrame:
    parts = []
    if flawfinder is not None:
        parts.append(flawfinder_columns(flawfinder))
    if cppcheck is not None:
        parts.append(cppcheck_columns(cppcheck))
    if rats is not None:
        parts.append(rats_columns(rats))
    if not parts:
        raise ValueError("no report given")
    return to_finding_schema(union_findings(*[
        p.select(*[F.col(c).cast("string").alias(c) for c in p.columns]) for p in parts]))


def filter_statement_context(findings: DataFrame, mark: str = ";") -> DataFrame:
    return findings.filter(has_statement(F.col("context"), mark))


def append_benign(findings: DataFrame, benign: DataFrame) -> DataFrame:
    return findings.unionByName(benign, allowMissingColumns=True)


RULE_COLUMNS = ["name", "pattern", "cwe", "level", "category", "msg"]


def rules_from(df: DataFrame) -> list[dict[str, str]]:
    """Rules table to rule list: the configuration of a scan, which every task gets whole."""
    rows = df.select(*RULE_COLUMNS).collect()
    return sorted((r.asDict() for r in rows), key=lambda r: (r["name"], r["pattern"]))


def _any_rule(text: Column, rules: Sequence[dict[str, str]]) -> Column:
    # Names of groups may repeat among rules; to find out whether any rule matches they don't matter.
    patterns = [re.sub(r"\(\?<[a-zA-Z][a-zA-Z0-9]*>", "(", r["pattern"]) for r in rules]
    if any(re.search(r"\\[1-9]|\\k<|\(\?[a-zA-Z]+\)", p) for p in patterns):
        return F.lit(True)  # back-references and global flags do not survive being joined
    return F.rlike(text, F.lit("|".join(f"(?:{p})" for p in patterns)))


def _rule_table(rules: Sequence[dict[str, str]]) -> Column:
    if not rules:
        raise ValueError("no rules given")
    return F.from_json(
        F.lit(json.dumps([{c: r[c] for c in RULE_COLUMNS} for r in rules])),
        "array<struct<" + ", ".join(f"{c}: string" for c in RULE_COLUMNS) + ">>")


def _rule_findings(rows: DataFrame, text: Column, rule: str, tool: str, extra: Sequence[str]) -> DataFrame:
    """Finding rows (file, line, *extra) of a matched rule; ``text`` is the line."""
    return rows.select(*[
        {
            "file": F.col("file"), "line": F.col("line").cast("string"),
            "context": text, "tool": F.lit(tool),
            "name": F.col(f"{rule}.name"), "cwe": F.col(f"{rule}.cwe"), "level": F.col(f"{rule}.level"),
            "category": F.col(f"{rule}.category"), "msg": F.col(f"{rule}.msg"),
        }.get(c, F.lit(MISSING)).alias(c)
        for c in FINDING_COLUMNS], *extra)


def scan_rules(lines: DataFrame, rules: Sequence[dict[str, str]], tool: str = "rules") -> DataFrame:
    """Findings for every (line, rule) that matches, from lines (file, line, context, ...).

    One combined pattern discards most lines; the rest test the rules one by one inside the row. The
    rules are data (one constant array), so plans are as small for thousands of rules as for three.
    Other input columns are passed on.
    """
    text = F.col("context")
    hits = F.filter(_rule_table(rules), lambda r: F.rlike(text, r["pattern"]))
    extra = [c for c in lines.columns if c not in FINDING_COLUMNS]
    found = (
        lines.filter(_any_rule(text, rules))
        .select("file", "line", "context", *extra,
                F.explode(hits).alias("_rule"))
    )
    return _rule_findings(found, trim_space(text), "_rule", tool, extra)


def findings_in_text(text: Column, rules: Sequence[dict[str, str]]) -> Column:
    """What ``scan_rules`` finds in the lines of a whole text, as an array of (line, context, rule) in the
    text's own row; lines count from 1."""
    known = _rule_table(rules)
    lines = F.transform(split_lines(text), lambda s, i: F.struct((i + 1).alias("line"), s.alias("raw")))
    some = F.filter(lines, lambda x: _any_rule(x["raw"], rules))
    return F.flatten(F.transform(some, lambda x: F.transform(
        F.filter(known, lambda r: F.rlike(x["raw"], r["pattern"])),
        lambda r: F.struct(x["line"].alias("line"), trim_space(x["raw"]).alias("context"), r.alias("rule")))))


def explode_findings(rows: DataFrame, found: str, tool: str = "rules", extra: Sequence[str] = ()) -> DataFrame:
    """The findings of a column of ``findings_in_text`` as rows, with the rows' ``file`` and ``extra``."""
    return _rule_findings(rows.select("file", *extra, F.inline(found)), F.col("context"), "rule", tool, extra)


def vulnerable(df: DataFrame) -> DataFrame:
    return df.filter(F.col("cwe") != BENIGN)


def benign(df: DataFrame) -> DataFrame:
    return df.filter(F.col("cwe") == BENIGN)
