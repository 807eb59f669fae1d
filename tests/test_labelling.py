"""Labels by automaton, and the extraction that makes them inside the source's row."""

import random

import pytest
from pyspark.sql import functions as F

from codeloom.operators import labelling as L
from codeloom.operators.findings import attach_context, scan_rules, split_statements
from codeloom.operators.refine import refine_dataset
from codeloom.plans import extraction
from codeloom.plans.inputs import RULES, c_sources
from compare import rows
from test_containment import fixture

FUNS = [("a.c", "int f(){ gets(s); }"), ("a.c", "int g(){ return 0; }"), ("b.c", "int h(){}")]


def label(spark, findings, **options):
    return rows(L.label_functions(
        spark.createDataFrame(FUNS, "file string, code string"),
        spark.createDataFrame(findings, "file string, context string, cwe string"), **options))


def test_label_functions(spark):
    got = label(spark, [("a.c", "gets( s );", "CWE-120"), ("a.c", "return 1;", "CWE-20")])
    assert got == sorted([
        (*FUNS[0], "gets( s );", "CWE-120"), (*FUNS[0], "", "Benign"), (*FUNS[1], "", "Benign")], key=repr)


def test_label_functions_edges(spark):
    assert label(spark, [("a.c", "-", "CWE-1")]) == sorted(
        [(*FUNS[0], "", "Benign"), (*FUNS[1], "", "Benign")], key=repr)
    # Blank contexts of two or more characters occur everywhere; one finding matched by all.
    assert label(spark, [("b.c", "  ", "CWE-1")]) == [(*FUNS[2], "  ", "CWE-1")]
    # A finding without a context counts as one that no function holds; files without functions give nothing.
    assert label(spark, [("b.c", None, "CWE-1"), (None, "int", "CWE-1"), ("z.c", "int", "CWE-1")]) == [(*FUNS[2], "", "Benign")]
    assert label(spark, [("z.c", "int", "CWE-1")]) == []


@pytest.mark.parametrize(("part_chars", "block"), [(L.PART_CHARS, L.BLOCK_FINDINGS), (200, 3)])
def test_label_functions_equals_all_pairs(spark, monkeypatch, part_chars, block):
    texts, passages = fixture(5)
    funs = [(f, b) for f, _, b in texts] * 2
    finds = [(f, p, "CWE-%d" % (i % 4)) for i, (f, p) in enumerate(passages)] + [(f, p, "CWE-9") for f, p in passages[:20]]
    want = set()
    for file, code in funs:
        for f, context, cwe in finds:
            if f == file:
                hit = len(context) > 1 and "".join(context.split()) in "".join(code.split())
                want.add((file, code, context, cwe) if hit else (file, code, "", "Benign"))
    got = L.label_functions(
        spark.createDataFrame(funs, "file string, code string"),
        spark.createDataFrame(finds, "file string, context string, cwe string"), part_chars=part_chars, block=block)
    assert rows(got) == sorted(want, key=repr)


def test_equal_statements_form_no_pairs(spark):
    """Very many functions and findings of one file: what is shuffled is their sum, not their product."""
    funs = spark.range(400).select(F.when(F.col("id") >= 0, "hot.c").alias("file"), F.concat(F.lit("int f"), "id", F.lit("(){ g(x); }")).alias("code"))
    finds = spark.range(300).select(F.when(F.col("id") >= 0, "hot.c").alias("file"), F.concat(F.lit("h("), "id", F.lit(");")).alias("context"),
                                    F.lit("CWE-1").alias("cwe"))
    got = L.label_functions(funs, finds, part_chars=2000)
    assert got.count() == 400 and {r.cwe for r in got.collect()} == {"Benign"}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
    parts = -(-400 * 17 // 2000)
    assert got.withColumn("p", F.spark_partition_id()).select("p").distinct().count() <= parts + 1


def test_carried_columns_follow_their_file(spark):
    funs = spark.createDataFrame([(f, c, i, f.upper()) for i, (f, c) in enumerate(FUNS)], "file string, code string, n int, project string")
    finds = spark.createDataFrame([("a.c", "gets(s);", "CWE-1")], "file string, context string, cwe string")
    got = L.label_functions(funs, finds, carry=["project"])
    assert got.columns == ["file", "code", "context", "cwe", "project"] and {r.project for r in got.collect()} == {"A.C"}


def _slow_job(sources):
    """The steps one by one, as tables: findings, functions, labels, samples."""
    lines = split_statements(sources.select(F.col("path").alias("file"), "project", "text"), first=1)
    return extraction.label_sources(sources, scan_rules(lines, RULES))


def test_rows_of_a_source_equal_the_steps(spark, sf):
    sources = c_sources(spark, sf).drop("doc_id")
    cut = extraction.cut_and_label(sources, RULES)
    plan = cut._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "Join" not in plan  # the given small table is spread over the cores first
    cut = cut.cache()
    mine = extraction._statement_rows(cut, ";"), extraction._function_rows(cut)
    for got, want, order in zip(mine, _slow_job(sources), extraction.ORDER.values()):
        assert got.columns == want.columns
        got, want = (refine_dataset(x, order) for x in (got, want))
        assert rows(got.select(*sorted(got.columns))) == rows(want.select(*sorted(want.columns)))


def test_attach_context_picks_lines(spark):
    text = "".join(f"line {i}\n" for i in range(1, 10_001))
    sources = spark.createDataFrame([("a.c", text), ("b.c", ""), ("c.c", None)], "path string, text string")
    asked = [("a.c", n) for n in (1, 4095, 4096, 8192, 10_000, 10_001, 0, -1, None, 1)] + [("b.c", 1), ("c.c", 1), ("d.c", 1)]
    got = attach_context(spark.createDataFrame(asked, "file string, line int"), sources)
    assert rows(got) == sorted(
        [(f, n, f"line {n}" if f == "a.c" and n and 0 < n <= 10_000 else "") for f, n in asked], key=repr)


def test_texts_are_searched_once(spark):
    """Findings are made once in a source's row; sources without a finding or a text give no row."""
    sources = spark.createDataFrame(
        [("a.c", "int f(void)\n{\n  open;\n}\n", "p"), ("b.c", "int g(void) { }\n", "p"), ("c.c", None, "p")],
        "path string, text string, project string")
    rules = [dict(name="o", pattern="open", cwe="CWE-1", level="1", category="c", msg="m")]
    cut = extraction.cut_and_label(sources, rules)
    plan = cut._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(?:open)") == 1
    (row,) = cut.collect()
    assert row.file == "a.c" and [f.code for f in row.functions] == ["int f(void)\n{\n  open;\n}"]


def test_reported_findings_travel_to_their_source(spark, sf):
    """Same refined rows as by the steps, also where some or all files are too large to be done in their row."""
    sources = c_sources(spark, sf).drop("doc_id").limit(40).cache()
    lines = split_statements(sources.select(F.col("path").alias("file"), "project", "text"), first=1)
    findings = scan_rules(lines, RULES).cache()
    want = extraction.label_sources(sources, findings)
    for limits in ({}, {"most": 3}, {"chars": 10}):
        for got, steps, order in zip(extraction.label_reported(sources, findings, **limits), want, extraction.ORDER.values()):
            got = refine_dataset(got, order, labelled=True)
            assert got._jdf.queryExecution().executedPlan().toString().count("Window ") <= 1
            assert rows(got) == rows(refine_dataset(steps, order).select(*got.columns)) != []
