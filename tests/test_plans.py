"""Physical plans keep the properties that matter on large inputs."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from codeloom.operators import containment as C
from codeloom.plans.inputs import statements, table

NO_PAIRS = ["label_functions", "match_passages", "projects_in_cve", "scan_rules", "refine_statements",
            "train_test_split", "oversample_minority", "tfidf", "describe_numeric", "histogram", "evaluate",
            "datasets_identical", "lookup_embeddings", "rank_align"]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NO_PAIRS)
def test_no_nested_loops(spark, sf, name):
    plan = plan_of(entry.queries()[name](spark, sf))
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_shuffled_containment_has_no_nested_loop(spark, sf):
    d = table(spark, sf, "documents")
    p = table(spark, sf, "benchmark").select(F.col("text").alias("part"))
    plan = plan_of(C.contained(d, p, "doc_id", "text", "part", max_passages=0))
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_scan_reads_needed_columns_only(spark, sf):
    plan = plan_of(statements(spark, sf).groupBy("cwe").count())
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
    plan = plan_of(table(spark, sf, "documents").filter("n_chars > 100").select("doc_id"))
    assert "PushedFilters: [IsNotNull(n_chars), GreaterThan(n_chars,100)]" in plan


def test_benign_sample_is_not_shuffled(spark, sf):
    from codeloom.operators.sampling import sample_benign_lines
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.col("text").alias("code"))
    assert "Exchange" not in plan_of(sample_benign_lines(d, "doc_id"))
