"""Query of personal data (9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import personal_data
from codeloom.llm.common import query, table


@query("op9_personal_data")
def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: counts of base spans, their digest, and all spans."""
    documents = table(spark, sf_dir, "documents")
    found = personal_data.find(documents, personal_data.train(documents))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [F.size(F.array_remove(kinds, other)) for other in personal_data.BASE_KINDS]
    counts = [(F.size(kinds) - left).cast("long").alias(f"n_{k}") for k, left in zip(personal_data.BASE_KINDS, counts)]
    return found.select(
        "doc_id", *counts, F.sha2(personal_data.joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        personal_data.joined(F.col("spans")).alias("spans"))
