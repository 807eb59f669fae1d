"""Query of the quality classifier (3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codeloom.llm import weak_labels
from codeloom.llm.common import query, table


@query("op3_quality_classifier")
def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learnt from all documents without labels."""
    documents = table(spark, sf_dir, "documents")
    return weak_labels.classify(documents, weak_labels.train(documents))
