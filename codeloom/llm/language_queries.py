"""Query of language ID (7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import language_id
from codeloom.llm.common import query, table


@query("op7_language_id")
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from those not held out."""
    documents = table(spark, sf_dir, "documents")
    model = language_id.train(documents.filter(~language_id.held_out(F.col("doc_id"))))
    found = language_id.detect(documents, model)
    return found.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
