"""TF-IDF weights as a relation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def tfidf(df: DataFrame, doc: str, tokens: str, max_terms: int = 3000) -> DataFrame:
    """(doc, term, weight): raw term count times ln((1 + n) / (1 + df)) + 1, each document scaled to
    length 1, over the ``max_terms`` most frequent terms (ties by term).

    Token arrays move once, to the partition of their document, where terms are counted and weights
    scaled without further shuffles; only term totals travel besides. The vocabulary has at most
    ``max_terms`` rows, so it is broadcast.
    """
    by_doc = df.select(doc, F.col(tokens).alias("tokens")).repartition(doc)
    # The outer form: for the inner one Spark would compute the tokens once more to drop empty rows.
    terms = by_doc.select(doc, F.explode_outer("tokens").alias("term")).filter("term is not null")
    counts = terms.groupBy(doc, "term").agg(F.count("*").alias("tf"))
    n_docs = df.agg(F.count("*").alias("n")).scalar()
    vocabulary = (
        counts.groupBy("term").agg(F.sum("tf").alias("total"), F.count("*").alias("df"))
        .orderBy(F.desc("total"), "term").limit(max_terms)
        .select("term", (F.log((F.lit(1.0) + n_docs) / (F.lit(1.0) + F.col("df"))) + 1.0).alias("idf"))
    )
    weights = counts.join(F.broadcast(vocabulary), "term").withColumn("w", F.col("tf") * F.col("idf"))
    in_doc = Window.partitionBy(doc)  # at most max_terms rows
    return weights.select(
        doc, "term", (F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(in_doc))).alias("weight"))
