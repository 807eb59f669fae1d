"""Query of periodic run detection (13)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import periodic_runs
from codeloom.llm.common import WORD, let, query, table


def planted(documents: DataFrame) -> DataFrame:
    """``(doc_id, text)`` with a period planted in the texts whose id's CRC-32 is divisible by ten.

    From word a on, word i becomes the original word a + (i - a) mod p. A null id plants nothing.
    """
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def again(w):
        n = F.size(w)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        tail = F.transform(F.sequence(F.lit(0), n - a - 1), lambda i: F.element_at(w, (a + i % p + 1).cast("int")))
        return F.when(n > 0, F.array_join(F.concat(F.slice(w, F.lit(1), a), tail), " "))

    return documents.select("doc_id", F.when((h % 10 == 0) & F.col("text").isNotNull(), let(words, again)).otherwise(
        F.col("text")).alias("text"))


@query("op13_periodic_runs")
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of all documents, some of which get a period planted."""
    found = periodic_runs.find_runs(planted(table(spark, sf_dir, "documents")))
    # The greatest exact length / period: a / b > c / d as a d > c b.
    better = lambda x, y: (x["length"] * y["period"]) > (y["length"] * x["period"])
    none = F.lit(None).cast("struct<start: long, length: long, period: long>")
    best = F.aggregate("runs", none, lambda x, y: F.when(x.isNull() | better(y, x), y).otherwise(x))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.floor(F.expr("1000 * best.length div best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
