"""Incremental scans as Structured Streaming jobs.

Every sink is idempotent per micro-batch, so a replayed batch after a failure leaves one copy.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators.findings import scan_rules, split_statements
from codeloom.operators.refine import dedup_keep_first, refine_dataset, refine_key
from codeloom.streaming.buckets import BUCKET, BUCKETS, read_buckets, update_buckets


def stream_scan(sources: DataFrame, rules: Sequence[dict[str, str]], out: str, checkpoint: str,
                file: str = "path", text: str = "text"):
    """Findings of every source row not seen before, appended to Parquet. Runs until the input that
    is there now is used up; the checkpoint remembers what was read."""
    lines = split_statements(sources.select(F.col(file).alias("file"), F.col(text).alias("text")), first=1)
    return (
        scan_rules(lines, rules).writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", checkpoint).option("path", out)
        .trigger(availableNow=True).start()
    )


def stream_refine(rows: DataFrame, refined: str, checkpoint: str, order: Sequence[str] = (),
                  buckets: int = BUCKETS):
    """Keep a refined table (see ``read_buckets``) up to date with a stream of labelled rows.

    Each micro-batch is refined together with what is in the buckets of its keys; other buckets are
    neither read nor written. Refining is idempotent and drops no label that could still matter, so
    refining parts first does not change the outcome. A batch's own copies go first, so that no key is large;
    then its rows and the old ones are dealt once by bucket, to be refined and written there.
    """
    def merge(fresh: DataFrame, old: DataFrame | None) -> DataFrame:
        both = fresh if old is None else old.unionByName(fresh)
        return refine_dataset(both.repartition(BUCKET), order, within=[BUCKET])

    def on_batch(batch: DataFrame, number: int) -> None:
        key = refine_key(batch)
        by = list(order) or [c for c in batch.columns if c not in (key, "cwe")] or ["cwe"]
        update_buckets(dedup_keep_first(batch, [key, "cwe"], by), refined, number, key, merge, buckets, dealt=True)

    return (
        rows.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def stream_status(events: DataFrame, out: str, checkpoint: str, *order: str, buckets: int = BUCKETS):
    """Latest status per project as running state, kept in a table: each batch rewrites the buckets of
    the projects that changed."""
    state = events.groupBy("project").agg(F.max_by("status", F.struct(*order)).alias("status"))

    def newest(fresh: DataFrame, old: DataFrame | None) -> DataFrame:
        if old is None:
            return fresh
        both = old.withColumn("_new", F.lit(0)).unionByName(fresh.withColumn("_new", F.lit(1)))
        return both.groupBy("project").agg(F.max_by("status", "_new").alias("status"))

    def on_batch(batch: DataFrame, number: int) -> None:
        update_buckets(batch, out, number, "project", newest, buckets)

    return (
        state.writeStream.outputMode("update").foreachBatch(on_batch)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def current_status(spark: SparkSession, out: str) -> DataFrame:
    """State of each project as ``stream_status`` keeps it; its cost follows the projects, not the batches."""
    return read_buckets(spark, out, "project string, status string")
