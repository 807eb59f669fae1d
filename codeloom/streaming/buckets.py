"""Tables in buckets of a key's digest, of which a micro-batch rewrites only those that it touches.

A batch writes the whole new content of its buckets below its number: ``<root>/batch=7/_bucket=19``. A
bucket's content is what the highest batch has that finished. So a trigger costs what its buckets hold, a
reader reads each row once however many batches there were, and a batch that is repeated after
a failure starts from the same state and replaces its own files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.session import staged

BUCKETS = 1024
BUCKET = "_bucket"


def _store(spark: SparkSession, root: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return path, path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _folders(spark: SparkSession, root: str, prefix: str) -> dict[int, str]:
    """Number -> path of the folders ``<prefix>=<number>`` below ``root``."""
    path, fs = _store(spark, root)
    if not fs.exists(path(root)):
        return {}
    found = {}
    for status in fs.listStatus(path(root)):
        name, _, number = status.getPath().getName().partition("=")
        if name == prefix and number.isdigit():
            found[int(number)] = f"{root}/{prefix}={number}"
    return found


def newest_buckets(spark: SparkSession, root: str, below: int | None = None) -> dict[int, str]:
    """Bucket -> folder with its content after all batches (``below`` a number) that finished."""
    path, fs = _store(spark, root)
    out: dict[int, str] = {}
    batches = _folders(spark, root, "batch")
    for number in sorted(batches, reverse=True):
        if (below is None or number < below) and fs.exists(path(f"{batches[number]}/_SUCCESS")):
            out = _folders(spark, batches[number], BUCKET) | out
    return out


def update_buckets(batch: DataFrame, root: str, number: int, key: str, merge: Callable[[DataFrame, DataFrame | None], DataFrame],
                   buckets: int = BUCKETS, keep: int = 2, dealt: bool = False) -> None:
    """Bring a table up to date with a micro-batch: ``merge(fresh, old)`` gives the new content of its buckets.

    ``old`` is None where the batch's buckets are new. Content that was replaced ``keep`` batches ago or
    earlier is deleted; readers that began before need at most as many batches to end.

    A ``dealt`` merge gets its rows with their bucket (``BUCKET``) and returns rows that are dealt by it, so they
    are moved once, to be merged and written; of another one they are dealt again to be written.
    """
    spark = batch.sparkSession
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    fresh = staged(batch.withColumn(BUCKET, bucket), "batch", compression="zstd")
    touched = [r[0] for r in fresh.select(BUCKET).distinct().collect()]  # at most ``buckets``
    known = newest_buckets(spark, root, number)
    paths = [known[b] for b in touched if b in known]
    rows = fresh.drop(BUCKET)
    old = spark.read.schema(rows.schema).parquet(*paths) if paths else None
    if dealt:
        new = merge(fresh, None if old is None else old.withColumn(BUCKET, bucket))
    else:
        new = merge(rows, old).withColumn(BUCKET, bucket).hint("rebalance", BUCKET)
    new.write.mode("overwrite").option("compression", "zstd").partitionBy(BUCKET).parquet(f"{root}/batch={number}")
    clean_buckets(spark, root, number - keep)


def clean_buckets(spark: SparkSession, root: str, upto: int) -> None:
    """Delete content that batches up to ``upto`` have replaced, and batches of which nothing is left."""
    path, fs = _store(spark, root)
    live = set(newest_buckets(spark, root, upto + 1).values())
    for number, folder in _folders(spark, root, "batch").items():
        if number <= upto:
            mine = _folders(spark, folder, BUCKET)
            for bucket in mine.values():
                if bucket not in live:
                    fs.delete(path(bucket), True)
            if not live & set(mine.values()):
                fs.delete(path(folder), True)


def read_buckets(spark: SparkSession, root: str, schema=None) -> DataFrame:
    """The table's rows after all batches that finished."""
    paths = sorted(newest_buckets(spark, root).values())
    if paths:
        reader = spark.read if schema is None else spark.read.schema(schema)
        return reader.parquet(*paths)
    if schema is None:
        raise FileNotFoundError(f"no batch has finished in {root}")
    return spark.createDataFrame([], schema)
