"""Building blocks that keep the other operators exact and evenly spread."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.session import ensure_checkpoint_dir

# 2**16 hash slices: enough to keep each one small on very large tables, and a slice table of
# that many rows is a safe broadcast.
HASH_SLICES = 1 << 16


def spread_small(df: DataFrame) -> DataFrame:
    """Give costly row work more tasks when the input has fewer splits than there are cores.

    Small tables come as one file with one row group. Inputs with enough splits are left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def bounded_parts(df: DataFrame, key: str, size: Column, most: int) -> DataFrame:
    """Rows ``(key, parts)`` for the keys whose sizes sum up to more than ``most``: in how many parts of
    about that size to deal their rows. Other keys need one part and have no row."""
    sums = df.groupBy(key).agg(F.sum(size.cast("long")).alias("_size")).filter(F.col("_size") > most)
    return sums.select(key, F.ceil(F.col("_size") / most).alias("parts"))


def seeded_hash(seed: int | str, *cols: str | Column) -> Column:
    """Hex md5 of ``seed:col:col``: one sampling order that every engine can reproduce."""
    parts = [F.lit(str(seed))] + [(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols]
    return F.md5(F.concat_ws(":", *parts))


def keep_lowest(df: DataFrame, order_hash: Column, wanted: DataFrame,
                group: Sequence[str] = ()) -> DataFrame:
    """Flag exactly the ``wanted`` rows with the lowest hash, per group, as boolean ``taken``.

    ``wanted`` holds one row per group: the group columns and ``n_wanted``. Rows are counted per
    hash slice (map-side combined), running totals over the slices find the one slice in which the
    limit falls, and only that slice is ranked. No window ever sees a whole group.
    """
    group = list(group)
    sliced = df.withColumn("__h", order_hash).withColumn(
        "__slice", F.conv(F.substring("__h", 1, 4), 16, 10).cast("int"))
    totals = Window.partitionBy(*group).orderBy("__slice").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    per_slice = (
        sliced.groupBy(*group, "__slice").agg(F.count("*").alias("__n"))
        .withColumn("__below", F.sum("__n").over(totals) - F.col("__n"))
    )
    if group:
        per_slice = per_slice.join(wanted, group)
    else:
        per_slice = per_slice.withColumn("n_wanted", wanted.select("n_wanted").scalar())
    at_limit = (F.col("__below") < F.col("n_wanted")) & (
        F.col("__below") + F.col("__n") >= F.col("n_wanted"))
    # One row per group. No cut slice means the group wants nothing, or all it has.
    limits = per_slice.groupBy(*group).agg(
        F.max(F.when(at_limit, F.struct(
            F.col("__slice").alias("slice"),
            (F.col("n_wanted") - F.col("__below")).alias("left")))).alias("cut"),
        F.max("n_wanted").alias("want"))
    packed = F.struct("cut", "want")
    if group:
        tagged = sliced.join(limits.select(*group, packed.alias("__limit")), group)
    else:
        tagged = sliced.withColumn("__limit", limits.select(packed).scalar())
    tagged = tagged.select(
        "*", F.col("__limit.cut.slice").alias("__cut"), F.col("__limit.cut.left").alias("__left"),
        F.col("__limit.want").alias("__want")).drop("__limit")
    edge = F.col("__slice") == F.col("__cut")
    rank = Window.partitionBy(*group, "__slice").orderBy("__h")
    ranked = tagged.filter(edge).withColumn("taken", F.row_number().over(rank) <= F.col("__left"))
    others = tagged.filter(~edge | F.col("__cut").isNull()).withColumn(
        "taken", F.when(F.col("__cut").isNotNull(), F.col("__slice") < F.col("__cut"))
        .otherwise(F.coalesce(F.col("__want"), F.lit(0)) > 0))
    return ranked.unionByName(others).drop("__h", "__slice", "__cut", "__left", "__want")


def _in_sorted_slices(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Range-sort once, number the rows inside each range, and persist that layout reliably."""
    ensure_checkpoint_dir(df.sparkSession)
    spread = df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id())
    return (
        spread.checkpoint()
        .withColumn("__range", F.shiftright("__at", 33))
        .withColumn("__pos", F.col("__at").bitwiseAND((1 << 33) - 1))
        .drop("__at")
    )


def _offsets(ranges: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """Exclusive running totals over the ranges: one row per range, so one small window."""
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    per_range = ranges.groupBy("__range").agg(*[c.alias(name) for name, c in sums.items()])
    return per_range.select("__range", *[
        F.coalesce(F.sum(name).over(before), F.lit(0)).alias(f"__before_{name}") for name in sums])


def global_row_number(df: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """Exact 1-based rank in a total order, without a single-partition window."""
    ranges = _in_sorted_slices(df, order)
    offsets = _offsets(ranges, {"n": F.count("*")})
    return (
        ranges.join(F.broadcast(offsets), "__range")  # one row per sort range
        .withColumn(name, F.col("__before_n") + F.col("__pos") + 1)
        .drop("__range", "__pos", "__before_n")
    )


def running_totals(df: DataFrame, order: Sequence[Column], sums: dict[str, str]) -> DataFrame:
    """Inclusive running sums (``{new_name: column}``) in a total order, range by range."""
    ranges = _in_sorted_slices(df, order)
    offsets = _offsets(ranges, {name: F.sum(col) for name, col in sums.items()})
    inside = Window.partitionBy("__range").orderBy("__pos").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    out = ranges.join(F.broadcast(offsets), "__range")
    for name, col in sums.items():
        out = out.withColumn(name, F.sum(col).over(inside) + F.col(f"__before_{name}"))
    return out.drop("__range", "__pos", *[f"__before_{name}" for name in sums])
