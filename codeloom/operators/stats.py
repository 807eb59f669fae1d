"""Dataset statistics."""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.labels import binary_name, relabel_category
from codeloom.functions.text import path_basename
from codeloom.schemas import BENIGN
from codeloom.session import staged


# --- counts -------------------------------------------------------------------------------------

def category_cwe_counts(statements: DataFrame) -> DataFrame:
    """Count per (category, name, cwe) without null keys, shown as (category, cwe, count). A pair can
    come more than once, once for each name it hides."""
    return (
        statements.select("category", "name", "cwe").dropna("any")
        .groupBy("category", "name", "cwe").agg(F.count("*").alias("count"))
        .select(relabel_category(F.col("category"), F.col("name")).alias("category"), "cwe", "count")
    )


def category_cwe_rollup(counts: DataFrame) -> DataFrame:
    """Totals per (category, cwe), per category and overall; ``level`` is 0, 1 and 3."""
    return (
        counts.groupBy("category", "cwe").agg(F.sum("count").alias("count"))
        .rollup("category", "cwe")
        .agg(F.sum("count").cast("bigint").alias("count"), F.grouping_id().cast("bigint").alias("level"))
    )


def project_label_counts(df: DataFrame, shorten: bool = True) -> DataFrame:
    project = path_basename(F.col("project")) if shorten else F.col("project")
    return (
        df.select(project.alias("project"), binary_name(F.col("cwe")).alias("cwe"))
        .groupBy("project", "cwe").agg(F.count("*").alias("count"))
    )


def project_label_pivot(counts: DataFrame, value: str = "count",
                        labels: Sequence[str] = (BENIGN, "Vulnerable")) -> DataFrame:
    return counts.groupBy("project").agg(*[
        F.sum(F.when(F.col("cwe") == x, F.col(value))).cast("bigint").alias(x) for x in labels])


def append_total(df: DataFrame, key: str = "project", total: str = "TOTAL") -> DataFrame:
    """Add a row with the column sums of a table of counts."""
    values = [c for c in df.columns if c != key]
    sums = df.agg(*[F.sum(c).cast("bigint").alias(c) for c in values]).select(
        F.lit(total).alias(key), *values)
    return df.select(key, *values).unionByName(sums)


def join_distribution(statement_counts: DataFrame, function_counts: DataFrame) -> DataFrame:
    """Statement and function counts side by side per (project, cwe)."""
    return (
        statement_counts.select("project", "cwe", F.col("count").alias("statements"))
        .join(function_counts.select("project", "cwe", F.col("count").alias("functions")),
              ["project", "cwe"])
    )


def label_counts(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("n"))


def class_count(df: DataFrame, label: str = "label") -> DataFrame:
    return df.agg(F.countDistinct(label).alias("n_classes"))


def benign_vulnerable_counts(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count_if(F.col("cwe") == BENIGN).alias("benign"),
        F.count_if(F.col("cwe") != BENIGN).alias("vulnerable"))


def table_shape(df: DataFrame, project: str | None = None) -> DataFrame:
    n_columns = len(df.columns)
    if project is not None:
        df = df.filter(F.col("project") == project)
    return df.agg(F.count("*").alias("n_rows")).withColumn("n_columns", F.lit(n_columns).cast("bigint"))


def distinct_counts(df: DataFrame, column: str, approximate: bool = False) -> DataFrame:
    """Rows, and distinct non-null values (one grouped pass; a sketch if ``approximate``)."""
    if approximate:
        return df.agg(F.count("*").alias("n_rows"), F.approx_count_distinct(column).alias("n_distinct"))
    return df.groupBy(column).agg(F.count("*").alias("_n")).agg(
        F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint").alias("n_rows"),
        F.count(column).alias("n_distinct"))


def min_length(df: DataFrame, column: str = "context") -> DataFrame:
    return df.agg(F.min(F.length(column)).cast("bigint").alias("min_length"))


def top_k(df: DataFrame, by: str, k: int = 10, ties: Sequence[str] = ()) -> DataFrame:
    return df.orderBy(F.desc(by), *ties).limit(k)


def top_cwe_by_function(functions: DataFrame, k: int = 10) -> DataFrame:
    counts = (
        functions.filter(F.col("cwe") != BENIGN).groupBy("cwe").agg(F.count("*").alias("count")))
    return top_k(counts, "count", k, ["cwe"])


def rank_align(statements: DataFrame, functions: DataFrame, k: int = 10) -> DataFrame:
    """The i-th most frequent statement label beside the i-th most frequent function label.

    Each side is cut to its top k before it is numbered.
    """
    def ranked(df: DataFrame, label: str, count: str) -> DataFrame:
        counts = df.filter(F.col("cwe").isNotNull()).groupBy("cwe").agg(F.count("*").alias(count))
        order = Window.orderBy(F.desc(count), "cwe")
        return top_k(counts, count, k, ["cwe"]).select(
            F.row_number().over(order).cast("bigint").alias("rank"), F.col("cwe").alias(label), count)

    return ranked(statements, "statement_cwe", "statements").join(
        ranked(functions, "function_cwe", "functions"), "rank", "full")


# --- distributions ------------------------------------------------------------------------------

_SKETCH_ACCURACY = 10_000
RANKED_ROWS = 100_000  # values that a task ranks


class _Bracket(NamedTuple):
    """Bounds between which the value of a rank lies, how many values are below, and how many inside."""

    low: float
    high: float
    below: int
    inside: int

    @property
    def open(self) -> bool:
        return self.low < self.high


def _narrowed(values: DataFrame, brackets: dict[int, _Bracket]) -> dict[int, _Bracket]:
    """Brackets of ranks, each narrowed by a sketch of what is inside; two passes over the values for all."""
    x, asked = F.col("x"), []
    for rank, b in brackets.items():
        share = (rank - b.below) / max(1, b.inside - 1)
        edges = [min(1.0, max(0.0, share + s)) for s in (-2 / _SKETCH_ACCURACY, 2 / _SKETCH_ACCURACY)]
        asked.append(F.percentile_approx(
            F.when(x.between(b.low, b.high), x), F.array(*map(F.lit, edges)), _SKETCH_ACCURACY).alias(f"e{rank}"))
    found = values.agg(*asked).first()
    count = lambda c: F.count(F.when(c, 1))
    asked = []
    for rank, b in brackets.items():
        low, high = found[f"e{rank}"]
        inner = x.between(b.low, b.high)
        asked.append(F.struct(
            F.lit(low).alias("low"), F.lit(high).alias("high"), count(x < low).alias("lt_low"), count(x <= low).alias("le_low"),
            count(x < high).alias("lt_high"), count(x <= high).alias("le_high"),
            F.min(F.when(inner & (x > b.low), x)).alias("next"), F.max(F.when(inner & (x < b.high), x)).alias("last"),
            count(x <= b.low).alias("le_b"), count(x < b.high).alias("lt_b")).alias(f"c{rank}"))
    counted = values.agg(*asked).first()
    out = {}
    for rank, b in brackets.items():
        c = counted[f"c{rank}"]
        if rank < c.lt_low:  # the sketch was off
            out[rank] = _Bracket(b.low, c.low, b.below, c.le_low - b.below)
        elif rank >= c.le_high:
            out[rank] = _Bracket(c.high, b.high, c.lt_high, b.below + b.inside - c.lt_high)
        elif (c.low, c.high) != (b.low, b.high):
            out[rank] = _Bracket(c.low, c.high, c.lt_low, c.le_high - c.lt_low)
        elif rank < c.le_b:  # ties at both ends hold the bounds: it is one of them, or between them
            out[rank] = _Bracket(b.low, b.low, b.below, c.le_b - b.below)
        elif rank >= c.lt_b:
            out[rank] = _Bracket(b.high, b.high, c.lt_b, b.below + b.inside - c.lt_b)
        else:
            out[rank] = _Bracket(c.next, c.last, c.le_b, c.lt_b - c.le_b)
    return out


def values_at(values: DataFrame, ranks: Sequence[int], bounds: _Bracket, most: int) -> dict[int, float]:
    """The values of 0-based ranks among ``values(x)``. No task ranks more than ``most`` of them."""
    brackets = dict.fromkeys(ranks, bounds)
    while wide := {r: b for r, b in brackets.items() if b.open and b.inside > most}:
        brackets |= _narrowed(values, wide)
    found = {r: b.low for r, b in brackets.items() if not b.open}
    parts = None
    for rank, b in brackets.items():
        if b.open:
            part = values.filter(F.col("x").between(b.low, b.high)).groupBy("x").agg(F.count("*").alias("c")).withColumn(
                "upto", F.sum("c").over(Window.partitionBy(F.lit(rank)).orderBy("x")) + b.below)
            part = part.filter((F.col("upto") > rank) & (F.col("upto") - F.col("c") <= rank)).select(F.lit(rank).alias("rank"), "x")
            parts = part if parts is None else parts.unionByName(part)
    return found | ({r["rank"]: r["x"] for r in parts.collect()} if parts is not None else {})


def exact_percentiles(df: DataFrame, column: str, probs: Sequence[float] = (0.25, 0.5, 0.75),
                      most: int = RANKED_ROWS) -> DataFrame:
    """Exact, linearly interpolated percentiles as one row of columns p0, p1, ...

    Each rank asked for is kept in a bracket of values, which mergeable sketches narrow, and counts make
    sure of, until it holds at most ``most`` values or one; only then its values are ranked. The
    passes are made when this is called; only counts and bounds reach the driver. Nulls do not count.
    """
    values = df.select(F.col(column).cast("double").alias("x")).filter("x is not null")
    n, low, high = values.agg(F.count("*"), F.min("x"), F.max("x")).first()
    schema = ", ".join(f"p{i} double" for i in range(len(probs)))
    if not n:
        return df.sparkSession.createDataFrame([(None,) * len(probs)], schema)
    places = [p * (n - 1) for p in probs]
    ranks = sorted({r for at in places for r in (math.floor(at), math.ceil(at))})
    found = values_at(values, ranks, _Bracket(low, high, 0, n), most)
    row = []
    for at in places:
        a, b = found[math.floor(at)], found[math.ceil(at)]
        row.append(a if a == b else a + (b - a) * (at - math.floor(at)))
    return df.sparkSession.createDataFrame([tuple(row)], schema)


def describe_numeric(df: DataFrame, column: str, derived: bool = False) -> DataFrame:
    """count, mean, sample std, min, quartiles, max of one column, as one row.

    Three passes read the column. Set ``derived`` for one that is costly to compute: it is then
    computed once and staged as a single column.
    """
    if derived:
        df = staged(df.select(column), "column")
    x = F.col(column).cast("double")
    quartiles = exact_percentiles(df, column).agg(
        F.struct(*[F.max(p).alias(p) for p in ("p0", "p1", "p2")]).alias("q")).scalar()
    return (
        df.agg(F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
               F.min(x).alias("min"), F.max(x).alias("max"))
        .withColumn("_q", quartiles)
        .select("count", "mean", "std", "min", F.col("_q.p0").alias("p25"), F.col("_q.p1").alias("p50"),
                F.col("_q.p2").alias("p75"), "max")
    )


def describe_categorical(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """count, distinct values, most frequent value (shortened to its basename) and its frequency per
    text column. Ties go to the smaller value."""
    cells = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")) for c in columns
    ])).alias("c")).select("c.*").filter("value is not null")
    values = cells.groupBy("feature", "value").agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("neg"), F.col("value").alias("value")))
    return values.groupBy("feature").agg(
        F.sum("n").cast("bigint").alias("count"), F.count("*").alias("unique"), best.alias("_top"),
    ).select("feature", "count", "unique", path_basename(F.col("_top.value")).alias("top"),
             (-F.col("_top.neg")).alias("freq"))


def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """Count per equal-width bin over [min, max]; the last bin is closed. Empty bins are not listed."""
    x = F.col(column).cast("double")
    span = df.agg(F.struct(F.min(x).alias("lo"), F.max(x).alias("hi")).alias("s")).scalar()
    width = (F.col("_s.hi") - F.col("_s.lo")) / bins
    at = F.when(width == 0, 0).otherwise(
        F.least(F.floor((F.col("_x") - F.col("_s.lo")) / F.nullif(width, F.lit(0.0))), F.lit(bins - 1)))
    return (
        df.select(x.alias("_x")).filter("_x is not null").withColumn("_s", span)
        .groupBy(at.cast("bigint").alias("bin")).agg(F.count("*").alias("n"))
    )


# --- order --------------------------------------------------------------------------------------

def sort_desc(df: DataFrame, *keys: str) -> DataFrame:
    return df.orderBy(*[F.desc(k) for k in keys])


def limit_rows(df: DataFrame, n: int, *order: str) -> DataFrame:
    return df.orderBy(*order).limit(n)


def sorted_lengths(df: DataFrame, column: str, n: int, *order: str) -> DataFrame:
    first = limit_rows(df, n, *order)
    return first.select(*order, F.length(column).cast("bigint").alias("length")).orderBy("length", *order)
