"""Duplicates, label conflicts and dataset comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.text import collapse_whitespace, longer_than
from codeloom.schemas import BENIGN


def dedup_keep_first(df: DataFrame, subset: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row of each ``subset`` value in the given order.

    Spark limits each group inside every map task before it shuffles, so a hot group costs one row
    per task.
    """
    first = Window.partitionBy(*subset).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(first)).filter("_rn = 1").drop("_rn")


def refine_key(df: DataFrame) -> str:
    return "code" if "code" in df.columns else "context"


def refine_dataset(df: DataFrame, order: Sequence[str] = (), within: Sequence[str] = (),
                   labelled: bool = False) -> DataFrame:
    """One row per (key, cwe); ``Benign`` goes where the key also has a label sorting after it.

    The key is ``code``, or ``context`` in tables without code. Which row stands for a (key, cwe)
    is decided by ``order``, by default the remaining columns. The second step sees at most one row
    per label in each key. ``within`` names columns that the key determines: rows that were dealt by
    them are not moved again.

    Where no label is null (``labelled``), rows are moved once: each label after ``Benign`` sends a row without
    its text to the key's ``Benign`` rows, which then take no part.
    """
    key = refine_key(df)
    order = list(order) or [c for c in df.columns if c not in (key, "cwe", *within)] or ["cwe"]
    if labelled:
        no, yes = F.lit(False), F.lit(True)
        marked = df.withColumn("_key", F.unhex(F.sha2(F.col(key).cast("binary"), 256))).withColumn(
            "_mark", F.explode(F.when(F.col("cwe") > BENIGN, F.array(no, yes)).otherwise(F.array(no))))
        marked = marked.select("_key", "_mark", *[
            F.when(F.col("_mark"), F.lit(BENIGN if c == "cwe" else None)).otherwise(F.col(c)).alias(c) for c in df.columns])
        first = Window.partitionBy(*within, "_key", "cwe").orderBy(F.desc("_mark"), *order)
        return marked.withColumn("_rn", F.row_number().over(first)).filter("_rn = 1 AND NOT _mark").select(*df.columns)
    unique = dedup_keep_first(df, [*within, key, "cwe"], order)
    labels = Window.partitionBy(*within, key)
    return (
        unique.withColumn("_last", F.max("cwe").over(labels))
        .filter(~((F.col("cwe") == BENIGN) & (F.col("_last") > BENIGN)))
        .drop("_last")
    )


def drop_ambiguous(df: DataFrame, code: str = "code", label: str = "label") -> DataFrame:
    """One row per code that carries a single distinct label."""
    return (
        df.groupBy(code).agg(F.min(label).alias("_low"), F.max(label).alias("_high"))
        .filter("_low = _high").select(code, F.col("_low").alias(label))
    )


def duplicated_keys(df: DataFrame, *key: str) -> DataFrame:
    """Offending keys with their number of rows; empty if the key is unique."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")


def assert_unique(df: DataFrame, *key: str) -> DataFrame:
    bad = duplicated_keys(df, *key).take(5)
    if bad:
        raise AssertionError(f"not unique on {key}: {[tuple(r) for r in bad]}")
    return df


def clean_labelled_rows(df: DataFrame, min_length: int = 5) -> DataFrame:
    """Single spaces, no null labels, no short code, one row per unambiguous code.

    Grouping by code for the ambiguity test also removes the duplicates.
    """
    tidy = df.select(collapse_whitespace(F.col("code")).alias("code"), "label")
    tidy = tidy.filter(F.col("label").isNotNull() & longer_than(F.col("code"), min_length))
    return drop_ambiguous(tidy)


def merge_datasets(left: DataFrame, right: DataFrame) -> DataFrame:
    return drop_ambiguous(clean_labelled_rows(left).unionByName(clean_labelled_rows(right)))


def datasets_identical(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: sizes of both cleaned sides and of their merge, whether those sizes agree (the weak
    test), and whether both sides hold the same rows.

    Each side is cleaned once; a code's rows from both sides meet in one aggregation.
    """
    both = clean_labelled_rows(left).withColumn("_l", F.lit(1)).withColumn("_r", F.lit(0)).unionByName(
        clean_labelled_rows(right).withColumn("_l", F.lit(0)).withColumn("_r", F.lit(1)))
    codes = both.groupBy("code").agg(
        F.sum("_l").alias("l"), F.sum("_r").alias("r"),
        (F.min("label") == F.max("label")).alias("agree"))
    one_sided = ~F.col("agree") | (F.col("l") != F.col("r"))
    count = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return codes.agg(
        count(F.col("l")).alias("n_left"), count(F.col("r")).alias("n_right"),
        count(F.col("agree").cast("int")).alias("n_merged"),
        (count(one_sided.cast("int")) == 0).alias("identical"),
    ).select(
        "n_left", "n_right", "n_merged",
        ((F.col("n_merged") == F.col("n_left")) & (F.col("n_merged") == F.col("n_right"))).alias(
            "same_counts"),
        "identical")


def difference(left: DataFrame, right: DataFrame, *key: str) -> DataFrame:
    """Rows of ``left`` whose key is not in ``right``."""
    return left.join(right.select(*key).distinct(), list(key), "left_anti")
