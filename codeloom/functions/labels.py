"""Label column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.schemas import BENIGN, MISSING, UNKNOWN_CWE


def is_vulnerable(c: Column) -> Column:
    return c != BENIGN


def binary_name(c: Column) -> Column:
    return F.when(c == BENIGN, BENIGN).otherwise("Vulnerable")


def binary_flag(c: Column) -> Column:
    return F.when(c == BENIGN, 0).otherwise(1)


def binary_label(df: DataFrame, label: str = "label") -> DataFrame:
    """Two-class names. Labels without ``Benign`` are read as 0/1 if a 0 occurs, else left alone."""
    text = F.col(label).cast("string")
    seen = df.agg(F.struct(
        F.coalesce(F.bool_or(text == BENIGN), F.lit(False)).alias("benign"),
        F.coalesce(F.bool_or(text == "0"), F.lit(False)).alias("zero")).alias("seen"))
    out = df.withColumn("_seen", seen.scalar())
    named = (
        F.when(F.col("_seen.benign"), F.when(text == BENIGN, BENIGN).otherwise("Vulnerable"))
        .when(F.col("_seen.zero"), F.when(text == "0", BENIGN).otherwise("Vulnerable"))
        .otherwise(text))
    return out.withColumn(label, named).drop("_seen")


def map_label(c: Column, mapping: dict[str, int]) -> Column:
    """Value of ``c`` in ``mapping``; other labels become null."""
    pairs = [F.lit(x) for item in mapping.items() for x in item]
    return F.element_at(F.create_map(*pairs), c)


# The spelled-out labels of one of the comparison datasets.
SPELLED_LABELS = {"Vulnerable Code": 1, "Benign Code": 0}


def clean_cwe_list(labels: Column) -> Column:
    """Distinct labels; the unknown label goes once a known one is present."""
    distinct = F.array_distinct(labels)
    return F.when(F.size(distinct) > 1, F.array_remove(distinct, UNKNOWN_CWE)).otherwise(distinct)


def cwe_list_repr(labels: Column) -> Column:
    """The list-literal spelling, for parity exports."""
    return F.concat(F.lit("['"), F.array_join(labels, "', '"), F.lit("']"))


def plain_cwe(c: Column) -> Column:
    return F.regexp_replace(c, r"\['|'\]", "")


def relabel_category(category: Column, name: Column) -> Column:
    return F.when((category == name) | (name == MISSING), category).otherwise(name)


def one_hot(index: Column, classes: int | Column) -> Column:
    last = (F.lit(classes) if isinstance(classes, int) else classes) - 1
    return F.transform(F.sequence(F.lit(0), last.cast("int")), lambda i: (i == index).cast("int"))


def argmax(v: Column) -> Column:
    """0-based position of the first maximum."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def threshold_scores(score: Column, cut: float = 0.5) -> Column:
    return (score > cut).cast("int")


def project_id(project: Column) -> Column:
    """Stable 16-bit id; like any 16-bit id it may collide."""
    return F.conv(F.substring(F.md5(project), 1, 4), 16, 10).cast("bigint")
