"""Static-analyzer reports, read with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.schemas import CPPCHECK_ERROR, FLAWFINDER_CSV, RATS_VULNERABILITY, UNKNOWN_CWE


def read_flawfinder(spark: SparkSession, path: str) -> DataFrame:
    return (
        spark.read.schema(FLAWFINDER_CSV)
        .csv(path, header=True, multiLine=True, quote='"', escape='"')
        .withColumn("tool", F.lit("FlawFinder"))
    )


def read_cppcheck(spark: SparkSession, path: str) -> DataFrame:
    """One row per error location. An error without a location keeps one row without a line.

    File, line, column and note come from the location itself; ``file0`` stands in for a location
    that names no file. The weakness number is still bare here, see ``prefix_cwe``.
    """
    errors = spark.read.format("xml").option("rowTag", "error").schema(CPPCHECK_ERROR).load(path)
    return errors.select("*", F.explode_outer("location").alias("at")).select(
        F.coalesce("at._file", "_file0").alias("file"),
        F.col("at._line").cast("int").alias("line"),
        F.col("at._column").alias("column"),
        F.col("at._info").alias("info"),
        F.col("_id").alias("id"),
        F.col("_severity").alias("severity"),
        F.col("_msg").alias("msg"),
        F.col("_verbose").alias("verbose"),
        F.col("_inconclusive").alias("inconclusive"),
        F.col("_cwe").alias("cwe"),
        F.lit("CppCheck").alias("tool"),
    )


def read_rats(spark: SparkSession, path: str) -> DataFrame:
    """One row per reported line."""
    found = spark.read.format("xml").option("rowTag", "vulnerability").schema(
        RATS_VULNERABILITY).load(path)
    return (
        found.select("severity", "type", "message", F.explode("file").alias("at"))
        .select("severity", "type", "message", F.col("at.name").alias("file"),
                F.explode("at.line").alias("line"))
        .withColumn("line", F.col("line").cast("int"))
        .withColumn("cwe", F.lit(UNKNOWN_CWE))
        .withColumn("tool", F.lit("Rats"))
    )


def read_infer(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Rows of JSON-array reports. Pass ``schema`` on large inputs to skip the inference pass."""
    reader = spark.read.option("multiLine", True)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.json(path).withColumn("tool", F.lit("infer"))
