"""Source files from directories and archives."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.text import path_suffix
from codeloom.sources.archives import RANGE_BYTES, archive_paths, entry_ranges, read_ranges

# Suffixes read as C or C++.
C_SUFFIXES = ["c", "c++", "cpp", "cxx", "cp", "h"]


def language_of(path: Column, allowed: Iterable[str] = C_SUFFIXES) -> Column:
    suffix = path_suffix(path)
    return F.when(suffix.isin(*allowed), suffix).otherwise("unknown")


def filter_sources(files: DataFrame, path: str = "path",
                   allowed: Iterable[str] = C_SUFFIXES) -> DataFrame:
    """Keep files whose last suffix is allowed, and name their language."""
    return files.withColumn("lang", language_of(F.col(path), allowed)).filter("lang <> 'unknown'")


def decode_source(content: Column) -> Column:
    """UTF-8 text where the bytes are valid UTF-8, Latin-1 text otherwise."""
    text = content.cast("string")
    return F.when(F.is_valid_utf8(text), text).otherwise(F.decode(content, "ISO-8859-1"))


def read_source_tree(spark: SparkSession, root: str, project: str | None = None,
                     allowed: Iterable[str] = C_SUFFIXES) -> DataFrame:
    """All source files below ``root``: path, project, lang, content, text."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.*").load(root)
        .select("path", "content")
    )
    return (
        filter_sources(files, "path", allowed)
        .select("path", F.lit(project or root).alias("project"), "lang", "content",
                decode_source(F.col("content")).alias("text"))
    )


def unzip_entries(archives: DataFrame, path: str = "path", wanted: Iterable[str] | None = None,
                  range_bytes: int = RANGE_BYTES) -> DataFrame:
    """One row per file inside each ZIP archive whose path is given: archive, path, content.

    With ``wanted`` suffixes only those entries are read. Directories of archives are read first, then
    their entries by seek, in ranges of about ``range_bytes`` that are dealt to all tasks.
    """
    ranges = entry_ranges(archives, path, range_bytes)
    if wanted is not None:
        ranges = ranges.withColumn("entries", F.filter(
            "entries", lambda e: language_of(e["path"], wanted) != "unknown")).filter(F.size("entries") > 0)
    return read_ranges(ranges)


def read_zip_sources(spark: SparkSession, paths: str | list[str],
                     allowed: Iterable[str] = C_SUFFIXES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Source files inside ZIP archives: archive, path, lang, content, text."""
    entries = unzip_entries(archive_paths(spark, paths), wanted=allowed, range_bytes=range_bytes)
    return filter_sources(entries, "path", allowed).withColumn("text", decode_source(F.col("content")))
