"""Project table: registration, status, incremental selection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.labels import project_id

# The names of the states.
NOT_STARTED, IN_PROGRESS, COMPLETE, UNKNOWN = "Not Started", "In Progress", "Complete", "Unknown"


def new_projects(configured: DataFrame, known: DataFrame) -> DataFrame:
    return configured.select("project").distinct().join(known.select("project"), "project", "left_anti")


def register_projects(configured: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """The project table with every configured project in it."""
    if known is None:
        missing = configured.select("project").distinct()
    else:
        missing = new_projects(configured, known)
    added = missing.select(
        project_id(F.col("project")).alias("project_id"), "project", F.lit(NOT_STARTED).alias("status"))
    return added if known is None else known.select(*added.columns).unionByName(added)


def set_status(projects: DataFrame, updates: DataFrame) -> DataFrame:
    """Take the status of ``updates`` (project, status), one row per project, where there is one."""
    new = updates.select("project", F.col("status").alias("_new"))
    return projects.join(new, "project", "left").withColumn(
        "status", F.coalesce("_new", "status")).drop("_new")


def get_status(wanted: DataFrame, projects: DataFrame) -> DataFrame:
    return wanted.select("project").join(projects.select("project", "status"), "project", "left").withColumn(
        "status", F.coalesce("status", F.lit(UNKNOWN)))


def filter_todo_projects(projects: DataFrame) -> DataFrame:
    return projects.filter(F.col("status") != COMPLETE)


def latest_status(events: DataFrame, *order: str) -> DataFrame:
    """Last status of each project in event order."""
    return events.groupBy("project").agg(F.max_by("status", F.struct(*order)).alias("status"))


def remaining_files(files: DataFrame, scanned: DataFrame, file: str = "file") -> DataFrame:
    return files.join(scanned.select(file).distinct(), file, "left_anti")
