"""Helpers of the operators in this folder: batch kernels, safe column names, registered queries."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# White space of the word contracts: \x20 and \x09-\x0D. bytes.split() splits at exactly these.
WORD = r"[^\x20\x09-\x0D]+"
WHITE = " \t\n\x0b\f\r"

# Rows that a kernel turns into Python objects at a time; Spark bounds the Arrow batch itself.
SLICE_ROWS = 256


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_rows(df: DataFrame, kernel: Callable[[list[list]], Iterable[list]], schema: T.StructType,
             binary: tuple[str, ...] = (), per_task: bool = False) -> DataFrame:
    """Apply ``kernel`` to slices of rows in Arrow batches; no shuffle.

    The kernel takes the input columns as lists (``binary`` ones as UTF-8 bytes) and returns the
    output columns as lists or arrays. With ``per_task`` it is instead called without arguments
    once in each task and returns ``(step, finish)``: ``step`` is such a kernel, ``finish()``
    gives the last columns, or None. Either may instead return an iterator of columns, so that much
    output travels in several batches.
    """
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, finish = kernel() if per_task else (kernel, None)

        def packed(columns) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [c if isinstance(c, pa.Array) else pa.array(c, type=f.type)
                 for c, f in zip(columns, arrow)], schema=arrow)

        def outputs(out) -> Iterator[pa.RecordBatch]:
            if isinstance(out, (list, tuple)):
                out = (out,)
            return map(packed, out or ())

        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                columns = [
                    (part.column(i).cast(pa.binary()) if f.name in binary else part.column(i)).to_pylist()
                    for i, f in enumerate(part.schema)]
                yield from outputs(step(*columns))
        if finish is not None:
            yield from outputs(finish())

    return df.mapInArrow(run, schema)


def fields(text: str) -> T.StructType:
    """A schema from a DDL string."""
    return T.StructType.fromDDL(text)


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores in front until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def let(value, body):
    """``body(value)`` with ``value`` computed once, although ``body`` may use it often."""
    return F.transform(F.array(value), body)[0]
