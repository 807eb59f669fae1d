"""NearMiss-1 undersampling: keep the majority rows closest to the minority class.

The distance part is an exact k-nearest-neighbour join. A small minority class is broadcast after a
check of its size, packed to a byte a value where that is exact. A large one is cut into cells around pivots; each cell's radius and nearest
members bound the distance to its rows, so a row visits only the cells that can hold one of its k
neighbours (Lu et al., "Efficient Processing of k Nearest Neighbor Joins using MapReduce", 2012).
Cells are cut into blocks and visits into chunks of bounded size, so that no task holds a whole cell.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.operators.scale import seeded_hash
from codeloom.session import ensure_checkpoint_dir, staged

MAX_BROADCAST_VALUES = 8_000_000  # doubles, 64 MB; eight times as many of a byte
_STEP = 2048  # rows per distance matrix
_VISITORS = 256  # rows whose visits to cells are sent at a time


def _exact_squares(rows: np.ndarray, others: np.ndarray) -> bool:
    """Whole numbers so small that sums of their products have no rounding: any form of the distance is exact."""
    if not len(rows) or not len(others):
        return False
    largest = max(np.abs(rows).max(initial=0), np.abs(others).max(initial=0))
    return bool(4 * largest * largest * max(rows.shape[1], 1) < 2 ** 53 and (rows == np.rint(rows)).all() and (others == np.rint(others)).all())


def _k_smallest(rows: np.ndarray, others: np.ndarray, k: int) -> np.ndarray:
    """The k smallest Euclidean distances of each row to ``others``, ascending, padded with inf."""
    best = np.full((len(rows), k), np.inf)
    products = _exact_squares(rows, others)
    for at in range(0, len(others), _STEP):
        block = others[at:at + _STEP]
        if products:
            block_squares = (block * block).sum(axis=1)
        for lo in range(0, len(rows), _STEP):
            part, known = rows[lo:lo + _STEP], best[lo:lo + _STEP]
            if products:
                d = part @ block.T
                d *= -2
                d += block_squares
                d += (part * part).sum(axis=1)[:, None]
                near = np.flatnonzero(d.min(axis=1) < known[:, -1] ** 2 + 0.5)  # others have nothing nearer
                d = d[near]
                if d.shape[1] > k:
                    d = np.partition(d, k - 1, axis=1)[:, :k]
                both = np.concatenate([known[near], np.sqrt(d)], axis=1)
                both.sort(axis=1)
                known[near] = both[:, :k]
                continue
            # Differences, not the dot-product form: equal vectors must be exactly 0 apart.
            d = np.empty((len(part), len(block)))
            for j in range(len(block)):
                d[:, j] = np.sqrt(((part - block[j]) ** 2).sum(axis=1))
            both = np.concatenate([known, d], axis=1)
            both.sort(axis=1)
            known[:] = both[:, :k]
    return best


def _mean_of(smallest: Column, k: int) -> Column:
    """Mean of the k smallest finite distances."""
    near = F.slice(F.array_sort(F.filter(smallest, lambda d: d < float("inf"))), 1, k)
    return F.aggregate(near, F.lit(0.0), lambda a, d: a + d) / F.size(near)


def _matrix(column: pa.ListArray) -> np.ndarray:
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes != sizes[0]).any():
        raise ValueError("vectors have different lengths")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(sizes), sizes[0] if len(sizes) else 0)


def _narrow(x: np.ndarray) -> np.ndarray:
    """The same numbers in as few bytes as hold them all."""
    for kind in ("u1", "<i2"):
        with np.errstate(invalid="ignore"):
            y = x.astype(kind)
        if (y == x).all():
            return y
    return x


def _packed(rows: DataFrame, vector: str) -> DataFrame:
    """Blocks of at most ``_STEP`` vectors."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _STEP):
                x = _narrow(_matrix(batch.column(0).slice(at, _STEP)))
                yield pa.RecordBatch.from_pydict({
                    "n": pa.array([len(x)], pa.int32()), "kind": [x.dtype.str], "body": pa.array([x.tobytes()], pa.binary())})

    return rows.select(vector).mapInArrow(pack, "n int, kind string, body binary")


def _k_smallest_of(rows: np.ndarray, blocks: list[np.ndarray], top: float, k: int) -> np.ndarray:
    """``_k_smallest`` to rows in blocks, whose values are at most ``top`` if they are whole (else nan)."""
    largest = max(np.abs(rows).max(initial=0), top)
    bound = 4 * largest * largest * max(rows.shape[1], 1)  # of sums of products; nan is below none
    if not (bound < 2 ** 53 and (rows == np.rint(rows)).all()):
        best = np.full((len(rows), k), np.inf)
        for block in blocks:
            best = np.sort(np.concatenate([best, _k_smallest(rows, block.astype(float), k)], axis=1), axis=1)[:, :k]
        return best
    kind = np.float32 if bound < 2 ** 24 else np.float64
    best = np.full((len(rows), k), np.inf)
    ones = np.ones((len(rows), 1))
    left = np.concatenate([rows, (rows * rows).sum(axis=1, keepdims=True), ones], axis=1).astype(kind)
    for block in blocks:
        y = block.astype(float)
        right = np.concatenate([-2 * y, np.ones((len(y), 1)), (y * y).sum(axis=1, keepdims=True)], axis=1).astype(kind)
        d = left @ right.T
        near = np.flatnonzero(d.min(axis=1) < best[:, -1])  # others have nothing nearer
        d = d[near]
        if d.shape[1] > k:
            d = np.partition(d, k - 1, axis=1)[:, :k]
        best[near] = np.sort(np.concatenate([best[near], d], axis=1), axis=1)[:, :k]
    return np.sqrt(best)


def _broadcast_distances(rows: DataFrame, blocks: list[np.ndarray], row_id: str, vector: str, k: int) -> DataFrame:
    whole = all(b.dtype.kind != "f" or (b == np.rint(b)).all() for b in blocks)
    top = max(float(np.abs(b.astype(float)).max(initial=0)) for b in blocks) if whole else float("nan")
    shared = rows.sparkSession.sparkContext.broadcast((blocks, top))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _STEP):
                part = batch.slice(at, _STEP)
                best = _k_smallest_of(_matrix(part.column(1)), *shared.value, k)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(
                    pa.array(np.arange(len(best) + 1) * k, pa.int32()), pa.array(best.reshape(-1)))], names=[row_id, "near"])

    kind = rows.schema[row_id].dataType.simpleString()
    return rows.select(row_id, vector).mapInArrow(near, f"`{row_id}` {kind}, near array<double>")


def _cell_distances(rows: DataFrame, minority: DataFrame, row_id: str, vector: str, k: int,
                    pivots: int, block_rows: int, seed: int) -> DataFrame:
    """The exact join for a minority class that is too large to broadcast."""
    spark = rows.sparkSession
    kind = rows.schema[row_id].dataType.simpleString()
    centres = np.stack([np.asarray(r[0], dtype=float) for r in (
        minority.orderBy(seeded_hash(seed, row_id)).select(vector).limit(pivots).collect())])
    shared = spark.sparkContext.broadcast(centres)

    def to_cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x = np.stack(batch[vector].to_numpy())
                d = np.stack([np.sqrt(((x - c) ** 2).sum(axis=1)) for c in shared.value], axis=1)
                cell = d.argmin(axis=1)
                yield pd.DataFrame({row_id: batch[row_id], vector: batch[vector], "cell": cell,
                                    "dist": d[np.arange(len(x)), cell]})

    cells = minority.select(row_id, vector).mapInPandas(
        to_cells, f"{row_id} {kind}, {vector} array<double>, cell int, dist double")
    # One row per pivot: radius, size and the k members nearest to the pivot.
    members = (
        cells.withColumn("_b", F.pmod(F.xxhash64(row_id), F.lit(256)))
        .groupBy("cell", "_b").agg(
            F.max("dist").alias("radius"), F.count("*").alias("n"),
            F.min("dist").alias("nearest"))
        .groupBy("cell").agg(
            F.max("radius").alias("radius"), F.sum("n").alias("n"),
            F.slice(F.array_sort(F.collect_list("nearest")), 1, k).alias("near"))
    )
    summary = members.toPandas().sort_values("cell")
    cell_ids = summary["cell"].to_numpy()
    info = spark.sparkContext.broadcast((
        cell_ids, summary["radius"].to_numpy(),
        np.array([list(v) + [np.inf] * (k - len(v)) for v in summary["near"]])))
    blocks_of = spark.createDataFrame(
        [(int(c), int(-(-n // block_rows))) for c, n in zip(summary["cell"], summary["n"])],
        "cell int, blocks int")

    def to_visits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, radius, near = info.value
        for batch in batches:
            for at in range(0, len(batch), _VISITORS):
                part = batch.iloc[at:at + _VISITORS]
                x = np.stack(part[vector].to_numpy())
                d = np.stack([np.sqrt(((x - shared.value[c]) ** 2).sum(axis=1)) for c in ids], axis=1)
                # k known members are no further than their distance to the pivot plus the pivot's.
                upper = np.sort((d[:, :, None] + near[None, :, :]).reshape(len(x), -1), axis=1)[:, k - 1]
                slack = 1e-9 * (1.0 + d)
                row, col = np.nonzero(d - radius[None, :] <= upper[:, None] + slack)
                yield pd.DataFrame({row_id: part[row_id].to_numpy()[row],
                                    vector: part[vector].to_numpy()[row], "cell": ids[col]})

    visits = rows.select(row_id, vector).mapInPandas(
        to_visits, f"{row_id} {kind}, {vector} array<double>, cell int")
    # Every visit meets every block of its cell; rows of a cell spread over chunks by their hash.
    chunks_of = visits.groupBy("cell").agg(
        F.ceil(F.count("*") / F.lit(block_rows)).cast("int").alias("chunks"))
    met = (
        visits.join(F.broadcast(blocks_of.join(chunks_of, "cell")), "cell")  # one row per pivot
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("chunk", F.pmod(F.xxhash64(row_id), "chunks").cast("int"))
    )
    blocks = (
        cells.join(F.broadcast(blocks_of), "cell")
        .withColumn("block", F.pmod(F.xxhash64(row_id), "blocks").cast("int"))
        .groupBy("cell", "block").agg(F.collect_list(vector).alias("vectors"))
    )
    # A block is one bounded row; each (cell, block, chunk) reads it once.
    used = met.select("cell", "block", "chunk").distinct().join(blocks, ["cell", "block"])
    used = used.select("cell", "block", "chunk", "vectors").toDF("cell_", "block_", "chunk_", "vectors")

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({row_id: [], "near": []})
        best = _k_smallest(np.stack(left[vector].to_numpy()), np.stack(right["vectors"].iloc[0]), k)
        return pd.DataFrame({row_id: left[row_id], "near": list(best)})

    visitors, hosts = met.groupBy("cell", "block", "chunk"), used.groupBy("cell_", "block_", "chunk_")
    return visitors.cogroup(hosts).applyInPandas(
        meet, f"{row_id} {kind}, near array<double>")


def minority_distances(df: DataFrame, label: str, row_id: str, vector: str, k: int = 3,
                       max_values: int = MAX_BROADCAST_VALUES, pivots: int = 64,
                       block_rows: int = 4096, seed: int = 0) -> tuple[DataFrame, Column, int]:
    """(``row_id``, ``distance``) of every row outside the smallest class, namely the mean distance
    to its k nearest rows of that class; with that class and its size. Ties for smallest go to the
    lowest label. Rows without a label or a vector take no part."""
    df = df.filter(F.col(label).isNotNull() & F.col(vector).isNotNull())
    low, n_min = df.groupBy(label).agg(F.count("*").alias("_n")).orderBy("_n", label).limit(1).first()
    minority_label = F.lit(low)
    # A few bytes make much work here, so rows are dealt to all cores whatever their size.
    dealt = df.select(row_id, label, vector).repartition(4 * df.sparkSession.sparkContext.defaultParallelism)
    as_double = dealt.withColumn(vector, F.col(vector).cast("array<double>"))
    minority = as_double.filter(F.col(label) == minority_label).select(row_id, vector)
    rows = as_double.filter(F.col(label) != minority_label)
    packed = staged(_packed(minority, vector), "minority")
    if (packed.agg(F.sum(F.length("body"))).first()[0] or 0) <= 8 * max_values:
        blocks = [np.frombuffer(r["body"], r["kind"]).reshape(r["n"], -1) for r in packed.collect()]
        found = _broadcast_distances(rows, blocks, row_id, vector, k)
    else:
        found = _cell_distances(rows, minority, row_id, vector, k, pivots, block_rows, seed)
        found = found.groupBy(row_id).agg(F.flatten(F.collect_list("near")).alias("near"))
    return found.select(row_id, _mean_of(F.col("near"), k).alias("distance")), minority_label, n_min


def nearmiss_undersample(df: DataFrame, label: str, row_id: str, vector: str, k: int = 3,
                         digits: int = 6, **options: int) -> DataFrame:
    """Reduce every class to the size of the smallest: the rows with the smallest mean distance to
    their k nearest minority rows stay. Distances are compared to ``digits`` decimals, ties by id.

    Vectors are written once, for the steps that read them. The distances are the costly part and are read several
    times, so they are checkpointed.
    """
    ensure_checkpoint_dir(df.sparkSession)
    vectors = staged(df.select(row_id, label, vector), "vectors")
    distances, minority_label, n_min = minority_distances(vectors, label, row_id, vector, k, **options)
    measured = (
        distances.withColumn("distance", F.round("distance", digits))
        .join(vectors.select(row_id, label), row_id).checkpoint())
    kept = _lowest_per_class(measured, label, row_id, n_min).select(row_id, "distance")
    return df.filter(F.col(label) == minority_label).withColumn(
        "distance", F.lit(None).cast("double")).unionByName(df.join(kept, row_id))


def _lowest_per_class(ranked: DataFrame, label: str, row_id: str, n_min: int) -> DataFrame:
    """Exactly ``n_min`` rows with the smallest (distance, id) in each class, without ranking whole
    classes: counts per distance, running totals, and a rank only among rows at the limit distance."""
    # A mergeable sketch brackets the limit distance of each class; exact counts settle it.
    bound = ranked.groupBy(label).agg(
        F.count("*").alias("_n"),
        F.percentile_approx("distance", F.array(*[F.lit(i / 1000) for i in range(1001)]), 20000).alias("_q"))
    share = F.lit(float(n_min)) / F.col("_n")
    lo = F.greatest(F.floor(share * 1000).cast("int") - 1, F.lit(0))
    hi = F.least(F.ceil(share * 1000).cast("int") + 1, F.lit(1000))
    bound = bound.select(
        label,
        F.when(lo > 0, F.element_at("_q", lo + 1)).otherwise(F.lit(float("-inf"))).alias("_lo"),
        F.when(hi < 1000, F.element_at("_q", hi + 1)).otherwise(F.lit(float("inf"))).alias("_hi"))
    near = ranked.join(bound, label).filter(F.col("distance") <= F.col("_hi"))
    sure = near.filter(F.col("distance") < F.col("_lo"))
    taken = sure.groupBy(label).agg(F.count("*").alias("_taken"))
    open_rows = near.filter(F.col("distance") >= F.col("_lo"))
    order = Window.partitionBy(label).orderBy("distance", row_id)
    rest = (
        open_rows.withColumn("_rn", F.row_number().over(order))
        .join(taken, label, "left")
        .filter(F.col("_rn") <= F.lit(n_min) - F.coalesce("_taken", F.lit(0)))
        .drop("_rn", "_taken")
    )
    return sure.unionByName(rest).drop("_lo", "_hi")
