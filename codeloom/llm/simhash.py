"""SimHash near-duplicates (2): pigeonhole blocks, a join on blocks, then Hamming distances.

Two fingerprints that differ in d bits agree on all but d of any disjoint blocks. With d + 2 blocks
each pair within d shares two whole blocks, so every fingerprint is filed under each choice of two
blocks. Members of a file are compared with each other; a file of too many different fingerprints
is split by the same rule over its free bits, which loses no pair and ends at small files.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import fields, map_rows
from codeloom.llm.components import components
from codeloom.session import staged

BITS = 64
PRINT_SLICE = 1 << 16  # shingles whose bits are unpacked at a time, so that long texts take little memory


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of a text's word shingles: a bit is set if it is set in over half of their XXH64."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.r_[0, ends[:-shingle]]
    stops = ends[shingle - 1:] - 1
    digest = xxhash.xxh64_intdigest
    total = np.zeros(BITS, np.int64)
    for at in range(0, len(starts), PRINT_SLICE):
        hashes = [digest(joined[a:b], seed) for a, b in zip(
            starts[at:at + PRINT_SLICE].tolist(), stops[at:at + PRINT_SLICE].tolist())]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 3) -> DataFrame:
    """Rows ``(key, fp)``; ``fp`` is the fingerprint as a signed long. Null text counts as empty. No shuffle."""
    kind = df.schema[key].dataType.simpleString()

    def kernel(keys: list, texts: list) -> list:
        prints = np.array([fingerprint(t, shingle) if t else 0 for t in texts], np.uint64)
        return [keys, prints.view(np.int64).tolist()]

    return map_rows(df.select(key, text), kernel, fields(f"`{key}` {kind}, fp long"), binary=(text,))


@lru_cache(maxsize=None)
def masks(mask: int, distance: int) -> tuple[int, ...]:
    """Masks that fix ``mask`` and two of ``distance`` + 2 blocks of its free bits."""
    free = [1 << b for b in range(BITS) if not mask >> b & 1]
    blocks = [sum(map(int, part)) for part in np.array_split(np.array(free, object), distance + 2)]
    return tuple(mask | a | b for a, b in combinations(blocks, 2))


def _filed(members: DataFrame, distance: int) -> DataFrame:
    """File each member ``(mask, fp)`` under every finer mask: rows ``(mask, key, fp)``."""

    def kernel(old: list, fps: list) -> list:
        values = np.array(fps, np.int64).view(np.uint64)
        old = np.array(old, np.int64).view(np.uint64)
        out = []
        for m in np.unique(old).tolist():
            mine = values[old == m]
            for fine in masks(m, distance):
                out.append((np.full(len(mine), fine, np.uint64), mine & np.uint64(fine), mine))
        return [np.concatenate(c).view(np.int64) for c in zip(*out)]

    return map_rows(members.select("mask", "fp"), kernel, fields("mask long, key long, fp long"))


def _stars(fps: np.ndarray, group: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside groups of sorted rows, contracted to stars: (member, least member it reaches)."""
    n = len(fps)
    root = np.arange(n)
    left, right, step = [], [], 1
    while step < n:
        a = np.flatnonzero(group[:-step] == group[step:])
        if not len(a):
            break
        a = a[np.bitwise_count(fps[a] ^ fps[a + step]) <= distance]
        left.append(a)
        right.append(a + step)
        step += 1
    if not left:
        return fps[:0], fps[:0]
    a, b = np.concatenate(left), np.concatenate(right)
    while True:
        low = np.minimum(root[a], root[b])
        if np.array_equal(root[a], low) and np.array_equal(root[b], low):
            break
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
    moved = np.flatnonzero(root != np.arange(n))
    return fps[moved], fps[root[moved]]


# Different fingerprints that a file may hold before it is split; also rows a task holds at a time.
FILE_ROWS = 2_000


def _linked(filed: DataFrame, distance: int, file_rows: int) -> DataFrame:
    """Star links ``(a, b)`` of every file; files have at most ``file_rows`` rows."""

    def start():
        left: list[np.ndarray] = []

        def stars(rows: np.ndarray) -> list:
            """Groups of at most a few thousand rows at a time, so that pairs of rows stay few."""
            if not len(rows):
                return [[], []]
            new = np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)]
            group = np.cumsum(new)
            heads = np.flatnonzero(new)
            out, at = [], 0
            while at < len(rows):
                end = heads[np.searchsorted(heads, at + file_rows, "right"):]
                stop = int(end[0]) if len(end) else len(rows)
                out.append(_stars(rows[at:stop, 2].view(np.uint64), group[at:stop], distance))
                at = stop
            return [np.concatenate(c).view(np.int64) for c in zip(*out)]

        def step(mask: list, key: list, fp: list) -> list:
            rows = np.array([mask, key, fp], np.int64).T
            if left:
                rows = np.concatenate([left.pop(), rows])
            tail = int(np.argmax((rows[:, :2] == rows[-1, :2]).all(axis=1)))
            left.append(rows[tail:].copy())
            return stars(np.ascontiguousarray(rows[:tail]))

        def finish() -> list | None:
            return stars(left.pop()) if left else None

        return step, finish

    dealt = filed.repartition("mask", "key").sortWithinPartitions("mask", "key")
    return map_rows(dealt, start, fields("a long, b long"), per_task=True).distinct()


def near_links(prints: DataFrame, distance: int = 3, file_rows: int = FILE_ROWS) -> DataFrame:
    """Links ``(a, b)`` that connect exactly the distinct fingerprints ``prints(fp)`` within ``distance``.

    Whatever reaches whatever by steps of at most ``distance`` bits does so by these links; they are
    stars, so a dense file of m fingerprints gives m - 1 of them and not all pairs. Sizes of files are
    counted map-side first; files over ``file_rows`` go on to the next level by finer masks.
    """
    links = None
    level = prints.select(F.lit(0).cast("long").alias("mask"), "fp")
    for _ in range(BITS):
        filed = _filed(level, distance)
        crowded = staged(
            filed.groupBy("mask", "key").count().filter(F.col("count") > file_rows).select("mask", "key"), "crowded")
        full = not crowded.isEmpty()
        small = filed.join(crowded, ["mask", "key"], "left_anti") if full else filed
        found = _linked(small, distance, file_rows)
        links = found if links is None else links.unionByName(found)
        if not full:
            return links
        level = staged(filed.join(crowded, ["mask", "key"], "left_semi").select("mask", "fp").distinct(), "level")
    raise RuntimeError("files of fingerprints did not get small")


def near_duplicates(df: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 3,
                    distance: int = 3) -> DataFrame:
    """Rows ``(key, fp, component_id)``, one for each row of ``df``.

    ``component_id`` is the least key reachable by links of at most ``distance`` differing bits.
    Null and empty texts have fingerprint 0 and link like any other; null keys take part, but a
    component's id is null only if all its keys are; repeated rows give a row each; long texts are read
    whole; an empty table gives an empty result; other columns are not read, and ``key`` may have any
    name. Only keys and fingerprints are shuffled.
    """
    rows = staged(fingerprints(df.select(F.col(key).alias("own"), F.col(text).alias("body")), "body", "own", shingle),
                  "fingerprints")
    distinct = staged(rows.groupBy("fp").agg(F.min("own").alias("first")), "distinct")
    roots = components(near_links(distinct.select("fp"), distance)).withColumnRenamed("node", "fp")
    known = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = known.groupBy("root").agg(F.min("first").alias("component_id"))
    return rows.join(known.join(ids, "root").select("fp", "component_id"), "fp").select(
        F.col("own").alias(key), "fp", "component_id")
