"""Substring dedup (4): a count-min prefilter over merged partition sketches, then exact grouping.

Pass 1 sketches, pass 2 groups exactly only windows that the sketch estimates repeated.

* Documents with the same word sequence are settled by their digest first: all but those with the
  least id lose every window. One document of each sequence goes on.
* A window's anchor is its least hashed run of words. Equal windows have equal anchors, so the count
  of an anchor is an upper bound of its windows' counts, and there is one anchor for many windows.
* Each partition counts its anchors in a count-min sketch, which travels as sorted cells; merging adds
  up. Cells that reach two are sent to the executors as bits, whose number has a fixed bound.
* Estimates are never too low, so no repeated window is lost; too high ones cost only work.
"""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import fields, map_rows
from codeloom.session import staged

ROWS = 2  # of the sketch
CELLS_PER_ANCHOR = 8
# Bounds of a sketch row's log2 width: the bits that each executor gets are at most 2 x 2**28 / 8 bytes = 64 MB.
# Beyond, estimates get looser and the exact pass gets more windows; results stay the same.
LEAST_WIDTH, MOST_WIDTH = 12, 28
SHARD_BITS = 7  # a sketch row is merged in 2**7 shards
RUN = 10  # words of an anchor

_MIX = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(words: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter(map(digest, words), np.uint64, len(words))


def anchors(words: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window: the hash of its least run of words, and that run's start."""
    run = min(RUN, window)
    h = word_hashes(words)
    runs = np.zeros(len(h) - run + 1, np.uint64)
    for i in range(run):  # a polynomial of word hashes, mod 2**64
        runs = runs * _MIX + h[i:len(h) - run + 1 + i]
    runs ^= runs >> np.uint64(29)
    runs *= np.uint64(0xBF58476D1CE4E5B9)
    runs ^= runs >> np.uint64(32)
    size = window - run + 1  # runs in a window
    # Sliding minimum by doubling; ties take the first run.
    least, at, width = runs, np.arange(len(runs)), 1
    while width < size:
        step = min(width, size - width)
        a, b = least[:len(least) - step], least[step:]
        right = b < a
        least, at = np.where(right, b, a), np.where(right, at[step:], at[:len(at) - step])
        width += step
    return least, at


def cells(anchor: np.ndarray, width: int) -> list[np.ndarray]:
    """Cell of each anchor in each row of the sketch, with the row in the bits above the width."""
    out, value = [], anchor
    for row in range(ROWS):
        value = (value ^ (value >> np.uint64(31))) * np.uint64(0x94D049BB133111EB + 2 * row)
        out.append((value >> np.uint64(64 - width)) | np.uint64(row << width))
    return out


def _shards(width: int) -> int:
    return max(0, width - SHARD_BITS)


def _sketches(texts: DataFrame, text: str, window: int, width: int) -> DataFrame:
    """Partition sketches: rows ``(shard, once, twice)`` of sorted 32-bit cells seen once, and at least twice."""
    shift = np.uint64(_shards(width))

    def start():
        held: list[np.ndarray] = []

        def flush() -> list | None:
            if not held:
                return None
            at, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            shard = (at >> shift).astype(np.int64)
            cut = np.flatnonzero(np.diff(shard)) + 1
            at32, again = at.astype("<u4"), n > 1
            pieces = [(s[0], c[~a].tobytes(), c[a].tobytes()) for s, c, a in zip(
                np.split(shard, cut), np.split(at32, cut), np.split(again, cut))]
            return [list(c) for c in zip(*pieces)]

        def step(bodies: list) -> list | None:
            for body in bodies:
                words = body.split() if body else ()
                if len(words) >= window:
                    anchor, at = anchors(words, window)
                    new = np.r_[True, at[1:] != at[:-1]]  # each anchor once where it stands
                    held.extend(cells(anchor[new], width))
            return flush() if sum(map(len, held)) > 4_000_000 else None

        return step, flush

    return map_rows(texts.select(text), start, fields("shard long, once binary, twice binary"),
                    binary=(text,), per_task=True)


def _merged(sketches: DataFrame, width: int) -> bytes:
    """Bits of all cells whose merged count reaches two. A task holds the counts of one shard at a time."""
    size = 1 << _shards(width)

    def start():
        now: dict[int, np.ndarray] = {}

        def bits() -> list:
            (shard, counts), = now.items()
            now.clear()
            return [shard, np.packbits(counts > 1, bitorder="little").tobytes()]

        def step(shards: list, once: list, twice: list) -> list | None:
            out = []
            for shard, *pieces in zip(shards, once, twice):
                if now and shard not in now:
                    out.append(bits())
                counts = now.setdefault(shard, np.zeros(size, np.uint8))
                for n, piece in enumerate(pieces, 1):
                    at = np.frombuffer(piece, "<u4") & np.uint32(size - 1)
                    counts[at] = np.minimum(counts[at] + n, 2)
            return [list(c) for c in zip(*out)] if out else None

        def finish() -> list | None:
            return [[c] for c in bits()] if now else None

        return step, finish

    dealt = sketches.repartition("shard").sortWithinPartitions("shard")
    found = map_rows(dealt, start, fields("shard long, bits binary"), per_task=True)
    out = bytearray((ROWS << width) // 8)
    each = size // 8
    for row in found.toLocalIterator():  # bounded: at most 2 x 2**MOST_WIDTH bits
        out[row["shard"] * each:(row["shard"] + 1) * each] = row["bits"]
    return bytes(out)


def _candidates(texts: DataFrame, text: str, key: str, window: int, width: int, bits) -> DataFrame:
    """Windows estimated repeated: rows ``(hi, lo, key, place)``.

    ``hi, lo`` are a 128-bit digest of the words; ``place`` is the window's start, with a hash of the
    text above it that tells rows of one key apart.
    """
    kind = texts.schema[key].dataType.simpleString()

    def kernel(keys: list, bodies: list, tags: list) -> list:
        seen = np.frombuffer(bits.value, np.uint8)
        digests, owners, places = [], [], []
        for owner, body, tag in zip(keys, bodies, tags):
            words = body.split() if body else ()
            if len(words) < window:
                continue
            again = True
            for at in cells(anchors(words, window)[0], width):
                again &= (seen[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
            hits = np.flatnonzero(again).tolist()
            if hits:
                joined = b" ".join(words)
                ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1).tolist()
                starts = [0, *ends]
                digests += [hashlib.blake2b(joined[starts[i]:ends[i + window - 1] - 1], digest_size=16).digest()
                            for i in hits]
                owners += [owner] * len(hits)
                places += [tag << 32 | i for i in hits]
        pair = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
        return [np.ascontiguousarray(pair[:, 0]), np.ascontiguousarray(pair[:, 1]), owners, places]

    return map_rows(texts.select(key, text, "tag"), kernel, fields(f"hi long, lo long, `{key}` {kind}, place long"), binary=(text,))


def _removed(hits: list[int], n: int, window: int) -> np.ndarray:
    """Flags of the words that the windows starting at ``hits`` cover."""
    edges = np.zeros(n + 1, np.int64)
    at = np.array(hits, np.int64)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + window, -1)
    return np.cumsum(edges)[:n] > 0


def remove_repeats(df: DataFrame, text: str = "text", key: str = "doc_id", window: int = 50) -> DataFrame:
    """Rows ``(key, n_words, n_removed, kept)``, one for each row of ``df``.

    Words are maximal runs of other than ASCII white space. Removed is each word covered by a window
    of ``window`` words whose sequence also starts in a document with a smaller key; windows are
    judged on the input. ``kept`` joins the other words by one space.
    Null and empty texts have no words (``kept`` is empty). Rows with equal keys are one document;
    rows with a null key lose nothing and take nothing from others. An empty table gives an empty
    result; other columns are not read. Texts are moved once, to meet their removed windows.
    """
    kind = df.schema[key].dataType.simpleString()
    # A hash of the text tells rows of one key apart.
    rows = df.select(key, text, F.xxhash64(text).bitwiseAND(0x7FFFFFFF).alias("tag"))

    def outline(keys: list, bodies: list, tags: list) -> list:
        words = [b.split() if b else [] for b in bodies]
        return [keys, tags, [len(w) for w in words], [hashlib.blake2b(b" ".join(w), digest_size=16).digest() for w in words]]

    outlines = staged(map_rows(rows, outline, fields(f"`{key}` {kind}, tag long, n long, digest binary"),
                               binary=(text,)), "outlines")
    long = outlines.filter((F.col("n") >= window) & F.col(key).isNotNull())
    firsts = long.groupBy("digest").agg(F.min(key).alias("first"), F.max(key).alias("last"), F.first("n").alias("n"))
    firsts = staged(firsts, "firsts")
    total = firsts.agg(F.sum("n")).first()[0] or 0
    # Copies: every window of theirs starts in the first document of the sequence.
    copies = long.join(firsts.filter(F.col("last") > F.col("first")).select("digest", "first"), "digest").filter(
        F.col(key) > F.col("first")).select(key, "tag", F.lit(True).alias("copy")).distinct()
    copies = staged(copies, "copies")
    texts = rows.filter(F.col(key).isNotNull()).join(copies, [key, "tag"], "left_anti")

    run = min(RUN, window)
    wanted = CELLS_PER_ANCHOR * 2 * total // (window - run + 2) + 1
    width = min(max(LEAST_WIDTH, int(wanted).bit_length()), MOST_WIDTH)
    spark = df.sparkSession
    bits = spark.sparkContext.broadcast(_merged(_sketches(texts, text, window, width), width))

    # The windows are made again for the join: fewer bytes to write, and a table of first starts of its own
    # lets adaptive execution split the windows that very many documents share.
    windows = _candidates(texts, text, key, window, width, bits)
    starts = staged(windows.groupBy("hi", "lo").agg(F.min(key).alias("first"), F.max(key).alias("last")).filter(
        F.col("last") > F.col("first")).select("hi", "lo", "first"), "starts")
    hits = windows.join(starts, ["hi", "lo"]).filter(F.col(key) > F.col("first")).groupBy(
        key, F.shiftright("place", 32).alias("tag")).agg(F.sort_array(F.collect_set("place")).alias("hits"))  # at most a document's own words
    marks = hits.withColumn("copy", F.lit(False)).unionByName(copies.withColumn("hits", F.array().cast("array<long>")))

    def cut(keys: list, bodies: list, copied: list, hits: list) -> list:
        out = [keys, [], [], []]
        for body, copy, at in zip(bodies, copied, hits):
            words = body.split() if body else []
            own = [i & 0xFFFFFFFF for i in at or ()]
            gone = np.ones(len(words), bool) if copy else _removed(own, len(words), window)
            kept = words if not gone.any() else [w for w, g in zip(words, gone.tolist()) if not g]
            for column, value in zip(out[1:], (len(words), len(words) - len(kept), b" ".join(kept).decode())):
                column.append(value)
        return out

    return map_rows(rows.join(marks, [key, "tag"], "left").select(key, text, "copy", "hits"), cut,
                    fields(f"`{key}` {kind}, n_words long, n_removed long, kept string"), binary=(text,))
