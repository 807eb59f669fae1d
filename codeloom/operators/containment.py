"""Which passages occur inside which texts: an exact substring join without a nested loop.

Every passage is known by one anchor: the k-gram with the smallest hash inside it. A text shows, for
every window of k-grams, the position of its smallest hash (winnowing; Schleimer, Wilkerson and
Aiken, 2003), so wherever a passage occurs its anchor is among the positions the text shows. A shown
anchor, with the offset and length of the passages that own it, names a piece of the text, and the
piece is joined to the passages by equality. Nothing is emitted per (text, passage) pair: passages
that share an anchor also share their few (offset, length) shapes.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from codeloom.functions.text import strip_all_whitespace
from codeloom.session import staged

# Shortest passage of each class -> k-gram size. A class with passages of at least n characters
# needs windows of n - k + 1 k-grams.
CLASSES = {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 8: 5, 16: 8, 32: 16}
WHOLE = 4  # passages up to this length are their own anchor

# Passages within both bounds are broadcast; larger sets take the shuffled path.
MAX_PASSAGES = 200_000
MAX_PASSAGE_CHARS = 32_000_000

_ANCHOR = T.StructType([
    T.StructField("anchor", T.LongType()), T.StructField("off", T.IntegerType())])


_CHUNK_CHARS = 500_000  # characters whose hashes a task holds at a time, unless one text is longer
_SLICE_ROWS = 256
_NEVER = np.uint64(0xFFFFFFFFFFFFFFFF)


class _Joined:
    """Several strings end to end, with where each starts; k-grams across a seam hash to the maximum."""

    def __init__(self, texts: Sequence[str]) -> None:
        self.codes = np.frombuffer(
            "".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        self.lengths = np.array([len(t) for t in texts], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]]).astype(np.int64)

    def hashes(self, k: int) -> np.ndarray:
        """One hash per character: of the k-gram that starts there."""
        n = len(self.codes)
        h = np.zeros(n, dtype=np.uint64)
        for j in range(k):
            h *= np.uint64(1_000_003)
            if j < n:
                h[:n - j] += self.codes[j:] + np.uint64(1)
        h ^= h >> np.uint64(31)
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        np.minimum(h, _NEVER - np.uint64(1), out=h)
        ends = self.starts + self.lengths
        for j in range(1, k):
            h[np.maximum(ends - j, 0)[self.lengths >= j]] = _NEVER
        return h


def _sliding(h: np.ndarray, w: int, pick) -> np.ndarray:
    """pick over h[i : i + w] for every i, in log2(w) steps; windows are cut short at the end."""
    out, width = h.copy(), 1
    while width < w:
        step = min(width, w - width)
        if step >= len(out):
            break
        out[:len(out) - step] = pick(out[:len(out) - step], out[step:])
        width += step
    return out


def shown_positions(joined: _Joined, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, position) of the k-grams the strings show for passages of ``size`` characters or more:
    those that are smallest in some window. Windows across seams only add positions."""
    h = joined.hashes(CLASSES[size])
    w = size - CLASSES[size] + 1
    if w > 1 and len(h):
        low = _sliding(h, w, np.minimum)
        highest = _sliding(low[::-1], w, np.maximum)[::-1]
        pos = np.flatnonzero((highest == h) & (h != _NEVER))
    else:
        pos = np.flatnonzero(h != _NEVER)
    return h[pos].astype(np.int64), pos


def passage_anchors(texts: Sequence[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, offset) of each passage of one class: its smallest k-gram hash, leftmost."""
    joined = _Joined(texts)
    h = joined.hashes(CLASSES[size])
    least = np.minimum.reduceat(h, joined.starts)
    at = np.flatnonzero(h == np.repeat(least, joined.lengths))
    first = at[np.searchsorted(at, joined.starts)]
    return least.astype(np.int64), first - joined.starts


def _class_of(length: Column) -> Column:
    size = F.lit(None).cast("int")
    for n in sorted(CLASSES, reverse=True):
        size = F.coalesce(size, F.when(length >= n, n))
    return size


@F.pandas_udf(_ANCHOR)
def _anchor(text: pd.Series, size: pd.Series) -> pd.DataFrame:
    out = pd.DataFrame({"anchor": 0, "off": 0}, index=text.index)
    for n, part in text.groupby(size):
        anchors, offs = passage_anchors(part.tolist(), int(n))
        out.loc[part.index, "anchor"], out.loc[part.index, "off"] = anchors, offs
    return out.astype({"anchor": "int64", "off": "int32"})


def _size_of(length: int) -> int:
    return max(n for n in CLASSES if n <= length)


def _shape_table(passages: Sequence[str]) -> dict[int, tuple[np.ndarray, dict[int, list[tuple[int, int]]]]]:
    """Per class: the sorted anchors, and the (offset, length) shapes of each."""
    by_size: dict[int, list[str]] = {}
    for p in passages:
        by_size.setdefault(_size_of(len(p)), []).append(p)
    table = {}
    for size, texts in by_size.items():
        shapes: dict[int, set[tuple[int, int]]] = {}
        anchors, offs = passage_anchors(texts, size)
        for anchor, off, text in zip(anchors.tolist(), offs.tolist(), texts):
            shapes.setdefault(anchor, set()).add((off, len(text)))
        table[size] = (np.array(sorted(shapes), dtype=np.int64), {a: sorted(v) for a, v in shapes.items()})
    return table


def _chunks(texts: Sequence[str]) -> Iterator[list[str]]:
    chunk, held = [], 0
    for text in texts:
        chunk.append(text)
        held += len(text)
        if held >= _CHUNK_CHARS:
            yield chunk
            chunk, held = [], 0
    if chunk:
        yield chunk


def _found_in(texts: list[str], table, known: set[str]) -> list[list[str]]:
    """Per text, the known passages in it."""
    found: list[set[str]] = [set() for _ in texts]
    joined = _Joined(texts)
    for size, (anchors, shapes) in table.items():
        values, pos = shown_positions(joined, size)
        at = np.minimum(np.searchsorted(anchors, values), len(anchors) - 1)
        keep = anchors[at] == values
        values, pos = values[keep], pos[keep]
        owner = np.searchsorted(joined.starts, pos, side="right") - 1
        if size <= WHOLE:  # the anchor is the passage: once per text is enough
            _, once = np.unique(np.stack([owner, values]), axis=1, return_index=True)
            values, pos, owner = values[once], pos[once], owner[once]
        local = pos - joined.starts[owner]
        for anchor, p, i in zip(values.tolist(), local.tolist(), owner.tolist()):
            for off, n in shapes[anchor]:
                piece = texts[i][p - off:p - off + n] if p >= off else ""
                if piece in known:
                    found[i].add(piece)
    return [list(f) for f in found]


def _per_text(texts: DataFrame, found, schema: T.StructType) -> DataFrame:
    """Rows ``(other columns of texts, what found says of _text)``, made and sent in pieces of bounded size.

    ``found`` takes some texts and gives the index of a text for each row, and the rows' further columns.
    """
    names = [f.name for f in schema]
    arrow = to_arrow_schema(schema)
    kept = [i for i, name in enumerate(texts.columns) if name != "_text"]
    body = texts.columns.index("_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _SLICE_ROWS):
                part, first = batch.slice(at, _SLICE_ROWS), 0
                for chunk in _chunks(part.column(body).to_pylist()):
                    owner, columns = found(chunk)
                    if len(owner):
                        rows = pa.array(np.asarray(owner, np.int64) + first)
                        yield pa.RecordBatch.from_arrays(
                            [part.column(i).take(rows).cast(arrow.field(n).type) for n, i in enumerate(kept)]
                            + [pa.array(c, arrow.field(len(kept) + n).type) for n, c in enumerate(columns)], names=names)
                    first += len(chunk)

    return texts.mapInArrow(run, schema)


def _broadcast_matches(texts: DataFrame, passages: Sequence[str], passage: str,
                       squeeze: bool) -> DataFrame:
    shared = texts.sparkSession.sparkContext.broadcast((_shape_table(passages), set(passages)))

    def found(chunk: list[str]) -> tuple[list[int], list[list[str]]]:
        table, known = shared.value
        rows = _found_in(["".join(t.split()) for t in chunk] if squeeze else chunk, table, known)
        return [i for i, own in enumerate(rows) for _ in own], [[p for own in rows for p in own]]

    return _per_text(texts, found, T.StructType(
        [f for f in texts.schema if f.name != "_text"] + [T.StructField(passage, T.StringType())]))


# Anchors that passages own, as bits by their hash: a text shows only such. At most 2**27 bits (16 MB).
_LEAST_BITS, _MOST_BITS, _BUCKET = 1 << 15, 1 << 27, 1 << 15


def _owned_bits(shapes: DataFrame) -> np.ndarray:
    width = min(max(_LEAST_BITS, 1 << (16 * max(shapes.count(), 1)).bit_length()), _MOST_BITS)
    place = shapes.select((F.col("anchor").bitwiseAND(width - 1) + 1).alias("p"))
    out = np.zeros(width // 8, np.uint8)
    for row in place.groupBy(F.bitmap_bucket_number("p").alias("at")).agg(
            F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits")).collect():  # at most _MOST_BITS in all
        out[(row["at"] - 1) * (_BUCKET // 8):row["at"] * (_BUCKET // 8)] = np.frombuffer(row["bits"], np.uint8)
    return out


def _shuffled_matches(texts: DataFrame, distinct: DataFrame, text_id: str, keys: list[str],
                      passage: str) -> DataFrame:
    shapes = staged(
        distinct.withColumn("size", _class_of(F.length(passage)))
        .withColumn("_a", _anchor(passage, "size"))
        .select(*keys, "size", F.col("_a.anchor").alias("anchor"), F.col("_a.off").alias("off"),
                F.length(passage).alias("len")).dropDuplicates(), "shapes")
    spark = texts.sparkSession
    sizes = sorted(r[0] for r in shapes.select("size").distinct().collect())
    owned = spark.sparkContext.broadcast(_owned_bits(shapes))

    def shown(chunk: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
        bits = owned.value
        joined = _Joined(chunk)
        out: list[tuple] = []
        for size in sizes:
            values, pos = shown_positions(joined, size)
            at = values & (len(bits) * 8 - 1)
            mine = (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
            values, pos = values[mine], pos[mine]
            owner = np.searchsorted(joined.starts, pos, side="right") - 1
            if size <= WHOLE:
                _, once = np.unique(np.stack([owner, values]), axis=1, return_index=True)
                values, pos, owner = values[once], pos[once], owner[once]
            out.append((owner, np.full(len(pos), size), values, pos - joined.starts[owner]))
        owner, *columns = map(np.concatenate, zip(*out)) if out else [np.zeros(0, np.int64)] * 4
        return owner, columns

    located = (
        _per_text(texts, shown, T.StructType([f for f in texts.schema if f.name != "_text"] + [
            T.StructField("size", T.IntegerType()), T.StructField("anchor", T.LongType()), T.StructField("pos", T.IntegerType())]))
        .join(shapes, [*keys, "size", "anchor"])
        .select(text_id, (F.col("pos") - F.col("off") + 1).alias("_start"), "len")
        .filter("_start >= 1").distinct()
    )
    pieces = located.join(texts, text_id).select(
        text_id, *keys, F.substr("_text", "_start", "len").alias(passage)).dropDuplicates()
    return pieces.join(distinct, [*keys, passage], "left_semi")


def contained(texts: DataFrame, passages: DataFrame, text_id: str, text: str, passage: str,
              keys: Sequence[str] = (), squeeze: bool = False,
             max_passages: int = MAX_PASSAGES) -> DataFrame:
    """Distinct (``text_id``, *keys, ``passage``) where the passage occurs in the text, with
    ``squeeze`` after all whitespace is taken out of the text.

    ``text_id`` must be unique per text. With ``keys``, only texts and passages that agree on them
    are compared. Empty passages occur in every text, no passage occurs in a null text. A passage set of proven small size is
    broadcast, and texts then are not shuffled at all; any other set meets the texts by shuffles.
    """
    keys = list(keys)
    texts = texts.select(text_id, *keys, F.col(text).alias("_text")).filter("_text IS NOT NULL")
    distinct = passages.select(*keys, passage).filter(F.col(passage).isNotNull()).dropDuplicates()
    wording = distinct.select(passage).dropDuplicates() if keys else distinct
    n, chars = wording.agg(F.count("*"), F.coalesce(F.sum(F.length(passage)), F.lit(0))).first()

    if n <= max_passages and chars <= MAX_PASSAGE_CHARS:
        words = [r[0] for r in wording.collect()]
        filled = [w for w in words if w]
        parts = [_broadcast_matches(texts, filled, passage, squeeze)] if filled else []
        if keys:
            parts = [p.join(distinct, [*keys, passage], "left_semi") for p in parts]
        if len(filled) < len(words):
            everywhere = texts.drop("_text").withColumn(passage, F.lit(""))
            if keys:
                everywhere = everywhere.join(
                    distinct.filter(F.length(passage) == 0).select(*keys), keys, "left_semi")
            parts.append(everywhere)
    else:
        if squeeze:
            texts = texts.withColumn("_text", strip_all_whitespace(F.col("_text")))
        parts = [_shuffled_matches(
            texts, distinct.filter(F.length(passage) > 0), text_id, keys, passage)]
        blank = distinct.filter(F.length(passage) == 0)
        if keys:
            parts.append(texts.drop("_text").join(blank, keys))
        elif blank.limit(1).count():
            parts.append(texts.select(text_id, F.lit("").alias(passage)))
    if not parts:
        return texts.drop("_text").withColumn(passage, F.lit("")).limit(0)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def match_passages(texts: DataFrame, passages: DataFrame, text_id: str, text: str,
                   passage_id: str, passage: str) -> DataFrame:
    """(``text_id``, ``passage_id``) where a passage of two or more characters occurs in a text,
    whitespace aside."""
    long_enough = passages.filter(F.length(passage) > 1).select(
        passage_id, strip_all_whitespace(F.col(passage)).alias("_norm"))
    found = contained(texts, long_enough, text_id, text, "_norm", squeeze=True)
    return found.join(long_enough, "_norm").select(text_id, passage_id).distinct()


MAX_LENGTHS = 64  # of passages, each of which costs a pass over the hashes of a text
_BASE = np.uint64(0xD1342543DE82EF95)  # odd, so that products never lose the low bits


_SPAN = 1 << 15  # places of a text that are tested at a time
_TOLD = 20  # bits of the number of pieces that a task remembers
_PROBES = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Falling powers of the base, and the powers that undo them."""
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    return tuple(np.multiply.accumulate(np.r_[np.uint64(1), np.full(max(n - 1, 0), by)])[:n] for by in (inverse, _BASE))


def _piece_sums(joined: _Joined, fall: np.ndarray) -> np.ndarray:
    """Running sums of characters times falling powers. Equal pieces have equal hashes wherever they stand: the sums
    between their ends, times the power of where they begin."""
    codes = joined.codes + np.uint64(1)
    codes *= fall[:len(codes)]
    return np.r_[np.uint64(0), np.add.accumulate(codes)]


def _places(h: np.ndarray, probe: int, mask: int) -> np.ndarray:
    return ((h * _PROBES[probe]) >> np.uint64(32)).view(np.int64) & mask


@F.pandas_udf(T.ArrayType(T.LongType()))
def _whole_places(texts: pd.Series) -> pd.Series:
    joined = _Joined(texts.tolist())
    fall, rise = _powers(len(joined.codes))
    sums = _piece_sums(joined, fall)
    h = (sums[joined.starts + joined.lengths] - sums[joined.starts]) * rise[joined.starts]
    return pd.Series(list(np.stack([_places(h, i, 0xFFFFFFFF) for i in range(len(_PROBES))], axis=1)))


def occurring(texts: DataFrame, passages: DataFrame, text_id: str, text: str, passage: str) -> DataFrame:
    """Distinct (``passage``) that occur in any text; the texts' ids need not be unique.

    Pieces of a text that are as long as some passage are tested by their hash against bits of all
    passages, two for each, and a piece that passes leaves a task, to be compared by name, unless it is among those that the
    task remembers having told. No row is made for a text. Passages of more than ``MAX_LENGTHS`` lengths go the way of ``contained``.
    """
    distinct = staged(passages.select(passage).filter(F.col(passage).isNotNull()).dropDuplicates(), "passages")
    filled = distinct.filter(F.length(passage) > 0)
    lengths = sorted(r[0] for r in filled.select(F.length(passage).alias("n")).distinct().limit(MAX_LENGTHS + 1).collect())
    if len(lengths) > MAX_LENGTHS:
        return contained(texts, distinct, text_id, text, passage).select(passage).distinct()
    bodies = texts.select(F.col(text).alias("_text")).filter("_text IS NOT NULL")
    blank = distinct.filter(F.length(passage) == 0)
    owned = texts.sparkSession.sparkContext.broadcast(_owned_bits(filled.select(F.explode(_whole_places(passage)).alias("anchor"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, (fall, rise) = owned.value, _powers(_CHUNK_CHARS)
        mask = len(bits) * 8 - 1
        told = np.zeros(1 << _TOLD, np.uint64)
        told[0] = 1  # whose place is another one, as is that of each number but 0 that could stand here

        def owns(h: np.ndarray, probe: int) -> np.ndarray:
            place = _places(h, probe, mask)
            return np.flatnonzero(bits[place >> 3] >> (place & 7).astype(np.uint8) & 1)

        for batch in batches:
            for at in range(0, batch.num_rows, _SLICE_ROWS):
                for chunk in _chunks(batch.column(0).slice(at, _SLICE_ROWS).to_pylist()):
                    joined, whole, pieces = _Joined(chunk), "".join(chunk), []
                    if len(joined.codes) > len(fall):
                        fall, rise = _powers(len(joined.codes))
                    sums = _piece_sums(joined, fall)
                    ends = np.repeat(joined.starts + joined.lengths, joined.lengths)
                    for n in lengths:
                        new, begins = [], []
                        for low in range(0, len(joined.codes) - n + 1, _SPAN):
                            high = min(low + _SPAN, len(joined.codes) - n + 1)
                            h = (sums[low + n:high + n] - sums[low:high]) * rise[low:high]
                            begin = owns(h, 0)
                            h = h[begin]
                            second = owns(h, 1)
                            begin, h = begin[second] + low, h[second]
                            slot = ((h * _PROBES[0]) >> np.uint64(64 - _TOLD)).view(np.int64)
                            fresh = np.flatnonzero((told[slot] != h) & (ends[begin] >= begin + n))
                            told[slot[fresh]] = h[fresh]
                            new.append(h[fresh])
                            begins.append(begin[fresh])
                        if new:
                            _, first = np.unique(np.concatenate(new), return_index=True)
                            pieces += [whole[b:b + n] for b in np.concatenate(begins)[first].tolist()]
                    if pieces:
                        yield pa.RecordBatch.from_arrays([pa.array(pieces, pa.string())], names=[passage])

    schema = T.StructType([T.StructField(passage, T.StringType())])
    found = distinct.join(bodies.mapInArrow(run, schema).distinct(), passage, "left_semi")
    return found.unionByName(blank) if blank.limit(1).count() and bodies.limit(1).count() else found
