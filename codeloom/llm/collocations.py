"""Phrase collocation mining (11): SON partitioning, then exact counts of all candidates.

The corpus is dealt into ``SHARDS`` shards. Each is mined completely at the support lowered in proportion,
ceil(support / SHARDS): if a phrase reached it in no shard, it would have at most SHARDS times one less,
which is under the support. So the union of the locally frequent phrases holds every frequent one, however
uneven the shards are. A phrase whose known counts, with one less than the local support for each other shard,
stay under the support leaves the union.

A shard is as large as the corpus makes it, so it is mined by many tasks: they count hashes of its phrases,
Spark adds the counts up. Words and pairs come first; longer phrases are counted only where all of
their pairs are frequent in the shard. Tasks know frequent hashes by a table of bits of bounded size; where it
is wrong (equal hashes or equal bits) it lets a phrase through. Then all candidates are counted over the
whole corpus as the strings they are, and what is under the support goes.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.common import fields, map_rows
from codeloom.session import staged

SUPPORT = 30
LONGEST = 4  # words of a phrase
SHARD_BITS = 3
SHARDS = 1 << SHARD_BITS
UNKNOWN = "und"

HELD = 4_000_000  # phrases that a task holds before it counts them
NAMED = 800_000  # phrases whose words a task remembers
MEMO_WORDS = 500_000  # words whose hashes a task remembers
_BATCH_ROWS = 250_000
# Bits of the table of frequent hashes: 16 for each, up to 2**28 (32 MB an executor). Beyond, more phrases get through.
LEAST_WIDTH, MOST_WIDTH = 15, 28
RANK_PARTS = 64
PIECE_BITS = 15  # bits of the table that a row has when it is put together

_BREAK = 0xFF  # stands for a separator of pieces; no UTF-8 text holds this byte
_TABLE = bytes(_BREAK if chr(b) in ".,;:!?\n\x0b\x0c\r" else 0x20 if b == 9 else b for b in range(256))
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_SHARD = np.uint64(SHARDS - 1)


def words_of(text: bytes) -> list[bytes]:
    """Words in order, A-Z lower-cased, with a word of the byte 0xFF between pieces."""
    return text.lower().translate(_TABLE).replace(b"\xff", b" \xff ").split()


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(30))) * _B
    return values ^ (values >> np.uint64(31))


class _Hashes(dict):
    """Hashes of words, kept while they are few."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_HASHES = _Hashes()
_BREAK_HASH = np.uint64(xxhash.xxh64_intdigest(b"\xff"))


class Phrases:
    """The words of several texts end to end, and hashes of their phrases by language."""

    def __init__(self, texts: list[bytes | None], langs: list[bytes]) -> None:
        self.words: list[bytes] = []
        sizes = []
        for text in texts:
            own = words_of(text) if text else []
            own.append(b"\xff")
            self.words += own
            sizes.append(len(own))
        self.text = np.repeat(np.arange(len(texts)), sizes)
        self._hash = np.fromiter(map(_HASHES.__getitem__, self.words), np.uint64, len(self.words))
        self.word = self._hash != _BREAK_HASH
        self._seed = np.fromiter(map(xxhash.xxh64_intdigest, langs), np.uint64, len(langs))[self.text]

    def levels(self, longest: int):
        """For 1, 2, ... words: hash of the phrase that starts at each place, and whether there is one."""
        value, there = _mixed(self._hash + self._seed * _A), self.word
        yield value, there
        for n in range(2, longest + 1):
            value = _mixed(value[:-1] * _A + self._hash[n - 1:])
            there = there[:-1] & self.word[n - 1:]
            yield value, there

    def phrase(self, start: int, n: int) -> str:
        return b" ".join(self.words[start:start + n]).decode()


class Tally:
    """Counts by hash, with a name for each, in arrays that stay sorted."""

    def __init__(self) -> None:
        self.known, self.n, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.names: list[tuple[str, str, int]] = []

    def add(self, hashes: np.ndarray, n: np.ndarray, name) -> None:
        """Add counts of distinct sorted hashes; ``name(i)`` tells that of the i-th, asked where it is new."""
        at = np.minimum(np.searchsorted(self.known, hashes), max(0, len(self.known) - 1))
        old = self.known[at] == hashes if len(self.known) else np.zeros(len(hashes), bool)
        self.n[at[old]] += n[old]
        new = np.flatnonzero(~old)
        places = np.arange(len(self.names), len(self.names) + len(new))
        self.names += map(name, new.tolist())
        into = np.searchsorted(self.known, hashes[new])
        self.known = np.insert(self.known, into, hashes[new])
        self.n = np.insert(self.n, into, n[new])
        self.place = np.insert(self.place, into, places)

    def rows(self):
        """Columns (lang, phrase, words, count) of all, in pieces; then nothing is left."""
        n = np.empty(len(self.names), np.int64)
        n[self.place] = self.n
        for at in range(0, len(n), _BATCH_ROWS):
            yield [*map(list, zip(*self.names[at:at + _BATCH_ROWS])), n[at:at + _BATCH_ROWS]]
        self.__init__()


class Bits:
    """A table of bits that holds every hash put into it."""

    def __init__(self, width: int, bits: bytes) -> None:
        self._shift, self._bits = np.uint64(64 - width), np.frombuffer(bits, np.uint8)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        at = cells(hashes, 64 - int(self._shift))
        return (self._bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def cells(hashes: np.ndarray, width: int) -> np.ndarray:
    return (_mixed(hashes) * _A) >> np.uint64(64 - width)


def bit_table(hashes: DataFrame, n: int) -> tuple[int, bytes]:
    """(log2 of the bits, bits) that hold all ``hashes(h)``, of which there are ``n``.

    Tasks make pieces of the table, which are put together on the driver: 32 MB at most.
    """
    width = int(np.clip(np.ceil(np.log2(16 * n + 1)), LEAST_WIDTH, MOST_WIDTH))

    def placed(values: list) -> list:
        at = cells(np.array(values, np.int64).view(np.uint64), width)
        return [(at >> np.uint64(PIECE_BITS)).astype(np.int64), (at & np.uint64((1 << PIECE_BITS) - 1)).astype(np.int32)]

    def start():
        held: dict[int, np.ndarray] = {}

        def step(pieces: list, at: list) -> list | None:
            pieces, at, out = np.array(pieces), np.array(at), []
            for piece in np.unique(pieces).tolist():
                if piece not in held:
                    out += finish_rows()
                    held[piece] = np.zeros(1 << PIECE_BITS, bool)
                held[piece][at[pieces == piece]] = True
            return [list(c) for c in zip(*out)] if out else None

        def finish_rows() -> list:
            rows = [(p, np.packbits(b, bitorder="little").tobytes()) for p, b in held.items()]
            held.clear()
            return rows

        def finish() -> list | None:
            rows = finish_rows()
            return [list(c) for c in zip(*rows)] if rows else None

        return step, finish

    pieces = map_rows(hashes.select("h"), placed, fields("piece long, at int")).distinct()
    dealt = pieces.repartition("piece").sortWithinPartitions("piece")
    size = (1 << PIECE_BITS) // 8
    out = bytearray((1 << width) // 8)
    for row in map_rows(dealt, start, fields("piece long, bits binary"), per_task=True).collect():  # bounded by the table
        out[row["piece"] * size:(row["piece"] + 1) * size] = row["bits"]
    return width, bytes(out)


def _counted(rows: DataFrame, chosen) -> DataFrame:
    """Rows ``(h, n)``: hashes that ``chosen(phrases, shards)`` yields from a slice, with their counts.

    Each task adds up what it can hold; Spark adds up the rest.
    """
    most = HELD

    def start():
        held: list[np.ndarray] = []

        def flush():
            values = np.concatenate(held) if held else np.zeros(0, np.uint64)
            held.clear()
            values.sort()
            first = np.flatnonzero(np.r_[True, values[1:] != values[:-1]][:len(values)])
            n, values = np.diff(np.r_[first, len(values)]), values[first].view(np.int64)
            for at in range(0, len(values), _BATCH_ROWS):
                yield [values[at:at + _BATCH_ROWS], n[at:at + _BATCH_ROWS]]

        def step(texts: list, langs: list, shards: list):
            phrases = Phrases(texts, langs)
            held.extend(chosen(phrases, np.array(shards, np.uint64)[phrases.text]))
            return flush() if sum(map(len, held)) > most else None

        return step, flush

    found = map_rows(rows, start, fields("h long, n long"), binary=("text", "lang"), per_task=True)
    # Most phrases of a task are its only ones: to add up before the shuffle would cost more than it saves.
    return found.repartition("h").groupBy("h").agg(F.sum("n").alias("n"))


def _in_shard(values: np.ndarray, shards: np.ndarray) -> np.ndarray:
    """Hashes with the shard in the low bits: counts of a shard are a matter of their own."""
    return values & ~_SHARD | shards[:len(values)]


def _short(phrases: Phrases, shards: np.ndarray):
    for value, there in phrases.levels(2):
        yield _in_shard(value, shards)[there]


def _long(longest: int, table: Bits):
    def chosen(phrases: Phrases, shards: np.ndarray):
        frequent = None
        for n, (value, there) in enumerate(phrases.levels(longest), 1):
            if n == 2:
                frequent = pair = there.copy()
                at = np.flatnonzero(there)
                pair[at] = table.holds(_in_shard(value, shards)[at])
            elif n > 2:  # all of its pairs
                frequent = frequent[:-1] & pair[n - 2:]
                at = np.flatnonzero(frequent)
                yield _in_shard(value, shards)[at]

    return chosen


def phrase_counts(df: DataFrame, text: str = "text", lang: str = "lang", support: int = SUPPORT,
                  longest: int = LONGEST) -> DataFrame:
    """Rows ``(lang, phrase, n_words, f)`` of all phrases of up to ``longest`` words that stand ``support``
    times or more in a language; the row with an empty phrase has the number of all words.

    Pieces are split at ``.,;:!?`` and line breaks, words at spaces and tabs; phrases lie within a
    piece and overlap. A null language is ``und``; null and empty texts have no words.
    """
    spark = df.sparkSession
    rows = df.select(F.col(text).alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"),
                     F.xxhash64(*df.columns).bitwiseAND(SHARDS - 1).cast("int").alias("shard"))
    local = -(-support // SHARDS)
    frequent = lambda found, name: staged(found.filter(F.col("n") >= local), name)

    short = frequent(_counted(rows, _short), "short")
    table = spark.sparkContext.broadcast(bit_table(short, short.count()))
    long = frequent(_counted(rows, lambda p, s: _long(longest, Bits(*table.value))(p, s)), "long")

    # Where a phrase is not frequent it has at most local - 1: what the shards leave possible bounds its count.
    possible = F.sum(F.col("n") - (local - 1)) + SHARDS * (local - 1)
    union = staged(short.unionByName(long).groupBy(F.col("h").bitwiseAND(~(SHARDS - 1)).alias("h")).agg(
        possible.alias("n")).filter(F.col("n") >= support).select("h"), "candidates")
    wanted = spark.sparkContext.broadcast(bit_table(union, union.count()))
    most = NAMED

    def start():
        table, tally = Bits(*wanted.value), Tally()
        words: dict[str, int] = {}

        def flush():
            yield from tally.rows()
            if words:
                yield [list(words), [""] * len(words), [0] * len(words), list(words.values())]
                words.clear()

        def step(texts: list, langs: list):
            phrases = Phrases(texts, langs)
            for i, n in zip(*(x.tolist() for x in np.unique(phrases.text[phrases.word], return_counts=True))):
                own = langs[i].decode()
                words[own] = words.get(own, 0) + n
            found, starts, sizes = [], [], []
            for n, (value, there) in enumerate(phrases.levels(longest), 1):
                at = np.flatnonzero(there)
                at = at[table.holds(value[at] & ~_SHARD)]
                found.append(value[at])
                starts.append(at)
                sizes.append(np.full(len(at), n))
            found, starts, sizes = map(np.concatenate, (found, starts, sizes))
            order = np.argsort(found)
            found, starts, sizes = found[order], starts[order], sizes[order]
            first = np.flatnonzero(np.r_[True, found[1:] != found[:-1]][:len(found)])
            starts, sizes = starts[first], sizes[first]
            names = [x.decode() for x in langs]

            def name(i: int) -> tuple[str, str, int]:
                start, n = int(starts[i]), int(sizes[i])
                return names[phrases.text[start]], phrases.phrase(start, n), n

            tally.add(found[first], np.diff(np.r_[first, len(found)]), name)
            return flush() if len(tally.names) > most else None

        return step, flush

    found = map_rows(rows.select("text", "lang"), start, fields("lang string, phrase string, n_words int, f long"),
                     binary=("text", "lang"), per_task=True)
    return found.groupBy("lang", "phrase", "n_words").agg(F.sum("f").alias("f")).filter(
        (F.col("f") >= support) | (F.col("n_words") == 0))


def _scored(counts: DataFrame, share: int, scale: int) -> DataFrame:
    """Rows ``(lang, phrase, a, l, r, score)`` of the phrases of two words or more that no longer one covers."""
    phrases = counts.filter("n_words > 1").withColumn("words", F.split("phrase", " "))
    size = F.size("words")
    part = lambda start, n: F.array_join(F.slice("words", start, n), " ")
    # Both parts of every cut, met by their words.
    cuts = phrases.select("lang", "phrase", F.col("f").alias("a"), "words", F.explode(F.sequence(F.lit(1), F.col("n_words") - 1)).alias("k"))
    parts = cuts.select("lang", "phrase", "a", "k", F.explode(F.array(
        F.struct(F.lit(True).alias("left"), part(F.lit(1), F.col("k")).alias("part")),
        F.struct(F.lit(False).alias("left"), part(F.col("k") + 1, size - F.col("k")).alias("part")))).alias("p"))
    known = counts.filter("n_words > 0").select("lang", F.col("phrase").alias("part"), F.col("f").alias("g"))
    sides = parts.select("lang", "phrase", "a", "k", "p.*").join(known, ["lang", "part"]).groupBy("lang", "phrase", "a", "k").agg(
        F.max(F.when(F.col("left"), F.col("g"))).alias("l"), F.max(F.when(~F.col("left"), F.col("g"))).alias("r"))
    exact = lambda c: F.col(c).cast("decimal(20,0)")
    sides = sides.withColumn("product", (F.lit(scale).cast("decimal(10,0)") * exact("a")).cast("decimal(38,0)")).withColumn(
        "sum", (exact("l") + exact("r")).cast("decimal(38,0)")).withColumn("score", F.expr("product div sum"))
    best = sides.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # Every phrase of two words or more inside a longer one.
    inner = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda n: F.transform(
        F.sequence(F.lit(1), size - n + 1), lambda i: F.array_join(F.slice("words", i, n), " "))))
    around = phrases.filter("n_words > 2").select("lang", F.col("f").alias("longer"), F.explode(F.array_distinct(inner)).alias("phrase")).groupBy(
        "lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = best.join(around, ["lang", "phrase"], "left").filter(
        F.col("longer").isNull() | (F.col("longer").cast("decimal(38,0)") * 100 < F.col("a").cast("decimal(38,0)") * share))
    return kept.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"),
                       F.col("cut.score").cast("long").alias("score"))


def collocations(df: DataFrame, text: str = "text", lang: str = "lang", support: int = SUPPORT, share: int = 80,
                 scale: int = 2_000_000, longest: int = LONGEST, limit: int | None = None) -> DataFrame:
    """Collocations: rows ``(lang, phrase, a, l, r, n, score)``, with a ``limit`` also their ``rank`` from 1
    in their language, by score and count descending, then by phrase, up to it.

    Of each phrase of two words or more that stands ``support`` times, the cut with the least score
    floor(scale a / (l + r)) counts, the first of equals; l and r are the counts of the two parts, n that of
    all words of the language. A phrase goes if a longer one around it has ``share`` percent of its count.
    Nulls, empty texts and phrases as in ``phrase_counts``; repeated rows count each; long texts are
    read whole; an empty table gives an empty result; other columns only help to deal rows to shards.
    """
    counts = staged(phrase_counts(df, text, lang, support, longest), "phrases")
    found, columns = _scored(counts, share, scale), ["lang", "phrase", "a", "l", "r", "n", "score"]
    if limit is not None:
        # First the best of each part of a language, so that no task sorts a language.
        order = [F.desc("score"), F.desc("a"), "phrase"]
        part = F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))
        for group in (["lang", part], ["lang"]):
            found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(
                F.col("rank") <= limit)
        found, columns = found.withColumn("rank", F.col("rank").cast("long")), ["lang", "rank", *columns[1:]]
    total = counts.filter("n_words = 0").select("lang", F.col("f").alias("n"))
    return found.join(total, "lang").select(*columns)
