"""Skip-gram word vectors whose vocabulary is never in one place.

Words are counted on the cluster. Each task then trains on its own rows, with vectors of the words that
these hold: a word begins with the same vector in every task, negative words are drawn from the
task's text, and a block of tokens shares them, so that the work is matrix products. The vectors of a word
are averaged over the tasks by how often it stood in each, in shards of bounded size, and stay a table.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.operators.scale import spread_small
from codeloom.session import staged

TASK_TOKENS = 8_000_000  # a task's vocabulary is bounded by its tokens
SHARD_BYTES = 32_000_000  # of the vectors averaged at a time
BLOCK = 512  # consecutive tokens that share negative words
TILE = 32  # centres whose neighbours are met by one product
SHARED, NEGATIVES = 64, 5  # shared negative words, and what they stand for at each pair
RATE = 0.025
# Bits by the words' hashes show a task which words are frequent enough: at most 2**27, 16 MB. Words that they let
# pass in error are trained with the others and then left out by name.
LEAST_BITS, MOST_BITS = 1 << 15, 1 << 27
_BUCKET = 1 << 15  # bits of a bitmap of Spark's


@dataclass(frozen=True)
class WordVectors:
    """A table ``(word, vector)``, vectors as arrays of floats."""

    table: DataFrame

    def getVectors(self) -> DataFrame:  # noqa: N802 (as Spark's model names it)
        return self.table.select("word", array_to_vector("vector").alias("vector"))

    def findSynonyms(self, word: str, num: int) -> DataFrame:  # noqa: N802
        """(word, similarity) of the ``num`` other words with the largest cosine."""
        own = self.table.filter(F.col("word") == word).select(F.col("vector").alias("_own"))
        dot = lambda a, b: F.aggregate(
            F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, v: s + v)
        size = F.sqrt(dot(F.col("vector"), F.col("vector")) * dot(F.col("_own"), F.col("_own")))
        return self.table.filter(F.col("word") != word).crossJoin(F.broadcast(own)).select(  # one row
            "word", F.try_divide(dot(F.col("vector"), F.col("_own")), size).alias("similarity")).orderBy(
            F.desc("similarity"), "word").limit(num)


def first_vectors(codes: np.ndarray, size: int, seed: int) -> np.ndarray:
    """The vectors that words with these hashes begin with, the same in every task."""
    mixed = (codes.astype(np.uint64)[:, None] + np.uint64(seed << 32)) * np.uint64(0x9E3779B97F4A7C15)
    mixed = mixed + np.arange(1, size + 1, dtype=np.uint64)[None, :] * np.uint64(0xD1B54A32D192ED03)
    mixed ^= mixed >> np.uint64(30)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(31)
    return (((mixed >> np.uint64(40)).astype(np.float32) / np.float32(1 << 24)) - np.float32(0.5)) / np.float32(size)


class Trainer:
    """Vectors of the words of one task: ``own`` as centres, ``other`` as neighbours."""

    def __init__(self, size: int, window: int, seed: int):
        self.size, self.window, self.seed = size, window, seed
        self.ids: dict[str, int] = {}
        self.own = np.zeros((1024, size), np.float32)
        self.other = np.zeros((1024, size), np.float32)
        self.times = np.zeros(1024, np.int64)

    def ids_of(self, words: list[str], codes: np.ndarray) -> np.ndarray:
        new = [i for i, w in enumerate(words) if w not in self.ids]
        first, last = len(self.ids), len(self.ids) + len(new)
        if last > len(self.own):
            more = max(last, len(self.own) * 3 // 2) - len(self.own)
            self.own, self.other = (np.concatenate((m, np.zeros((more, self.size), np.float32))) for m in (self.own, self.other))
            self.times = np.concatenate((self.times, np.zeros(more, np.int64)))
        self.own[first:last] = first_vectors(codes[new], self.size, self.seed)
        self.ids.update((words[i], first + n) for n, i in enumerate(new))
        return np.fromiter(map(self.ids.__getitem__, words), np.int64, len(words))

    def learn(self, tokens: np.ndarray, sentences: np.ndarray, rate: float, random: np.random.Generator) -> None:
        """One pass over consecutive tokens; pairs stay within a sentence."""
        words, times = np.unique(tokens, return_counts=True)
        drawn = np.cumsum(times ** 0.75)  # negatives: by count, flattened
        for at in range(0, len(tokens), BLOCK):
            negative = words[np.searchsorted(drawn, random.random(SHARED) * drawn[-1], "right").clip(max=len(words) - 1)]
            self._block(tokens[at:at + BLOCK], sentences[at:at + BLOCK], negative, rate, random)

    def _block(self, tokens: np.ndarray, sentences: np.ndarray, negative: np.ndarray, rate: float, random: np.random.Generator) -> None:
        n, w = len(tokens), self.window
        tiles = -(-n // TILE)
        x, y = self.own[tokens], self.other[tokens]
        # Tiles of centres, each against a tile of neighbours that reaches further by a window on both sides.
        place = np.arange(tiles * TILE).reshape(tiles, TILE)
        around = place[:, :1] - w + np.arange(TILE + 2 * w)[None, :]
        held = (around >= 0) & (around < n)
        centre, around = place.clip(max=n - 1), around.clip(0, n - 1)
        reach = random.integers(1, w + 1, n)  # each token's own window
        away = np.abs(np.arange(TILE)[:, None] + w - np.arange(TILE + 2 * w)[None, :])
        use = (away > 0) & (away <= reach[centre][:, :, None]) & (place < n)[:, :, None] & held[:, None, :] & (
            sentences[centre][:, :, None] == sentences[around][:, None, :])
        x_tiles, y_tiles = x[centre], y[around]
        slope = use * (np.float32(rate) / (1 + np.exp(np.clip(x_tiles @ y_tiles.transpose(0, 2, 1), -30, 30))))
        d_x = (slope @ y_tiles).reshape(-1, self.size)[:n]
        d_y = (slope.transpose(0, 2, 1) @ x_tiles)[held]
        pairs = use.sum(axis=2, dtype=np.float32).ravel()[:n]
        z = self.other[negative]
        slope = (np.float32(-rate * NEGATIVES / SHARED) * pairs)[:, None] / (1 + np.exp(-np.clip(x @ z.T, -30, 30)))
        d_z = slope.T @ x / np.float32(max(1, pairs.sum() * NEGATIVES / SHARED) ** 0.5)
        self._add(self.own, tokens, d_x + slope @ z)
        self._add(self.other, np.concatenate((tokens[around[held]], negative)), np.concatenate((d_y, d_z)))

    @staticmethod
    def _add(matrix: np.ndarray, rows: np.ndarray, changes: np.ndarray) -> None:
        """Add the changes of each row; of a frequent one, seen often with the same old values, less."""
        order = np.argsort(rows, kind="stable")
        at = rows[order]
        begins = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        times = np.diff(np.r_[begins, len(at)]).astype(np.float32)
        matrix[at[begins]] += np.add.reduceat(changes[order], begins, axis=0) / np.sqrt(times)[:, None]


def _frequent_bits(vocabulary: DataFrame, width: int) -> np.ndarray:
    """Which hashes frequent words have, modulo ``width``: as bits, of bounded number."""
    place = vocabulary.select((F.pmod(F.crc32(F.col("word").cast("binary")), F.lit(width)) + 1).alias("p"))
    found = place.groupBy(F.bitmap_bucket_number("p").alias("at")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
    out = np.zeros(width // 8, np.uint8)
    for row in found.collect():  # at most MOST_BITS in all
        out[(row["at"] - 1) * (_BUCKET // 8):row["at"] * (_BUCKET // 8)] = np.frombuffer(row["bits"], np.uint8)
    return out


def train_word2vec(sentences: DataFrame, tokens: str, size: int = 100, window: int = 5,
                   min_count: int = 5, partitions: int | None = None, seed: int = 1, iterations: int = 1,
                   ) -> WordVectors:
    """Word vectors of a token-array column, of all words with at least ``min_count`` occurrences.

    Trained in as many tasks as the cluster runs at a time, more for much text, unless ``partitions`` says
    otherwise. Each task passes ``iterations`` times over its rows before the vectors are averaged.
    """
    spark = sentences.sparkSession
    rows = spread_small(sentences.select(F.col(tokens).cast("array<string>").alias("tokens")))
    counts = rows.select(F.explode("tokens").alias("word")).filter("word IS NOT NULL").groupBy("word").agg(F.count("*").alias("n"))
    vocabulary = staged(counts.filter(F.col("n") >= min_count), "vocabulary")
    n_words, total = vocabulary.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    tasks = partitions or max(spark.sparkContext.defaultParallelism, -(-total // TASK_TOKENS))
    width = min(max(LEAST_BITS, 1 << (32 * max(n_words, 1)).bit_length()), MOST_BITS)
    bits = spark.sparkContext.broadcast(_frequent_bits(vocabulary, width))
    expected = max(1, total * iterations // tasks)

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = np.unpackbits(bits.value, bitorder="little").view(bool)
        own, random, seen = Trainer(size, window, seed), np.random.default_rng(seed), 0

        def learn(ids: np.ndarray, sentence: np.ndarray) -> None:
            nonlocal seen
            for at in range(0, len(ids), 1 << 17):
                rate = RATE * max(1e-3, 1 - seen / expected)
                own.learn(ids[at:at + (1 << 17)], sentence[at:at + (1 << 17)], rate, random)
                seen += min(1 << 17, len(ids) - at)

        with tempfile.TemporaryFile() as kept:
            n_kept = 0
            for batch in batches:
                lists = batch.column(0)
                flat = lists.flatten().dictionary_encode()
                if not len(flat):
                    continue
                words = flat.dictionary.to_pylist()
                codes = np.fromiter((crc32(w.encode("utf-8", "surrogatepass")) for w in words), np.int64, len(words))
                passes = frequent[codes % width]
                chosen = np.flatnonzero(passes)
                place = np.full(len(words) + 1, -1, np.int64)
                place[chosen] = own.ids_of([words[i] for i in chosen.tolist()], codes[chosen])
                ids = place[flat.indices.fill_null(len(words)).to_numpy(zero_copy_only=False)]
                sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                sentence = np.repeat(np.arange(len(sizes)), sizes)[ids >= 0]
                ids = ids[ids >= 0]
                np.add.at(own.times, ids, 1)
                learn(ids, sentence)
                if iterations > 1 and len(ids):
                    np.save(kept, ids)
                    np.save(kept, sentence)
                    n_kept += 1
            for _ in range(iterations - 1):
                kept.seek(0)
                for _ in range(n_kept):
                    ids = np.load(kept)
                    learn(ids, np.load(kept))
        words = list(own.ids)
        for at in range(0, len(words), 10_000):
            part = words[at:at + 10_000]
            vectors = own.own[at:at + len(part)]
            yield pa.RecordBatch.from_arrays([
                pa.array(part, pa.string()), pa.array(own.times[at:at + len(part)]),
                pa.array([v.tobytes() for v in vectors], pa.binary())], names=["word", "n", "vector"])

    parts = rows.repartition(tasks).mapInArrow(train, "word string, n long, vector binary")
    shards = max(1, -(-tasks * n_words * (size * 4 + 32) // SHARD_BYTES))

    def average(shard: pa.Table) -> pa.Table:
        words = shard.column("word").combine_chunks().dictionary_encode()
        if isinstance(words, pa.ChunkedArray):
            words = words.combine_chunks()
        codes = words.indices.to_numpy(zero_copy_only=False)
        times = shard.column("n").to_numpy().astype(np.float64)
        vectors = np.frombuffer(b"".join(shard.column("vector").to_pylist()), np.float32).reshape(-1, size)
        # In an order that doesn't depend on the shuffle's.
        order = np.lexsort((vectors[:, 0], times, codes))
        begins = np.searchsorted(codes[order], np.arange(len(words.dictionary)))
        sums = np.add.reduceat(vectors[order] * times[order, None], begins, axis=0)
        means = (sums / np.add.reduceat(times[order], begins)[:, None]).astype(np.float32)
        flat = pa.array(means.ravel())
        return pa.table({"word": words.dictionary, "vector": pa.ListArray.from_arrays(
            pa.array(np.arange(len(means) + 1, dtype=np.int32) * size), flat)})

    dealt = parts.withColumn("shard", F.pmod(F.xxhash64("word"), F.lit(shards)))
    merged = dealt.groupBy("shard").applyInArrow(
        lambda shard: average(shard.drop_columns(["shard"])), "word string, vector array<float>")
    return WordVectors(staged(merged.join(vocabulary.select("word"), "word", "left_semi"), "vectors"))


def save_word2vec(model: WordVectors, path: str) -> None:
    model.table.write.mode("overwrite").parquet(path)


def load_word2vec(spark, path: str) -> WordVectors:
    return WordVectors(spark.read.parquet(path))
