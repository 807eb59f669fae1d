"""Subword vocabulary, word vectors and embedding look-up."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.operators import subwords, wordvectors
from codeloom.operators.scale import global_row_number
from codeloom.operators.wordvectors import WordVectors, save_word2vec, train_word2vec  # noqa: F401
from codeloom.session import ensure_checkpoint_dir, staged

# Reserved tokens and their ids.
RESERVED = {"<s>": 0, "<pad>": 1, "</s>": 2, "<unk>": 3, "<mask>": 4}

MARKS = "﷔", "﷕"  # noncharacters around every symbol of a word
_OPEN, _CLOSE = MARKS


def _box(symbol: str) -> str:
    return _OPEN + symbol + _CLOSE


def _spelled(word: Column) -> Column:
    """Word as a row of boxed single characters."""
    return F.regexp_replace(word, "(?s)(.)", f"{_OPEN}$1{_CLOSE}")


def _symbols(boxed: Column) -> Column:
    inner = F.substr(boxed, F.lit(2), F.length(boxed) - 2)
    return F.split(inner, _CLOSE + _OPEN, -1)


def _independent_prefix(ranked: Sequence[tuple[str, str, int]], known: set[str], limit: int,
                        complete: bool) -> list[tuple[str, str]]:
    """Leading merges that one pass over the words can apply as if done one after the other.

    A merge changes only the counts of pairs that share a symbol with it, and a pair it creates
    counts no more than the neighbour it came from. So a ranked list is safe down to the first pair
    that shares a symbol with an earlier one, except for pairs that tie with what follows. A merge
    that spells an existing symbol can raise other counts, so nothing is taken after it.
    """
    taken: list[tuple[str, str, int]] = []
    used: set[str] = set()
    made = set(known)
    for left, right, n in ranked:
        if len(taken) == limit or left in used or right in used:
            break
        taken.append((left, right, n))
        used.update((left, right))
        if left + right in made:
            break
        made.add(left + right)
    if len(taken) < len(ranked):
        following = ranked[len(taken)][2]
    else:
        following = 0 if complete or not ranked else ranked[-1][2]
    return [(left, right) for i, (left, right, n) in enumerate(taken) if i == 0 or n > following]


# Symbols of the distinct words that are merged in one place, some 60 bytes each.
HELD_SYMBOLS = 6_000_000


def bpe_train(words: DataFrame, word: str = "word", vocab_size: int = 50_000, min_frequency: int = 2,
              special_tokens: Sequence[str] = tuple(RESERVED), num_merges: int | None = None,
              candidates: int = 1000) -> tuple[list[str], list[tuple[str, str]]]:
    """Learn byte-pair merges: (vocabulary in id order, merges in order).

    Only the distinct-word table is iterated. While its words that can still be merged have more than ``HELD_SYMBOLS``
    symbols, each round counts the pairs on the cluster, looks at the best ``candidates`` of them, and applies as many
    independent merges as it can at once; a reliable checkpoint every few rounds keeps the lineage short. A table that
    is that small, or has become so, is merged to the end in one place, by counts that follow each merge, with the same
    outcome. Ties go to the lower pair. The vocabulary is bounded by ``vocab_size``, so it is safe to hold in one place.
    """
    ensure_checkpoint_dir(words.sparkSession)
    # Texts are read once. The rounds are costly for the few bytes of the table, so all cores get a share of it.
    table = staged(
        words.select(F.col(word).alias("w")).filter(F.length("w") > 0)
        .groupBy("w").agg(F.count("*").alias("n"))
        .repartition(words.sparkSession.sparkContext.defaultParallelism, "w"), "words")
    letters = [r[0] for r in (
        table.select(F.explode(F.array_distinct(F.split("w", ""))).alias("ch")).filter("ch <> ''")
        .groupBy("ch").count().orderBy(F.desc("count"), "ch")
        .limit(max(0, vocab_size - len(special_tokens))).select("ch").collect())]
    specials = list(dict.fromkeys(special_tokens))
    vocab = specials + sorted(set(letters) - set(specials))
    known = set(vocab)
    table = table.select(_spelled(F.col("w")).alias("s"), "n").checkpoint()

    merges: list[tuple[str, str]] = []
    wanted = num_merges if num_merges is not None else max(0, vocab_size - len(vocab))
    rounds = 0
    while len(merges) < wanted and len(vocab) < vocab_size:
        if rounds % 4 == 0:
            several = table.select(_symbols(F.col("s")).alias("a"), "n").filter(F.size("a") > 1)
            if (several.agg(F.sum(F.size("a"))).first()[0] or 0) <= HELD_SYMBOLS:
                rest = subwords.merged(
                    ((a, n) for batch in several.toArrow().to_batches() for a, n in zip(*(c.to_pylist() for c in batch.columns))),
                    min_frequency, wanted - len(merges), known, vocab_size - len(vocab))
                merges += rest
                vocab += [m for m in dict.fromkeys(left + right for left, right in rest) if m not in known]
                break
        ranked = [(r.l, r.r, r.c) for r in (
            table.select(_symbols(F.col("s")).alias("a"), "n")
            .select(F.slice("a", F.lit(1), F.size("a") - 1).alias("l"),
                    F.slice("a", F.lit(2), F.size("a") - 1).alias("r"), "n")
            .select(F.explode_outer(F.arrays_zip("l", "r")).alias("p"), "n")
            .groupBy(F.col("p.l").alias("l"), F.col("p.r").alias("r")).agg(F.sum("n").alias("c"))
            .filter((F.col("c") >= min_frequency) & F.col("l").isNotNull())
            .orderBy(F.desc("c"), "l", "r").limit(candidates).collect())]
        batch = _independent_prefix(
            ranked, known, min(wanted - len(merges), vocab_size - len(vocab), 64),
            complete=len(ranked) < candidates)
        if not batch:
            break
        s = F.col("s")
        for left, right in batch:
            s = F.replace(s, F.lit(_box(left) + _box(right)), F.lit(_box(left + right)))
            merges.append((left, right))
            if left + right not in known:
                known.add(left + right)
                vocab.append(left + right)
        table = table.select(s.alias("s"), "n")
        rounds += 1
        if rounds % 4 == 0:
            table = table.checkpoint()
    return vocab, merges


def merge_word(word: str, ranks: dict[tuple[str, str], int]) -> list[str]:
    """Split a word by applying the learned merges, lowest rank first."""
    parts = list(word)
    while len(parts) > 1:
        rank, best = min((ranks.get(p, len(ranks)), p) for p in zip(parts, parts[1:]))
        if rank == len(ranks):
            break
        out, i = [], 0
        while i < len(parts):
            if i + 1 < len(parts) and (parts[i], parts[i + 1]) == best:
                out.append(parts[i] + parts[i + 1])
                i += 2
            else:
                out.append(parts[i])
                i += 1
        parts = out
    return parts


def bpe_encode(df: DataFrame, tokens: str, vocab: Sequence[str], merges: Sequence[tuple[str, str]],
               out: str = "ids", max_length: int = 1024, pad_to: int | None = None) -> DataFrame:
    """Ids of a token-array column: start id, subwords, end id, at most ``max_length`` in all;
    padded on the right with the pad id up to ``pad_to``. Frequent tokens are split once per task."""
    shared = df.sparkSession.sparkContext.broadcast((
        {t: i for i, t in enumerate(vocab)}, {p: i for i, p in reversed(list(enumerate(merges)))}))
    start, end, unk = RESERVED["<s>"], RESERVED["</s>"], RESERVED["<unk>"]

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ids, ranks = shared.value

        @lru_cache(maxsize=1 << 17)
        def word_ids(token: str) -> tuple[int, ...]:
            if token in ids:
                return (ids[token],)
            return tuple(ids.get(p, unk) for p in merge_word(token, ranks))

        def row(words) -> list[int]:
            body: list[int] = []
            for w in words:
                body.extend(word_ids(w))
                if len(body) >= max_length - 2:
                    break
            return [start, *body[:max_length - 2], end]

        for words in batches:
            yield words.map(row)

    ids = encode(F.col(tokens))
    df = df.withColumn(out, ids)
    if pad_to is not None:
        gap = F.greatest(F.lit(pad_to) - F.size(out), F.lit(0))
        df = df.withColumn(out, F.concat(out, F.array_repeat(F.lit(RESERVED["<pad>"]), gap)))
    return df


def word_index(tokens: DataFrame, token: str = "token") -> DataFrame:
    """(idx, token, n): dense 0-based index by falling count, then token."""
    counts = tokens.filter(F.col(token).isNotNull()).groupBy(F.col(token).alias("token")).agg(
        F.count("*").alias("n"))
    ranked = global_row_number(counts, [F.desc("n"), F.asc("token")], "_r")
    return ranked.select((F.col("_r") - 1).alias("idx"), "token", "n")


def load_word2vec(path: str) -> WordVectors:
    return wordvectors.load_word2vec(SparkSession.active(), path)


def save_subwords(spark: SparkSession, vocab: Sequence[str], merges: Sequence[tuple[str, str]], path: str) -> None:
    """Write a subword vocabulary and its merges, both bounded by the vocabulary's size."""
    spark.createDataFrame(list(enumerate(vocab)), "id int, token string").write.mode("overwrite").parquet(f"{path}/vocab")
    spark.createDataFrame([(i, *m) for i, m in enumerate(merges)], "rank int, left string, right string").write.mode(
        "overwrite").parquet(f"{path}/merges")


def load_subwords(spark: SparkSession, path: str) -> tuple[list[str], list[tuple[str, str]]]:
    vocab = [r.token for r in spark.read.parquet(f"{path}/vocab").orderBy("id").collect()]
    return vocab, [(r.left, r.right) for r in spark.read.parquet(f"{path}/merges").orderBy("rank").collect()]


def lookup_embeddings(index: DataFrame, vectors: DataFrame, num_words: int, dim: int) -> DataFrame:
    """(idx, token, vector) of every indexed token below ``num_words``; zeros where no vector is known."""
    zeros = F.array_repeat(F.lit(0.0), dim)
    known = vectors.select("token", F.col("vector").cast("array<double>").alias("_v"))
    return (
        index.filter(F.col("idx") < num_words).select("idx", "token")
        .join(known, "token", "left")
        .select("idx", "token", F.coalesce("_v", zeros).alias("vector"))
    )


def index_labels(df: DataFrame, label: str = "label", out: str = "label_index") -> DataFrame:
    """Add each label's position among the sorted labels, ranked by ranges whatever their number."""
    labels = df.select(label).filter(F.col(label).isNotNull()).distinct()
    ranked = global_row_number(labels, [F.asc(label)], "_r")
    return df.join(ranked.select(label, (F.col("_r") - 1).cast("int").alias(out)), label, "left")


def decode_labels(df: DataFrame, index: Column, classes: DataFrame, out: str = "decoded") -> DataFrame:
    """Add the label of each class position; null where no class has it.

    ``classes`` holds (label, label_index) rows as ``index_labels`` numbers them. For scores or one-hot
    rows the position is ``argmax``; for a binary model it is ``threshold_scores``.
    """
    known = classes.select(F.col("label_index").alias("_index"), F.col("label").alias(out)).distinct()
    return df.withColumn("_index", index).join(known, "_index", "left").drop("_index")
