"""Language ID (7): script ranges narrow the candidates, Viterbi labels spans of mixed-language text.

A model holds, for each learned language, smoothed log-probabilities of character grams and the
share of each script in its letters. A text's words are scored once per distinct word; Viterbi with
a fixed penalty for each switch then labels every word, and spans are runs of equal labels.
"""

from __future__ import annotations

import re
import sys
from array import array
from bisect import bisect_right
from collections import Counter
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import fields, map_rows
from codeloom.session import staged

# First code points of script ranges, in order; what lies between named ranges counts as "Other".
SCRIPTS = (
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"),
    (0x0600, "Arabic"), (0x0780, "Other"), (0x0900, "Devanagari"), (0x0980, "Other"), (0x0E00, "Thai"),
    (0x0E80, "Other"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Other"), (0x1E00, "Latin"),
    (0x1F00, "Greek"), (0x2000, "Other"), (0x3040, "Kana"), (0x3100, "Other"), (0x3400, "Han"), (0xA000, "Other"),
    (0xAC00, "Hangul"), (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Other"))
_STARTS = [a for a, _ in SCRIPTS]

GRAMS = (3, 5)  # bytes of a gram; words have a border byte at each end
MOST_LETTERS = 64  # of a word; longer runs of letters, as without spaces, go on as further words
BUCKETS = 1 << 15  # of hashed grams: a language takes 128 KB of a model
SMOOTHING = 0.5
# A learned language is a candidate for a script that holds this share of its letters at least.
SCRIPT_SHARE = 0.01
SWITCH = 12.0  # penalty of a change of language, in natural logarithms
WORD_CAP = 6.0  # a word can't favour a language by more, so one odd word is no span
# Scores of at most this many different words are remembered in a Python worker, then forgotten.
MEMO_WORDS = 500_000

FEW_LANGUAGES = 32  # up to so many, numbers one by one cost less than arrays of them
PATH_SLICE = 4096  # words that the recursion turns into numbers at a time

MOST_LANGUAGES = 512  # learned; a model of so many takes 64 MB


@lru_cache(maxsize=1)
def _words() -> re.Pattern:
    """Runs of letters: of what Python takes for word characters, numerals like ² or Ⅷ are none."""
    numerals = [c for c in range(sys.maxunicode + 1) if chr(c).isnumeric() and not chr(c).isalpha() and not chr(c).isdecimal()]
    ranges, start = [], 0
    for i, c in enumerate(numerals):
        if i + 1 == len(numerals) or numerals[i + 1] != c + 1:
            ranges.append(f"{chr(numerals[start])}-{chr(c)}")
            start = i + 1
    return re.compile(r"[^\W\d_%s]{1,%d}" % ("".join(ranges), MOST_LETTERS))


_ASCII_WORDS = re.compile("[A-Za-z]{1,%d}" % MOST_LETTERS)  # what ``_words`` finds in ASCII, at less cost


def words_of(text: str) -> list[str]:
    return (_ASCII_WORDS if text.isascii() else _words()).findall(text)


def script_of(word: str) -> str:
    """Script of a word's first letter beyond the Latin ranges, else Latin."""
    if word.isascii():
        return "Latin"
    for letter in word:
        if letter > "ͯ":
            return SCRIPTS[bisect_right(_STARTS, ord(letter)) - 1][1]
    return "Latin"


def gram_buckets(words: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each gram size: hashed grams of all words, and where each word's grams begin (one more at the end)."""
    bodies = [f"<{w.lower()}>".encode() for w in words]
    sizes = np.fromiter(map(len, bodies), np.int64, len(bodies))
    ends = np.cumsum(sizes)
    letters = np.frombuffer(b"".join(bodies), np.uint8).astype(np.uint64)
    out = []
    for size in GRAMS:
        counts = np.maximum(sizes - size + 1, 0)
        begins = np.concatenate(([0], np.cumsum(counts)))
        # The first letter of each gram: positions of all words less those too near a word's end.
        at = np.arange(begins[-1]) + np.repeat(ends - sizes - begins[:-1], counts)
        code = np.full(len(at), size, np.uint64)
        for i in range(size):
            code = (code ^ letters[at + i]) * np.uint64(0x100000001B3)
        code ^= code >> np.uint64(32)
        out.append(((code % np.uint64(BUCKETS)).astype(np.int64), begins))
    return out


def _path(scores: np.ndarray, few: bool) -> np.ndarray:
    """The recursion: labels of the best path, by plain numbers for a few languages, else by arrays. Both give the same."""
    n, k = scores.shape
    out = np.empty(n, np.int64)
    if few:
        # Values before each word are kept; where the path came from follows from them.
        kept, value = array("d"), [0.0] * k
        for at in range(0, n, PATH_SLICE):
            for row in scores[at:at + PATH_SLICE].tolist():
                kept.extend(value)
                least = max(value) - SWITCH
                value = [(v if v >= least else least) + s for v, s in zip(value, row)]
        now = value.index(max(value))
        for t in range(n - 1, -1, -1):
            out[t] = now
            before = kept[t * k:t * k + k]
            most = max(before)
            if before[now] < most - SWITCH:
                now = before.index(most)
        return out
    back = np.empty((n, k), np.int32)
    here = np.arange(k)
    value = np.zeros(k)
    for t in range(n):
        top = int(value.argmax())
        moved = value < value[top] - SWITCH
        back[t] = np.where(moved, top, here)
        value = np.where(moved, value[top] - SWITCH, value) + scores[t]
    now = int(value.argmax())
    for t in range(n - 1, -1, -1):
        out[t] = now
        now = back[t, now]
    return out


class Model:
    """``weights``: one row of log-probabilities per bucket, one column per language; ``scripts``:
    flags of the candidate languages of each script."""

    def __init__(self, languages: list[str], weights: np.ndarray, scripts: dict[str, np.ndarray]):
        self.languages, self.weights, self.scripts = languages, weights, scripts
        self.forget()

    def __reduce__(self):
        return Model, (self.languages, self.weights, self.scripts)

    def forget(self) -> None:
        self.memo: dict[str, int] = {}
        self.table = np.zeros((1024, len(self.languages)), np.float32)

    def score(self, words: list[str]) -> np.ndarray:
        """Log-likelihoods of words in each language, relative to the best; others than candidates stay low."""
        total = np.zeros((len(words), len(self.languages)))
        for buckets, begins in gram_buckets(words):
            sums = np.concatenate((np.zeros((1, total.shape[1])), np.cumsum(self.weights[buckets], axis=0, dtype=float)))
            total += sums[begins[1:]] - sums[begins[:-1]]
        names = [script_of(w) for w in words]
        for script in set(names) & set(self.scripts):
            if self.scripts[script].any():
                out = np.flatnonzero([n == script for n in names])
                total[np.ix_(out, np.flatnonzero(~self.scripts[script]))] = -np.inf
        return np.maximum(total - total.max(axis=1, keepdims=True), -WORD_CAP)

    def scores(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Scores of the words of each text; words not met before are scored together."""
        if not self.languages:
            return [np.zeros((len(words), 0)) for words in texts]
        new = {w for words in texts for w in words}.difference(self.memo)
        if len(self.memo) + len(new) > MEMO_WORDS:
            self.forget()
            new = {w for words in texts for w in words}
        if new:
            first, last = len(self.memo), len(self.memo) + len(new)
            if last > len(self.table):
                grown = np.zeros((2 * last, len(self.languages)), np.float32)
                grown[:first] = self.table[:first]
                self.table = grown
            words = list(new)
            self.table[first:last] = self.score(words)
            self.memo.update(zip(words, range(first, last)))
        get = self.memo.__getitem__
        return [self.table[np.fromiter(map(get, words), np.int64, len(words))] for words in texts]

    def labels(self, scores: np.ndarray) -> np.ndarray:
        """Viterbi labels of a text's words.

        A single language is the best path if no stretch of words gains more by leaving it than one
        switch costs; sums show that without a loop. Only other texts run the recursion.
        """
        best = int(scores.sum(axis=0).argmax())
        gain = scores.max(axis=1) - scores[:, best]
        if gain.sum() <= SWITCH or scores.shape[1] == 1:
            return np.full(len(scores), best)
        others = scores.copy()
        others[:, best] = -np.inf
        lead = np.concatenate(([0.0], np.cumsum(others.max(axis=1) - scores[:, best])))
        if (lead - np.minimum.accumulate(lead)).max() <= SWITCH:
            return np.full(len(scores), best)
        return _path(scores, scores.shape[1] <= FEW_LANGUAGES)

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """Spans ``(start, end, language)`` of a text in code points."""
        found = list(_words().finditer(text))
        if not found or not self.languages:
            return []
        labels = self.labels(self.scores([[m.group() for m in found]])[0]).tolist()
        out: list[tuple[int, int, str]] = []
        for m, label in zip(found, labels):
            name = self.languages[label]
            if out and out[-1][2] == name:
                out[-1] = (out[-1][0], m.end(), name)
            else:
                out.append((m.start(), m.end(), name))
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """For each text the language with the most letters, and its share of the letters."""
        words = [words_of(t) if t else [] for t in texts]
        out = []
        for own, scores in zip(words, self.scores(words)):
            if not own or not self.languages:
                out.append(("und", 0.0))
                continue
            labels = self.labels(scores)
            sizes = np.bincount(labels, np.fromiter(map(len, own), float, len(own)), len(self.languages))
            top = int(sizes.argmax())
            out.append((self.languages[top], float(sizes[top] / sizes.sum())))
        return out


def train(df: DataFrame, text: str = "text", lang: str = "lang", most: int = MOST_LANGUAGES) -> Model:
    """Learn from all rows with a text and a language.

    Tasks count hashed grams and script letters of their rows; the sums of at most ``BUCKETS`` + 20
    rows per language are merged by Spark, and only they reach the driver. More than ``most``
    languages are refused, so that the model stays bounded. Empty texts teach nothing; repeated rows
    count each; long texts are read whole; an empty table gives a model that knows no language.
    """

    def start():
        held: dict[str, Counter] = {}

        def step(texts: list, langs: list) -> None:
            for body, name in zip(texts, langs):
                held.setdefault(name, Counter()).update(words_of(body))
            return None if sum(map(len, held.values())) < 1_000_000 else finish()

        def finish() -> list | None:
            out: list[list] = [[], [], []]
            for name, words in held.items():
                grams = np.zeros(BUCKETS, np.int64)
                times = np.fromiter(words.values(), np.int64, len(words))
                for buckets, begins in gram_buckets(list(words)):
                    np.add.at(grams, buckets, np.repeat(times, np.diff(begins)))
                letters: Counter = Counter()
                for word, n in words.items():
                    letters[script_of(word)] += n * len(word)
                at = np.flatnonzero(grams)
                out[0] += [name] * (len(at) + len(letters))
                out[1] += [*map(str, at.tolist()), *letters]
                out[2] += [*grams[at].tolist(), *letters.values()]
            held.clear()
            return out if out[0] else None

        return step, finish

    rows = df.filter(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(text, lang)
    sums = map_rows(rows, start, fields("lang string, feature string, n long"), per_task=True)
    merged = staged(sums.groupBy("lang", "feature").agg(F.sum("n").alias("n")), "grams")
    different = merged.select("lang").distinct().limit(most + 1).count()
    if different > most:
        raise ValueError(f"more than {most} languages to learn")
    found = merged.toPandas()
    languages = sorted(found["lang"].unique())
    grams = np.zeros((BUCKETS, len(languages)))
    letters: dict[str, np.ndarray] = {name: np.zeros(len(languages)) for _, name in SCRIPTS}
    column = {name: i for i, name in enumerate(languages)}
    for name, feature, n in found.itertuples(index=False):
        if feature in letters:
            letters[feature][column[name]] = n
        else:
            grams[int(feature), column[name]] = n
    weights = np.log(grams + SMOOTHING) - np.log(grams.sum(axis=0) + SMOOTHING * BUCKETS) if languages else grams
    whole = sum(letters.values())
    scripts = {name: n >= SCRIPT_SHARE * np.maximum(whole, 1) for name, n in letters.items()}
    return Model(languages, weights.astype(np.float32), scripts)


def detect(df: DataFrame, model: Model, text: str = "text", key: str = "doc_id", spans: bool = False) -> DataFrame:
    """Rows ``(key, lang_pred, score[, spans])``, one for each row of ``df``, in place.

    ``lang_pred`` is the language that labels most letters of the whole text, ``score`` its share;
    ``und`` and 0 for null texts, texts without letters, and a model without languages. ``spans``
    adds all spans as ``array<struct<start, end, lang>>``. Repeated rows and null keys give a row
    each; long texts are read whole; an empty table gives an empty result; other columns are not read. The model has a fixed
    size per language and travels with the tasks.
    """
    kind = df.schema[key].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(model)

    def kernel(keys: list, texts: list) -> list:
        one = shared.value
        found = one.predict(texts)
        out = [keys, [f[0] for f in found], [f[1] for f in found]]
        if spans:
            out.append([[dict(zip(("start", "end", "lang"), s)) for s in one.spans(t)] if t else [] for t in texts])
        return out

    more = ", spans array<struct<start: int, end: int, lang: string>>" if spans else ""
    return map_rows(df.select(key, text), kernel, fields(f"`{key}` {kind}, lang_pred string, score double{more}"))


def held_out(key: Column) -> Column:
    """Rows that are never learnt from: the CRC32 of the key as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))
