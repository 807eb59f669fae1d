"""Quality classifier (3): weak labels by expectation-maximisation, then a hashed linear scorer.

Overlapping heuristic labellers vote good, bad or nothing on every document. Spark counts the vote
patterns of all documents; expectation-maximisation on these counts estimates the class share and
each labeller's accuracy, hence a posterior for each pattern. Posterior labels of all documents
then train a linear scorer over hashed features, which judges every document: tasks sum the
gradients of their rows, Spark sums the tasks', and the driver holds the weights only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import fields, map_rows
from codeloom.session import staged

# Very frequent short words of four languages.
COMMON = frozenset(w.encode() for w in (
    "the of and to in is that it for was as with on by are this be at or an a "
    "de la le les et des du un une que est pour dans en il qui au par sur ne pas avec "
    "der die und das den von zu mit sich dem ein ist eine einer nicht auch auf im es "
    "el los las del se por con para su al lo como sus no y o").split())
_SYMBOLS, _UPPER = b"#*$%&|<>!{}[]=~^\\", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
GOOD, BAD, NONE = 1, 0, 2

# (measure, good at or above / below, bad beyond): a labeller votes only outside its band of doubt.
LABELLERS = (
    ("common", "high", 0.16, 0.08),
    ("word_length", "low", 6.0, 6.8),
    ("symbols", "low", 0.02, 0.15),
    ("distinct", "high", 0.45, 0.25),
    ("copied_lines", "low", 0.10, 0.40),
    ("upper", "low", 0.30, 0.60),
    ("line_words", "low", 90.0, 300.0),
)
MEASURES = tuple(name for name, *_ in LABELLERS)

BUCKETS = 1 << 13  # weights of the scorer
# Sums over rows are of whole multiples of these, so that they don't depend on how rows are dealt.
X_UNIT, SLOPE_UNIT = 1 << 14, 1 << 18
SCORE_BINS = 1 << 14  # of which one is the limit of a score
FIT_VALUES = 1 << 20  # values of features that a task holds at a time
EPOCHS, RATE, DECAY = 30, 0.5, 1e-4
STRETCH = 500  # words within which different ones are counted, so that long texts compare with short ones
SHORT = 30  # words by which shares are damped
SURE = 0.95  # a posterior from which a document is kept whatever its score
TEXT_SLICE = 1 << 20  # bytes of words that are turned into features at a time


def measures(text: bytes) -> list[float]:
    words = text.split()
    n = max(1, len(words))
    lines = [x for x in text.split(b"\n") if x.strip()]
    size = max(1, len(text))
    lower = text.lower().translate(None, b".,;:!?").split()
    return [
        sum(map(COMMON.__contains__, lower)) / n,
        sum(map(len, words)) / n,
        (len(text) - len(text.translate(None, _SYMBOLS))) / n,
        sum(len(set(words[i:i + STRETCH])) for i in range(0, len(words), STRETCH)) / n,
        1 - len(set(lines)) / max(1, len(lines)),
        (len(text) - len(text.translate(None, _UPPER))) / size,
        n / max(1, len(lines)),
    ]


def votes(values: list[float]) -> list[int]:
    """One vote of each labeller; a text without words gets none."""
    out = []
    for value, (_, side, good, bad) in zip(values, LABELLERS):
        if side == "low":
            value, good, bad = -value, -good, -bad
        out.append(GOOD if value >= good else BAD if value < bad else NONE)
    return out


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of a whole text: word starts, ends and sizes, as shares of its words.

    Shares are drawn towards none in short texts, which say little either way.
    """
    words = text.split()
    if not words:
        return np.zeros(0, np.int64), np.zeros(0)
    total = np.zeros(BUCKETS)
    for at in range(0, len(words), TEXT_SLICE):
        part = words[at:at + TEXT_SLICE]
        ends = np.array([w[-3:].ljust(4, b" ") for w in part], "S4").view("<u4").astype(np.uint64)
        starts = np.array([w[:3].ljust(4, b" ") for w in part], "S4").view("<u4").astype(np.uint64)
        sizes = np.minimum(np.fromiter(map(len, part), np.int64, len(part)), 31)
        for salt, codes in ((1, ends), (2, starts)):
            mixed = (codes * np.uint64(0x9E3779B97F4A7C15 + 2 * salt)) >> np.uint64(64 - 12)
            total += np.bincount(mixed.astype(np.int64), minlength=BUCKETS)
        total[4096:4096 + 32] += np.bincount(sizes, minlength=32)
    at = np.flatnonzero(total)
    return at, np.sqrt(total[at] / (len(words) + SHORT))


@dataclass(frozen=True)
class LabelModel:
    """Class share and ``table[labeller, class, vote]`` probabilities of votes."""

    share: float
    table: np.ndarray

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Probability of good for rows of votes; not to vote is an outcome of its own."""
        logs = np.log(np.array([1 - self.share, self.share]))[None, :].repeat(len(patterns), 0)
        for j in range(patterns.shape[1]):
            logs += np.log(self.table[j])[:, patterns[:, j]].T
        logs -= logs.max(axis=1, keepdims=True)
        odds = np.exp(logs)
        return odds[:, 1] / odds.sum(axis=1)

    @property
    def accuracies(self) -> np.ndarray:
        """Of each labeller: how often a vote is right."""
        right = (1 - self.share) * self.table[:, BAD, BAD] + self.share * self.table[:, GOOD, GOOD]
        return right / ((1 - self.share) * self.table[:, 0, :2].sum(1) + self.share * self.table[:, 1, :2].sum(1))


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> LabelModel:
    """Expectation-maximisation over counted vote patterns.

    It starts from labellers that each see some of the kinds of bad documents and seldom take a
    good one for bad: junk of one kind gets a bad vote from a few of them only.
    """
    m = len(LABELLERS)
    table = np.tile(np.array([[0.35, 0.40, 0.25], [0.03, 0.75, 0.22]]), (m, 1, 1))
    model = LabelModel(0.8, table)
    if not counts.sum():
        return model
    for _ in range(rounds):
        good = model.posterior(patterns) * counts
        mass = np.stack([counts - good, good])
        share = float(np.clip(mass[1].sum() / counts.sum(), 0.01, 0.99))
        table = np.full((m, 2, 3), 1e-4 * counts.sum() + 1e-9)
        for j, vote in product(range(m), range(3)):
            table[j, :, vote] += mass[:, patterns[:, j] == vote].sum(axis=1)
        table /= table.sum(axis=2, keepdims=True)
        done = abs(share - model.share) < 1e-9
        model = LabelModel(share, table)
        if done:
            break
    return model


def fit_scorer(rows: list[tuple[np.ndarray, np.ndarray]], good: np.ndarray) -> np.ndarray:
    """Weights (the last one a constant) of a logistic model on posterior labels, by full gradients.

    Both classes weigh the same, so that a rare class is learnt too.
    """
    weights = np.zeros(BUCKETS + 1)
    if not rows:
        return weights
    of = np.repeat(np.arange(len(rows)), [len(at) for at, _ in rows])
    at = np.concatenate([at for at, _ in rows])
    x = np.concatenate([v for _, v in rows])
    importance = good / max(good.sum(), 1e-9) + (1 - good) / max((1 - good).sum(), 1e-9)
    importance /= importance.sum()
    squares = np.full(BUCKETS + 1, 1e-8)
    for _ in range(EPOCHS):
        z = np.bincount(of, x * weights[at], len(rows)) + weights[-1]
        slope = importance * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - good)
        gradient = np.append(np.bincount(at, slope[of] * x, BUCKETS), slope.sum()) + DECAY * weights
        squares += gradient ** 2
        weights -= RATE * gradient / np.sqrt(squares)
    return weights


def _packed(found: list[tuple[np.ndarray, np.ndarray]]) -> list:
    """Columns ``at`` and ``x`` of the features of some rows, ``x`` in units."""
    return [[at.astype("<u2").tobytes() for at, _ in found],
            [np.rint(x * X_UNIT).astype("<u2").tobytes() for _, x in found]]


def _blocks(ats: list[bytes], xs: list[bytes]) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows (a slice) with the row, bucket and units of each of their values, about ``FIT_VALUES`` at a time."""
    first = 0
    while first < len(ats):
        last, held = first, 0
        while last < len(ats) and (last == first or held + len(ats[last]) // 2 <= FIT_VALUES):
            held += len(ats[last]) // 2
            last += 1
        sizes = np.fromiter((len(a) // 2 for a in ats[first:last]), np.int64, last - first)
        yield (slice(first, last), np.repeat(np.arange(last - first), sizes),
               np.frombuffer(b"".join(ats[first:last]), "<u2").astype(np.int64),
               np.frombuffer(b"".join(xs[first:last]), "<u2").astype(float))
        first = last


def _scores(weights: np.ndarray, n: int, of: np.ndarray, at: np.ndarray, x: np.ndarray) -> np.ndarray:
    z = np.bincount(of, x * weights[at], n) / X_UNIT + weights[-1]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _gradients(rows: DataFrame, known: dict[str, float], weights: np.ndarray, weigh: tuple[float, float]) -> np.ndarray:
    """Sums over all rows of ``importance * (score - good) * x``; importance is at most 1."""

    def start():
        total = np.zeros(BUCKETS + 1, np.int64)

        def step(patterns: list, ats: list, xs: list) -> None:
            for part, of, at, x in _blocks(ats, xs):
                good = np.array([known[p] for p in patterns[part]])
                importance = good * weigh[1] + (1 - good) * weigh[0]
                slope = np.rint(importance * (_scores(weights, len(good), of, at, x) - good) * SLOPE_UNIT)
                total[:-1] += np.bincount(at, slope[of] * x, BUCKETS).astype(np.int64)
                total[-1] += int(slope.sum()) * X_UNIT

        def finish() -> list:
            held = np.flatnonzero(total)
            return [held, total[held]]

        return step, finish

    sums = map_rows(rows, start, fields("bucket int, n long"), per_task=True)
    out = np.zeros(BUCKETS + 1)
    for bucket, n in sums.groupBy("bucket").agg(F.sum("n")).collect():  # at most BUCKETS + 1
        out[bucket] = n / (X_UNIT * SLOPE_UNIT)
    return out


def fit_all(rows: DataFrame, known: dict[str, float], of: np.ndarray) -> np.ndarray:
    """Weights (the last one a constant) of a logistic model on posterior labels, by full gradients.

    ``rows`` are (pattern, at, x), the last two as ``_packed`` gives them, ``known`` the patterns' posteriors and
    ``of`` the masses of bad and good. Both classes weigh the same, so that a rare class is learnt too. Each round is one pass over the rows, all of them.
    """
    weights = np.zeros(BUCKETS + 1)
    of = np.maximum(of, 1e-9)
    weigh = of.min() / of  # the scarcer class weighs 1
    total = float((weigh * of).sum())
    squares = np.full(BUCKETS + 1, 1e-8)
    for _ in range(EPOCHS):
        gradient = _gradients(rows, known, weights, tuple(weigh)) / total
        gradient += DECAY * weights
        squares += gradient ** 2
        weights -= RATE * gradient / np.sqrt(squares)
    return weights


def _limit(rows: DataFrame, known: dict[str, float], weights: np.ndarray) -> float:
    """The edge between bins of scores that best parts all rows by their posterior labels."""

    def start():
        total = np.zeros((2, SCORE_BINS), np.int64)

        def step(patterns: list, ats: list, xs: list) -> None:
            for part, of, at, x in _blocks(ats, xs):
                good = np.rint(np.array([known[p] for p in patterns[part]]) * SLOPE_UNIT).astype(np.int64)
                bins = np.minimum((_scores(weights, len(good), of, at, x) * SCORE_BINS).astype(np.int64), SCORE_BINS - 1)
                np.add.at(total[0], bins, SLOPE_UNIT - good)
                np.add.at(total[1], bins, good)

        def finish() -> list:
            held = np.flatnonzero(total.any(axis=0))
            return [held, total[0, held], total[1, held]]

        return step, finish

    sums = map_rows(rows, start, fields("bin int, bad long, good long"), per_task=True)
    found = sums.groupBy("bin").agg(F.sum("bad"), F.sum("good")).orderBy("bin").collect()  # at most SCORE_BINS
    bins, bad, good = np.array(found, float).reshape(-1, 3).T
    lost, caught = (np.concatenate(([0.0], np.cumsum(v) / max(v.sum(), 1e-9))) for v in (good, bad))
    cut = int((caught - lost).argmax())
    low = bins[cut - 1] + 1 if cut else 0.0
    high = bins[cut] if cut < len(bins) else SCORE_BINS
    return float((low + high) / 2 / SCORE_BINS)


@dataclass(frozen=True)
class QualityModel:
    labels: LabelModel
    weights: np.ndarray
    limit: float

    def score(self, text: bytes) -> float:
        at, x = features(text)
        return float(1 / (1 + np.exp(-np.clip(x @ self.weights[at] + self.weights[-1], -30, 30))))


def train(df: DataFrame, text: str = "text", key: str = "doc_id", sample: int | None = None) -> QualityModel:
    """Learn from all rows of ``df``, the label model and the scorer alike.

    Patterns and features of all rows are staged once. To the driver go counts of at most 3**7 vote
    patterns, and for each round of the fit the sum of gradients, one number per weight. The limit is the score that
    best parts all rows by their posterior labels, to one of ``SCORE_BINS``. Null and blank texts teach
    nothing; repeated rows count each, rows with a null key too; long texts are read whole; an empty table gives a model
    that keeps nothing. With ``sample`` the scorer learns on the driver instead, from so many different rows with the lowest key hash.
    """
    def measured(texts: list) -> list:
        return [["".join(map(str, votes(measures(t)))) for t in texts], *_packed([features(t) for t in texts])]

    named = df.filter(F.length(F.trim(text)) > 0).select(F.col(text).alias("body"))
    rows = staged(map_rows(named, measured, fields("pattern string, at binary, x binary"), binary=("body",)), "features")
    found = rows.groupBy("pattern").count().orderBy("pattern").collect()
    patterns = np.array([list(map(int, r["pattern"])) for r in found], np.int64).reshape(-1, len(LABELLERS))
    counts = np.array([r["count"] for r in found], float)
    labels = estimate(patterns, counts)
    if not found:
        return QualityModel(labels, np.zeros(BUCKETS + 1), 0.5)

    if sample is not None:
        return _of_sample(df, text, key, sample, labels)

    good = labels.posterior(patterns)
    known = {r["pattern"]: float(g) for r, g in zip(found, good)}
    weights = fit_all(rows, known, np.array([(1 - good) @ counts, good @ counts]))
    if (good > 0.5).all() or not (good > 0.5).any():
        return QualityModel(labels, weights, 0.5)
    return QualityModel(labels, weights, _limit(rows, known, weights))


def _of_sample(df: DataFrame, text: str, key: str, sample: int, labels: LabelModel) -> QualityModel:
    # The sample is found by hashes alone; then only its rows are read again, each different one once.
    named = df.filter(F.length(F.trim(text)) > 0).select(
        F.col(text).alias("body"), F.xxhash64(F.col(key).cast("string")).alias("order"), F.xxhash64(text).alias("tie"))
    chosen = staged(named.select("order", "tie").distinct().orderBy("order", "tie").limit(sample), "sample")
    picked = named.join(F.broadcast(chosen), ["order", "tie"], "left_semi").dropDuplicates(["order", "tie"])

    def featured(texts: list) -> list:
        both = [features(t) for t in texts]
        return [[f"{''.join(map(str, votes(measures(t))))}" for t in texts],
                [at.astype("<u2").tobytes() for at, _ in both], [x.astype("<f4").tobytes() for _, x in both]]

    rows = map_rows(picked.select("body"), featured, fields("pattern string, at binary, x binary"), binary=("body",)).collect()
    rows.sort(key=lambda r: (r["pattern"], r["at"], r["x"]))  # the fit doesn't depend on the order of tasks
    sparse = [(np.frombuffer(r["at"], "<u2").astype(np.int64), np.frombuffer(r["x"], "<f4").astype(float)) for r in rows]
    good = labels.posterior(np.array([list(map(int, r["pattern"])) for r in rows], np.int64).reshape(-1, len(LABELLERS)))
    weights = fit_scorer(sparse, good)
    model = QualityModel(labels, weights, 0.5)
    if not rows or not 0 < (good > 0.5).sum() < len(good):
        return model
    scores = np.array([1 / (1 + np.exp(-np.clip(x @ weights[at] + weights[-1], -30, 30))) for at, x in sparse])
    order = np.argsort(scores, kind="stable")
    ranked, lost = scores[order], np.concatenate(([0.0], np.cumsum(good[order]) / good.sum()))
    caught = np.concatenate(([0.0], np.cumsum(1 - good[order]) / (1 - good).sum()))
    cut = int((caught - lost).argmax())
    low = ranked[cut - 1] if cut else 0.0
    high = ranked[cut] if cut < len(ranked) else 1.0
    return QualityModel(labels, weights, float((low + high) / 2))


def classify(df: DataFrame, model: QualityModel, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Rows ``(key, votes, posterior, score, kept)``, one for each row of ``df``, in place.

    ``votes`` has one letter for each of ``MEASURES`` (1 good, 0 bad, 2 none), ``posterior`` is the
    label model's probability of good, ``score`` the linear scorer's; ``kept`` if the score reaches
    the model's limit or the posterior is at least ``SURE``, as for good texts of few words. Null texts
    and texts without words have no votes, score 0 and are not kept. Long texts are read whole. Repeated rows and null keys give a row each; an empty table gives an empty result; other columns
    are not read.
    """
    kind = df.schema[key].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(model)

    def kernel(keys: list, texts: list) -> list:
        one = shared.value
        filled = [bool(t and t.split()) for t in texts]
        found = [votes(measures(t)) if full else [NONE] * len(LABELLERS) for t, full in zip(texts, filled)]
        posterior = one.labels.posterior(np.array(found, np.int64).reshape(-1, len(LABELLERS))).tolist()
        scores = [one.score(t) if full else 0.0 for t, full in zip(texts, filled)]
        return [keys, ["".join(map(str, v)) for v in found], posterior, scores,
                [full and (s >= one.limit or p >= SURE) for full, s, p in zip(filled, scores, posterior)]]

    return map_rows(df.select(key, text), kernel, fields(
        f"`{key}` {kind}, votes string, posterior double, score double, kept boolean"), binary=(text,))
