"""Periodic run detection (13): string synchronising sets at dyadic scales.

A run is a maximal stretch of words with smallest period q and at least ``EXPONENT`` periods.

* At scale t a position i is in the synchronising set if the least hash of the t-word factors that start
  in [i, i + t] is that of i or of i + t. Whether it is depends on 2t words only, so equal stretches choose
  equal positions. Positions inside highly periodic regions (period up to t / 4) take no part.
* A run of period q with t < q <= 2t holds such a position s in its first t words, and s + q is one too.
  Their contexts of 2t >= q words are equal, and no equal context lies between them, as a primitive
  period's rotations are all different. So neighbours of equal context, t to 2t apart, propose every
  period; proposals are then extended word by word, and kept if their stretch is long and primitive.
* Periods up to ``SMALL`` are found by comparing words that far apart. They, and the runs of smaller
  scales, are the highly periodic regions that larger scales leave out.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import fields, free_name, map_rows

EXPONENT = 4
SHORTEST = 6  # words of a run
SMALL = 8  # periods up to here are compared directly; a power of two, the first scale

_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_FIRST, _SECOND = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(30))) * _SECOND
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return np.minimum(values ^ (values >> np.uint64(31)), _NONE - np.uint64(1))


def _stretches(equal: np.ndarray, least: int) -> list[tuple[int, int]]:
    """(first, end) of the stretches of at least ``least`` true values."""
    edge = np.flatnonzero(np.diff(np.r_[False, equal, False].astype(np.int8)))
    first, end = edge[::2], edge[1::2]
    long = end - first >= least
    return list(zip(first[long].tolist(), end[long].tolist()))


def _primitive(codes: np.ndarray, start: int, period: int) -> bool:
    """Whether the ``period`` words from ``start`` are no repetition of fewer words."""
    word, left, factor = codes[start:start + period], period, 2
    while left > 1:
        if left % factor:
            factor = factor + 1 if factor * factor <= left else left
            continue
        while left % factor == 0:
            left //= factor
        shift = period // factor
        if np.array_equal(word[:-shift], word[shift:]):
            return False
    return True


def _matching(a: np.ndarray, b: np.ndarray) -> int:
    """Number of leading elements in which ``a`` and ``b`` agree, compared in growing pieces."""
    n, at, size = min(len(a), len(b)), 0, 32
    while at < n:
        differ = np.flatnonzero(a[at:min(n, at + size)] != b[at:min(n, at + size)])
        if len(differ):
            return at + int(differ[0])
        at, size = at + size, size * 4
    return n


def _extended(codes: np.ndarray, places: np.ndarray, period: int) -> list[tuple[int, int]]:
    """(start, end) of the maximal stretches of this period that hold a place and the word a period on."""
    out, at = [], 0
    while at < len(places):
        place = int(places[at])
        end = place + _matching(codes[place:], codes[place + period:])
        start = place - _matching(codes[:place][::-1], codes[:place + period][::-1][:place])
        if end - start >= (EXPONENT - 1) * period:
            out.append((start, end + period))
        at = int(np.searchsorted(places, max(end, place + 1)))
    return out


def _least_in(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of ``width`` values from each position on, by doubling."""
    done = 1
    while done < width:
        step = min(done, width - done)
        values = np.minimum(values[:-step], values[step:])
        done += step
    return values


def _proposals(names: np.ndarray, contexts: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) of neighbours of equal context in the synchronising set of this scale.

    ``names`` are hashes of the factors of ``scale`` words, ``_NONE`` where these are highly periodic.
    """
    if len(names) <= scale:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    least = _least_in(names, scale + 1)
    chosen = np.flatnonzero(((names[:len(least)] == least) | (names[scale:] == least)) & (least != _NONE))
    order = chosen[np.argsort(contexts[chosen], kind="stable")]
    same = contexts[order[1:]] == contexts[order[:-1]]
    apart = order[1:] - order[:-1]
    take = same & (apart > scale) & (apart <= 2 * scale)
    return order[:-1][take], apart[take]


def runs(codes: np.ndarray, texts: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of at least ``EXPONENT`` periods, by start and period.

    ``codes`` are the words of several texts end to end as integers, with a negative integer of its own
    after each text, which therefore no run crosses; ``texts`` are the texts' lengths.
    """
    found: list[tuple[int, int, int]] = []
    for period in range(1, SMALL + 1):
        equal = codes[period:] == codes[:-period]
        for start, end in _stretches(equal, (EXPONENT - 1) * period):
            if _primitive(codes, start, period):
                found.append((start, end + period - start, period))
    scale = SMALL
    longest = int(texts.max(initial=0))
    if longest <= EXPONENT * scale:
        return sorted((s, n, p) for s, n, p in found)
    # Only texts that can hold a run of a larger scale go on; ``origin`` says where their words stood.
    names = _mixed(codes.astype(np.uint64) * _FIRST)
    width = 1
    while width < scale:
        names = _mixed(names[:-width] * _FIRST + names[width:])
        width *= 2
    while longest > EXPONENT * scale:
        contexts = _mixed(names[:-scale] * _FIRST + names[scale:]) if len(names) > scale else names[:0]
        plain = names
        periodic = [(s, n) for s, n, p in found if 4 * p <= scale <= n]
        if periodic:
            plain = names.copy()
            for s, n in periodic:
                plain[s:s + n - scale + 1] = _NONE
        # A chosen position needs a context of 2 x scale words.
        places, periods = _proposals(plain[:len(contexts) + scale], contexts, scale)
        order = np.lexsort((places, periods))
        places, periods = places[order], periods[order]
        for part in np.split(np.arange(len(places)), np.flatnonzero(np.diff(periods)) + 1):
            if len(part):
                period = int(periods[part[0]])
                for start, end in _extended(codes, places[part], period):
                    if _primitive(codes, start, period):
                        found.append((start, end - start, period))
        names, scale = contexts, scale * 2
    return sorted(set(found))


def _found(bodies: list) -> list[tuple[list[bytes], list[tuple[int, int, int]]]]:
    """Each text's words and runs (start, length, period); long and short texts are searched apart."""
    words = [b.split() if b else [] for b in bodies]
    out: list[list[tuple[int, int, int]]] = [[] for _ in bodies]
    sizes = np.array([len(w) for w in words], np.int64)
    kind = np.zeros(len(words), np.int64)
    kind[sizes > EXPONENT * SMALL] = np.log2(sizes[sizes > EXPONENT * SMALL]).astype(np.int64)
    for k in np.unique(kind[sizes >= SHORTEST]).tolist():
        mine = np.flatnonzero((kind == k) & (sizes >= SHORTEST)).tolist()
        known: dict[bytes, int] = {}
        codes, starts = [], []
        for n, i in enumerate(mine):
            starts.append(len(codes))
            codes += [known.setdefault(w, len(known)) for w in words[i]]
            codes.append(-1 - n)
        starts = np.array(starts)
        for start, length, period in runs(np.array(codes, np.int64), sizes[mine]):
            if length >= SHORTEST:
                at = int(np.searchsorted(starts, start, "right")) - 1
                out[mine[at]].append((start - int(starts[at]), length, period))
    return list(zip(words, out))


def find_runs(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Rows ``(key, n_words, runs, collapsed)``, one for each row of ``df``.

    Words are maximal runs of other than ASCII white space. ``runs`` are structs of ``start`` (word
    number from 0), ``length`` and ``period``, by start and period: all maximal stretches of at least
    six words and four smallest periods. ``collapsed`` joins by one space the words that no run covers
    after its first period.
    Null and empty texts have no words and no runs; rows with null or equal keys are judged each for
    itself; an empty table gives an empty result; other columns are not read, and ``key`` may have any
    name. Texts are read whole where they are, without a shuffle; a task needs some 100 bytes for each
    word of its longest text.
    """
    kind = df.schema[key].dataType.simpleString()

    def kernel(keys: list, bodies: list) -> list:
        counts, found, kept = [], [], []
        for words, mine in _found(bodies):
            counts.append(len(words))
            found.append([{"start": s, "length": n, "period": p} for s, n, p in mine])
            if mine:
                stay = np.ones(len(words), bool)
                for s, n, p in mine:
                    stay[s + p:s + n] = False
                words = [words[i] for i in np.flatnonzero(stay).tolist()]
            kept.append(b" ".join(words).decode())
        return [keys, counts, found, kept]

    schema = fields(f"`{key}` {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
    body = free_name(df, "body")
    return map_rows(df.select(F.col(key), F.col(text).alias(body)), kernel, schema, binary=(body,))
