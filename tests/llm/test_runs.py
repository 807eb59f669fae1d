"""Periodic runs against a search of every period at every place."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from codeloom.llm import periodic_runs
from codeloom.llm.queries import QUERIES


def slow_runs(words, shortest=6, exponent=4):
    """Every period's maximal stretches; a stretch counts for its smallest period."""
    found = {}
    for q in range(1, len(words) // exponent + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i:
                found.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items() if n >= max(shortest, exponent * q))


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return [w for i, w in enumerate(words) if i not in gone]


def texts(seed):
    """Random texts with powers of words, also nested ones, with an edit here and there."""
    rnd = random.Random(seed)
    word = lambda: rnd.choice("abcdefghijklmnop")

    def power(depth):
        base = [word() for _ in range(rnd.choice([1, 1, 2, 3, 5, 8, 9, 16, 17, 33, 40]))]
        if depth and rnd.random() < 0.6:
            base += power(depth - 1) + [word() for _ in range(rnd.randrange(4))]
        out = base * rnd.choice([3, 4, 4, 5, 6, 11])
        if rnd.random() < 0.3:
            out[rnd.randrange(len(out))] = "x"
        return out[:rnd.randint(len(out) * 3 // 4, len(out))]

    out = []
    for _ in range(60):
        words = []
        for _ in range(rnd.randrange(4)):
            words += [word() for _ in range(rnd.randrange(30))] + power(rnd.randrange(3))
        out.append(words)
    return out + [[], ["a"], ["a"] * 5, ["a"] * 6, ["a", "b"] * 4, ["a", "b"] * 3, ["a"] * 300, list("ab" * 90 + "c") * 5]


@pytest.mark.parametrize("seed", range(4))
def test_runs_equal_brute_force(seed):
    mine = texts(seed)
    got = periodic_runs._found([" ".join(w).encode() for w in mine])
    assert len({p for _, runs in got for _, _, p in runs}) > 15
    assert max(p for _, runs in got for _, _, p in runs) > 60
    for words, (_, runs) in zip(mine, got):
        assert runs == slow_runs(words)


def test_fibonacci_and_square_free_texts():
    """Texts with very many runs of small exponents, and with none."""
    fib, thue = ["a", "a b"], "a"
    while len(fib[-1]) < 3000:
        fib.append(f"{fib[-1]} {fib[-2]}")
    for _ in range(11):
        thue += thue.translate(str.maketrans("ab", "ba"))
    both = [fib[-1].split(), list(thue)]
    got = periodic_runs._found([" ".join(w).encode() for w in both])
    assert [r for _, r in got] == [slow_runs(w) for w in both]


def test_synchronising_positions_are_consistent_and_dense():
    rnd = random.Random(1)
    part = [rnd.randrange(1000) for _ in range(400)]
    codes = np.array([5, 6, 7, *part, -1, 9, *part, -2], np.int64)
    names = periodic_runs._mixed(codes.astype(np.uint64))
    for _ in range(4):
        width = len(codes) - len(names) + 1
        names = periodic_runs._mixed(names[:-width] * periodic_runs._FIRST + names[width:])
    scale = 16
    least = periodic_runs._least_in(names, scale + 1)
    chosen = np.flatnonzero((names[:len(least)] == least) | (names[scale:] == least))
    first = {i - 3 for i in chosen.tolist() if 3 <= i <= 403 - 2 * scale}
    second = {i - 405 for i in chosen.tolist() if 405 <= i <= 805 - 2 * scale}
    assert first == second and max(np.diff(sorted(first))) <= scale


def test_find_runs_rows(spark):
    docs = [(1, "a b " * 5 + "c"), (None, None), (2, ""), (2, "x  x\tx x\nx x"), (3, "x x x x x")]
    got = {(r.doc_id, r.n_words, tuple(map(tuple, r.runs)), r.collapsed)
           for r in periodic_runs.find_runs(spark.createDataFrame(docs, "doc_id int, text string")).collect()}
    assert got == {(1, 11, ((0, 10, 2),), "a b c"), (None, 0, (), ""), (2, 0, (), ""), (2, 6, ((0, 6, 1),), "x"),
                   (3, 5, (), "x x x x x")}


def test_runs_edges(edges, nothing):
    rows = periodic_runs.find_runs(edges).collect()
    assert len(rows) == edges.count() and periodic_runs.find_runs(nothing).count() == 0
    assert {(r.doc_id, r.n_words, r.collapsed) for r in rows} >= {
        (None, 0, ""), (1, 0, ""), (4, 30_001, "ab " + "z" * 20_000), (8, 60, "The end.")}
    for key in ("start", "body", "id"):
        assert periodic_runs.find_runs(edges.withColumnRenamed("doc_id", "was").withColumnRenamed("id", "old").selectExpr(
            f"was AS `{key}`", "text"), key=key).columns[0] == key


def test_op13_equals_brute_force(spark, sf):
    want = []
    for doc, text in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h, n = zlib.crc32(str(doc).encode()), len(words)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = slow_runs(words) if n < 4000 else periodic_runs._found([" ".join(words).encode()])[0][1]
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
        digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
        want.append((doc, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
                     digest("".join(f"{s},{k},{q}\n" for s, k, q in runs)), digest(" ".join(collapsed(words, runs)))))
    got = [tuple(r) for r in QUERIES["op13_periodic_runs"](spark, sf).select(
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()]
    assert sorted(got) == sorted(want)
    assert sum(r[1] > 0 for r in want) > 5
