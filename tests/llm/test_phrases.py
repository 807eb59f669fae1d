"""Collocations against counts of every phrase."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from codeloom.llm import collocations


def slow(docs, support, limit, share=80, scale=2_000_000):
    counts, total = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for n in range(1, 5):
                counts.update((lang, tuple(words[i:i + n])) for i in range(len(words) - n + 1))
    often = {k: f for k, f in counts.items() if f >= support}
    found = {}
    for (lang, p), a in often.items():
        if len(p) > 1:
            cuts = [(scale * a // (counts[lang, p[:k]] + counts[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            around = [f for (g, q), f in often.items() if g == lang and len(q) > len(p) and any(
                q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if not any(100 * f >= share * a for f in around):
                found.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), counts[lang, p[:k]], counts[lang, p[k:]]))
    return sorted((lang, rank, p.decode(), -a, l, r, total[lang], -s)
                  for lang, rows in found.items() for rank, (s, a, p, l, r) in enumerate(sorted(rows)[:limit], 1))


def corpus(seed, n):
    rnd = random.Random(seed)
    fixed = ["new york city", "in spite of", "Of the", "on the other hand", "Ünter Öl", "a b c"]
    out = []
    for i in range(n):
        parts = [rnd.choice(fixed) if rnd.random() < 0.4 else rnd.choice("abcdefgh") for _ in range(rnd.randrange(60))]
        text = "".join(p + rnd.choice([" ", " ", " ", "\t ", ". ", ",", "\n", ":"]) for p in parts)
        out.append((text, rnd.choice(["en", "en", "de", None, "und"])))
    return out + out[:20] * 4 + [(None, "en"), ("", None), (" \t ", "fr"), ("... !!", "fr"), ("x " * 500, "x")]


def mined(spark, docs, **options):
    df = spark.createDataFrame(docs, "text string, lang string").repartition(5)
    return sorted(map(tuple, collocations.collocations(df, **options).collect()))


@pytest.mark.parametrize(("seed", "support", "limit"), [(1, 30, 2000), (2, 9, 7), (3, 2, 2000)])
def test_equals_counts_of_all_phrases(spark, seed, support, limit):
    docs = corpus(seed, 150)
    want = slow(docs, support, limit)
    assert len(want) > 15 and mined(spark, docs, support=support, limit=limit) == want


def test_tasks_that_flush_and_crowded_bits_lose_nothing(spark, monkeypatch):
    docs = corpus(4, 150)
    want = slow(docs, 10, 2000)
    monkeypatch.setattr(collocations, "HELD", 50)
    monkeypatch.setattr(collocations, "NAMED", 20)
    monkeypatch.setattr(collocations, "MOST_WIDTH", 15)
    assert mined(spark, docs, support=10, limit=2000) == want


def test_bit_table_holds_all(spark):
    values = np.random.default_rng(1).integers(-2**63, 2**63 - 1, 5000)
    df = spark.createDataFrame([(int(v),) for v in values], "h long").repartition(3)
    table = collocations.Bits(*collocations.bit_table(df, 5000))
    assert table.holds(values.view(np.uint64)).all()
    assert table.holds(np.random.default_rng(2).integers(-2**63, 2**63 - 1, 5000).view(np.uint64)).mean() < 0.2


def test_scores_are_exact_beyond_64_bits(spark):
    big = 2**62 + 7
    row = spark.sql(f"SELECT (cast(2000000 AS decimal(10,0)) * cast({big} AS decimal(20,0))) div cast({big // 3} AS decimal(38,0)) AS q").first()
    assert row.q == 2_000_000 * big // (big // 3)


def test_phrase_edges(edges, nothing, spark):
    df = edges.selectExpr("*", "cast(null AS string) AS lang", "1 AS phrase", "2 AS shard", "3 AS h")
    got = sorted(map(tuple, collocations.collocations(df, limit=5).collect()))
    assert got == slow([(r.text, None) for r in edges.collect()], 30, 5) and "the end" in {r[2] for r in got}
    assert collocations.collocations(df.filter("false"), limit=5).count() == 0
    assert mined(spark, [("a b " * 40, None)], support=30, limit=9) == slow([("a b " * 40, None)], 30, 9)
