"""SimHash groups and substring dedup against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash

from codeloom.llm import simhash, substrings
from codeloom.llm.components import components
from codeloom.llm.queries import QUERIES


def slow_print(text, shingle=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    runs = [words[i:i + shingle] for i in range(len(words) - shingle + 1)] or ([words] if words else [])
    hashes = [xxhash.xxh64_intdigest(" ".join(r).encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_groups(prints, distance=3):
    """Index of the least member reachable."""
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    values = np.array(prints, np.uint64)
    for i in range(len(prints)):
        for j in (np.flatnonzero(np.bitwise_count(values[i + 1:] ^ values[i]) <= distance) + i + 1).tolist():
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_op2_equals_brute_force(spark, sf):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    prints = [slow_print(t) for _, t in docs]
    want = {d: (f"{p:016x}", docs[g][0]) for (d, _), p, g in zip(docs, prints, slow_groups(prints))}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op2_simhash"](spark, sf).collect()}
    assert got == want
    assert len({c for _, c in got.values()}) < len(got)


@pytest.mark.parametrize("file_rows", [2000, 15])
def test_dense_fingerprints_lose_no_link(spark, file_rows):
    rnd = random.Random(3)
    bases = [rnd.getrandbits(64) for _ in range(5)]
    prints = sorted({b ^ sum(1 << rnd.randrange(64) for _ in range(rnd.randrange(5))) & (1 << 64) - 1
                     for b in bases for _ in range(40)})
    df = spark.createDataFrame([(p - (p >> 63 << 64),) for p in prints], "fp long")
    root = {r.node & (1 << 64) - 1: r.root for r in components(simhash.near_links(df, 3, file_rows)).collect()}
    want = slow_groups(prints)
    for i, p in enumerate(prints):
        for j, q in enumerate(prints[:i]):
            assert (want[i] == want[j]) == (root.get(p, ("alone", p)) == root.get(q, ("alone", q)))


def test_masks_share_a_file_with_every_neighbour():
    rnd = random.Random(5)
    for mask in (0, simhash.masks(0, 3)[4]):
        for _ in range(200):
            a = rnd.getrandbits(64)
            free = [b for b in range(64) if not mask >> b & 1]
            b = a ^ sum(1 << x for x in rnd.sample(free, 3))
            assert any(a & m == b & m for m in simhash.masks(mask, 3))


def test_components_of_chain_and_star(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 150)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)} | {150: 150, 200: 150}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_edges(edges, nothing):
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(edges).collect()), key=str)
    # Null, empty and blank texts have fingerprint zero and link; equal texts link.
    assert {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (8, 8), (9, 8), (None, 1)} <= set(got)
    assert len(got) == edges.count() and got.count((6, 6)) == 2
    assert simhash.near_duplicates(nothing).count() == 0
    for key in ("id", "fp", "first", "root"):
        named = simhash.near_duplicates(edges.drop(key).withColumnRenamed("doc_id", key), key=key)
        assert named.columns[0] == key and named.count() == edges.count()


def test_long_texts_are_printed_in_slices(monkeypatch):
    text = " ".join(f"w{i * i % 997}" for i in range(400))
    monkeypatch.setattr(simhash, "PRINT_SLICE", 37)
    assert simhash.fingerprint(text.encode()) == slow_print(text)


def slow_removal(docs, window):
    first = {}
    words = {}
    for key, text in docs:
        own = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
        words.setdefault(key, []).append(own)
        if key is not None:
            for i in range(len(own) - window + 1):
                run = tuple(own[i:i + window])
                first[run] = min(first.get(run, key), key)
    out = []
    for key, text in docs:
        own = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
        gone = set()
        for i in range(len(own) - window + 1):
            if key is not None and first[tuple(own[i:i + window])] < key:
                gone |= set(range(i, i + window))
        out.append((key, len(own), len(gone), " ".join(w for i, w in enumerate(own) if i not in gone)))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("window", "seed"), [(5, 1), (12, 2), (50, 3)])
def test_removal_equals_brute_force(spark, window, seed):
    rnd = random.Random(seed)
    passages = [[rnd.choice("abcdefghij") * rnd.randint(1, 3) for _ in range(window + rnd.randrange(20))] for _ in range(6)]
    docs = []
    for i in range(60):
        words = []
        for _ in range(rnd.randrange(5)):
            words += rnd.choice(passages) if rnd.random() < 0.5 else [f"w{rnd.randrange(50)}" for _ in range(rnd.randrange(60))]
        docs.append((rnd.randrange(70), " ".join(words)))
    docs += [(None, " ".join(passages[0])), (3, None), (200, docs[5][1]), (201, docs[5][1]), (200, docs[5][1])]
    got = sorted((tuple(r) for r in substrings.remove_repeats(
        spark.createDataFrame(docs, "doc_id long, text string"), window=window).collect()), key=repr)
    assert got == slow_removal(docs, window)


def test_removal_edges(edges, nothing):
    got = {(r.doc_id, r.n_words, r.n_removed) for r in substrings.remove_repeats(edges).collect()}
    assert (1, 0, 0) in got and (4, 30_001, 0) in got and (5, 30_001, 30_001) in got and (9, 60, 60) in got
    assert substrings.remove_repeats(edges).count() == edges.count()
    assert substrings.remove_repeats(nothing).count() == 0


def test_equal_windows_have_equal_anchors():
    rnd = random.Random(4)
    run = [b"%d" % rnd.randrange(30) for _ in range(50)]
    found = set()
    for _ in range(20):
        before = [b"%d" % rnd.randrange(30) for _ in range(rnd.randrange(30))]
        hashes, at = substrings.anchors([*before, *run, b"end"], 50)
        found.add((int(hashes[len(before)]), int(at[len(before)]) - len(before)))
    assert len(found) == 1
