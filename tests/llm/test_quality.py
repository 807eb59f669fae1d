"""Quality rules, weak labels and decontamination."""

import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codeloom.llm import decontamination, quality_rules, weak_labels
from codeloom.llm.queries import QUERIES


def slow_measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    three = Counter(zip(words, words[1:], words[2:]))
    again = {i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if three[w] > 1 for k in range(3)}
    return dict(n_words=len(words), word_chars=sum(map(len, words)), n_symbols=len(re.findall("[#*$%&|<>]", text)),
                n_shouts=text.count("!"), n_lines=len(lines), n_dup_lines=len(lines) - len(set(lines)), n_repeat_words=len(again))


def test_measures_equal_brute_force(spark, sf, edges):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(60).union(edges.select("doc_id", "text"))
    for r in quality_rules.judge(docs).collect():
        m, want = r.quality.measures.asDict(), slow_measures(r.text)
        assert {k: m[k] for k in want} == want
        failed = m["n_words"] < 50 or 100 * m["n_repeat_words"] > 50 * m["n_words"]
        assert r.quality.base_failed == failed and r.quality.kept in (True, False) and not (failed and r.quality.kept)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\t!#É", max_size=60), min_size=1, max_size=8))
def test_measures_of_odd_texts(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in quality_rules.judge(df).collect():
        want = slow_measures(r.text)
        assert {k: r.quality.measures[k] for k in want} == want


def test_rules_edges(edges, nothing, spark):
    kept = quality_rules.keep_good(edges.withColumnRenamed("quality_", "quality"))
    assert "quality" in kept.columns and kept.count() == 0
    assert quality_rules.keep_good(nothing).count() == 0
    with pytest.raises(ValueError):
        quality_rules.judge(spark.createDataFrame([("t", 1)], "text string, quality int"))


def test_rules_part_labelled_documents(spark, sf):
    sf = sf.replace("0.001", "0.01")
    rows = QUERIES["op6_quality_rules"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    good = [r.kept for r in rows if r.quality == 1 and not r.base_failed]
    bad = [r.kept for r in rows if r.quality == 0]
    assert np.mean(good) == 1 and np.mean(bad) < 0.1


def test_native_plans(spark, sf):
    for name in ("op6_quality_rules", "op8_url_filters", "op10_decontamination"):
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().toString()
        assert not re.search("Python|Pandas|Arrow|CartesianProduct", plan)
    plan = QUERIES["op6_quality_rules"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_weak_labels_without_labels(spark, sf):
    sf = sf.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = weak_labels.train(docs)
    assert 0.7 < model.labels.share < 0.97 and (model.labels.accuracies > 0.6).all()
    rows = weak_labels.classify(docs, model).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").join(
        docs.selectExpr("doc_id", "size(split(text, ' ')) >= 50 AS long"), "doc_id").collect()
    assert len({r.doc_id for r in rows}) == len(rows) and all(0 <= r.score <= 1 and 0 <= r.posterior <= 1 for r in rows)
    assert np.mean([r.kept for r in rows if r.quality == 1 and r.long]) > 0.98
    assert np.mean([r.kept for r in rows if r.quality == 0]) < 0.3


def test_estimation_finds_accuracies():
    rnd = np.random.default_rng(2)
    good = rnd.random(20_000) < 0.8
    m = len(weak_labels.LABELLERS)
    right = np.linspace(0.75, 0.95, m)
    seen = rnd.random((len(good), m)) < 0.7
    vote = np.where(rnd.random((len(good), m)) < right, good[:, None], ~good[:, None])
    rows, counts = np.unique(np.where(seen, vote, 2).astype(int), axis=0, return_counts=True)
    model = weak_labels.estimate(rows, counts.astype(float))
    assert abs(model.share - 0.8) < 0.02 and np.abs(model.accuracies - right).max() < 0.03


def test_one_key_on_many_rows_sends_no_more_than_the_sample(spark, monkeypatch):
    hot = [(1, f"some words number {i} of one key " * 5) for i in range(600)] + [(1, "copied text " * 9)] * 300
    rows = hot + [(None, f"no key {i} at all " * 5) for i in range(20)] + [(i, f"own {i} text here " * 5) for i in range(2, 30)]
    sent = []
    monkeypatch.setattr(weak_labels, "fit_scorer", lambda sparse, good: sent.append(len(sparse)) or np.zeros(weak_labels.BUCKETS + 1))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    weak_labels.train(df, sample=10)
    weak_labels.train(df, sample=10_000)
    assert sent == [10, 600 + 1 + 20 + 28]


def test_distinct_words_don_t_depend_on_length():
    at = weak_labels.MEASURES.index("distinct")
    rnd = np.random.default_rng(1)
    words = [b"w%d" % i for i in rnd.zipf(1.6, 40_000) % 5000]
    short, long = (weak_labels.measures(b" ".join(w))[at] for w in (words[:1500], words))
    assert abs(short - long) < 0.05 and 0 < long <= 1
    assert weak_labels.measures(b" ".join(b"own%d" % i for i in range(9000)))[at] == 1


def slow_quality(text, model):
    """Votes, posterior, score and verdict of one text, straight from the definitions."""
    words = re.findall(rb"[^\x20\x09-\x0D]+", text)
    if not words:
        return "2" * 7, None, 0.0, False
    lower = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[.,;:!?]", b"", text.lower()))
    lines = [x for x in text.split(b"\n") if x.strip()]
    values = {
        "common": sum(w in weak_labels.COMMON for w in lower) / len(words),
        "word_length": sum(len(w) for w in words) / len(words),
        "symbols": len(re.findall(rb"[#*$%&|<>!{}\[\]=~^\\]", text)) / len(words),
        "distinct": sum(len(set(words[i:i + 500])) for i in range(0, len(words), 500)) / len(words),
        "copied_lines": 1 - len(set(lines)) / len(lines),
        "upper": len(re.findall(rb"[A-Z]", text)) / len(text),
        "line_words": len(words) / len(lines)}
    vote, odds = "", [1 - model.labels.share, model.labels.share]
    for j, (name, side, good, bad) in enumerate(weak_labels.LABELLERS):
        v = values[name]
        one = 1 if (v >= good if side == "high" else v <= good) else 0 if (v < bad if side == "high" else v > bad) else 2
        vote += str(one)
        odds = [o * model.labels.table[j, c, one] for c, o in enumerate(odds)]
    counts = {}
    for w in words:
        for salt, piece in ((1, w[-3:]), (2, w[:3])):
            code = int.from_bytes(piece.ljust(4, b" "), "little") * (0x9E3779B97F4A7C15 + 2 * salt) % 2**64 >> 52
            counts[code] = counts.get(code, 0) + 1
        size = 4096 + min(len(w), 31)
        counts[size] = counts.get(size, 0) + 1
    z = sum(model.weights[k] * (n / (len(words) + weak_labels.SHORT)) ** 0.5 for k, n in counts.items()) + model.weights[-1]
    score, posterior = 1 / (1 + np.exp(-np.clip(z, -30, 30))), odds[1] / sum(odds)
    return vote, posterior, score, bool(score >= model.limit or posterior >= weak_labels.SURE)


def test_classification_equals_the_definitions(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = weak_labels.train(docs)
    texts = {r.doc_id: (r.text or "").encode() for r in docs.select("doc_id", "text").collect()}
    for r in weak_labels.classify(docs, model).collect():
        vote, posterior, score, kept = slow_quality(texts[r.doc_id], model)
        assert (r.votes, r.kept) == (vote, kept) and r.score == pytest.approx(score, abs=1e-9)
        assert posterior is None or r.posterior == pytest.approx(posterior, abs=1e-9)


def test_weak_labels_edges(edges, nothing, spark):
    model = weak_labels.train(edges, sample=5)
    rows = weak_labels.classify(edges, model).collect()
    assert len(rows) == edges.count()
    assert all(not r.kept and r.score == 0 for r in rows if r.doc_id in (1, 2, 3))
    for empty in (weak_labels.train(nothing), weak_labels.train(spark.createDataFrame([(1, None)], "doc_id long, text string"))):
        assert weak_labels.classify(nothing, empty).count() == 0
        assert weak_labels.classify(edges, empty).count() == edges.count()
    same = spark.createDataFrame([(i, "the same words " * 20) for i in range(9)], "doc_id long, text string")
    assert len({r.score for r in weak_labels.classify(same, weak_labels.train(same)).collect()}) == 1


ITEM = " ".join(f"item{i}" for i in range(30))


def leaks(spark, docs, items, **more):
    found = decontamination.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"),
                                       spark.createDataFrame(items, "item_id long, text string"), **more)
    return {(r.doc_id, r.item_id): (r.n_shared, r.n_item) for r in found.collect()}


def test_leaks_are_found_in_long_documents(spark):
    far = " ".join(f"far{i}" for i in range(30_000))
    words = ITEM.upper().split()
    part = " ".join(words[:25])  # 21 of 26 shingles
    less = " ".join(words[:24])  # 20 of 26, under four fifths
    docs = [(1, f"{far} {ITEM} {far}"), (2, f"{far} {part} {far}"), (3, f"{less} {far}"), (4, far), (5, None), (6, "item0 item1"),
            (7, " ".join(words[:15])), (7, " ".join(words[11:])), (None, ITEM)]
    items = [(1, ITEM), (2, "too short"), (3, None), (None, ITEM), (4, ITEM + " and four more words")]
    got = leaks(spark, docs, items)
    assert got[1, 1] == (26, 26) and got[2, 1] == (21, 26) and (3, 1) not in got
    assert got[7, 1] == (26, 26)  # rows of one id are one document
    assert {d for d, _ in got} == {1, 2, 7} and {i for _, i in got} <= {1, 4}


@pytest.mark.parametrize("seed", range(6))
def test_rows_of_one_item_are_one_item(spark, seed):
    """An item of eight rows that share a head: a document with four fifths of all its shingles is found."""
    rnd = np.random.default_rng(seed)
    head = " ".join(f"h{i}" for i in range(6))
    items = [(1, f"{head} own{seed}x{i}") for i in range(8)]  # two shingles of the head, one more per row
    kept = rnd.permutation(8)[:6]
    docs = [(7, f"far away text here now. {' and then some other words follow. '.join(items[i][1] for i in kept)}"),
            (8, " between some other words here now ".join(items[i][1] for i in kept[:5]))]
    assert leaks(spark, docs, items) == {(7, 1): (8, 10)}


def test_only_candidates_are_verified(spark):
    """A shingle that all items have makes no pair of every document and every item."""
    common = "as we all know by now"
    items = [(i, f"{common} " + " ".join(f"i{i}w{k}" for k in range(30))) for i in range(40)]
    docs = [(i, f"{common} and " + " ".join(f"d{i}w{k}" for k in range(20))) for i in range(50)] + [(99, items[3][1])]
    assert set(leaks(spark, docs, items)) == {(99, 3)}
    sets = decontamination.item_shingles(spark.createDataFrame(items, "item_id long, text string"))
    sketch = decontamination.sketched(sets, "item_id")
    assert sets.count() == 40 * 32 and sketch.count() < 0.3 * sets.count()


def test_any_missing_shingles_are_tolerated(spark):
    """Whatever share below a fifth an item loses, the sketch still meets the document."""
    rnd = np.random.default_rng(0)
    items = [(i, " ".join(f"i{i}w{k}" for k in range(20 + 3 * i))) for i in range(20)]
    docs = []
    for i, text in items:
        words = text.split()
        at = int(rnd.integers(0, len(words)))
        docs.append((i, " ".join(w if k != at else "other" for k, w in enumerate(words))))
    got = leaks(spark, docs, items)
    for i, text in items:
        pieces = lambda t: {tuple(t[k:k + 5]) for k in range(len(t) - 4)}
        whole, other = pieces(text.split()), pieces(docs[i][1].split())
        assert ((i, i) in got) == (len(whole & other) * 100 >= 80 * len(whole))


def test_leaks_by_shuffle_are_the_same(spark, sf, monkeypatch):
    want = set(map(tuple, QUERIES["op10_decontamination"](spark, sf).collect()))
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", 0)
    assert set(map(tuple, QUERIES["op10_decontamination"](spark, sf).collect())) == want != set()


def test_leaks_edges(spark, edges, nothing):
    items = spark.createDataFrame([(1, "ab " * 40), (2, "the end. the end. the end.")], "item_id long, text string")
    clean = decontamination.remove_leaks(edges, items)
    assert clean.columns == edges.columns
    assert {r.doc_id for r in clean.collect()} == {None, 1, 2, 3, 6, 7, 10}
    assert decontamination.remove_leaks(nothing, items).count() == 0
    assert decontamination.remove_leaks(edges, items.filter("false")).count() == edges.count()


def test_scorer_learns_from_all_rows(spark):
    """All rows teach the scorer, however they are dealt; the sums are those of one machine, save for the units."""
    docs = _judged_texts(spark)
    one, many = (weak_labels.train(docs.repartition(n)) for n in (1, 7))
    assert np.array_equal(one.weights, many.weights) and one.limit == many.limit
    texts = [r.text.encode() for r in docs.collect()]
    found = [weak_labels.features(t) for t in texts]
    good = one.labels.posterior(np.array([weak_labels.votes(weak_labels.measures(t)) for t in texts]))
    assert 0 < (good > 0.5).sum() < len(good)
    assert np.abs(one.weights - weak_labels.fit_scorer(found, good)).max() < 0.05
    scores = np.array([one.score(t) for t in texts])
    part = lambda limit: good[scores < limit].sum() / good.sum() - (1 - good)[scores < limit].sum() / (1 - good).sum()
    assert part(one.limit) <= min(map(part, scores)) + 1e-3
    # A word that only some rows hold moves its weight, whatever their keys' hashes are.
    more = docs.unionByName(spark.range(9000).selectExpr("id + 1000000 AS doc_id", "repeat('qqq #### ', 60) AS text"))
    at = set(weak_labels.features(b"qqq")[0]) - {4096 + 3}
    assert all(weak_labels.train(more).weights[k] < 0 for k in at)


def _judged_texts(spark):
    good = "the house is of the people and it was in that town with a long road to the sea\n"
    return spark.createDataFrame(
        [(i, f"{good}{good[i % 40:]}word{i} and so on the way\n" * (1 + i % 3) if i % 4 else f"{'#$ ' * 40} XX{i} " * 3)
         for i in range(120)], "doc_id long, text string")
