"""The pipeline: each stage's decisions, columns and rows against plain versions."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from codeloom.llm import personal_data, quality_rules, simhash

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
FIXTURE = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(autouse=True)
def short_training(monkeypatch):
    """What a stage hands on does not depend on how long the network was trained."""
    monkeypatch.setattr(personal_data, "STEPS", 40)


def words(n, seed):
    rnd = np.random.default_rng(seed)
    return " ".join(("the" if i % 4 == 0 else "".join(rnd.choice(list("abcdefghij"), 5))) for i in range(n)) + "."


def rows(*texts):
    return [(i, t, "en", "src0", len(t or "")) for i, t in enumerate(texts)]


def test_stage_names_and_columns(spark, sf):
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "near_duplicates", "decontamination", "personal_data", "bpe"]
    empty = spark.createDataFrame([], FIXTURE)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, empty, sf)
        assert out.columns == COLUMNS and out.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, empty, sf).count() == 0


def test_quality_stage(spark, sf):
    good = words(80, 1)
    docs = spark.createDataFrame(rows(good, "short", None, "a b c " * 60, good.replace(" ", "$$ ")), FIXTURE)
    assert [r.doc_id for r in corpus_pipeline.good_quality(spark, docs, sf).collect()] == [0]


def test_duplicate_stage(spark, sf):
    a, b = words(200, 2), words(200, 3)
    edited = a.replace(a.split()[101], "changed", 1)
    assert (simhash.fingerprint(a.encode()) ^ simhash.fingerprint(edited.encode())).bit_count() <= 3
    docs = rows(b, a, edited, a, b.upper()) + [(7, a, "de", "src1", 5), (9, words(90, 4), None, None, None)] * 2
    kept = corpus_pipeline.one_of_each(spark, spark.createDataFrame(docs, FIXTURE), sf)
    assert kept.columns == COLUMNS and sorted(r.doc_id for r in kept.collect()) == [0, 1, 9]


def test_duplicate_stage_names_its_row(spark, sf):
    """Rows of one id with different texts: the choice depends on the rows alone, not on their order."""
    docs = [(1, words(60, s), "en", "s", 1) for s in range(6)] + [(None, words(60, 9), "en", "s", 1)] * 2
    picks = set()
    for part in (docs, docs[::-1]):
        kept = corpus_pipeline.one_of_each(spark, spark.createDataFrame(part, FIXTURE).repartition(3), sf).collect()
        assert sorted((r.doc_id for r in kept), key=str) == [1, None, None]
        picks.add(next(r.text for r in kept if r.doc_id == 1))
    assert len(picks) == 1


def test_decontamination_stage(spark, sf):
    item = spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").first().text
    docs = spark.createDataFrame(rows(words(90, 5), f"{words(90, 6)} {item} {words(90, 7)}", None), FIXTURE)
    assert sorted(r.doc_id for r in corpus_pipeline.clean_of_benchmark(spark, docs, sf).collect()) == [0, 2]


def test_personal_stage_keeps_clean_text(spark, sf):
    docs = spark.createDataFrame(rows("mail a.b@c.example.com now", "nothing here", None), FIXTURE)
    got = {r.doc_id: r for r in corpus_pipeline.without_personal_data(spark, docs, sf).collect()}
    assert got[0].text == "mail [EMAIL] now" and got[0].n_chars == 16
    assert got[1].text == "nothing here" and got[2].text is None


def test_run_follows_the_stages(spark, sf):
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    good = {r.doc_id for r in quality_rules.keep_good(documents).collect()}
    assert got and set(got) < good
    docs = documents.filter(documents.doc_id.isin(*good))
    kept = corpus_pipeline.clean_of_benchmark(spark, corpus_pipeline.one_of_each(spark, docs, sf), sf)
    texts = {r.doc_id: r.text for r in corpus_pipeline.without_personal_data(spark, kept, sf).collect()}
    assert set(got) == set(texts)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for doc, text in texts.items():
        ids = library.encode(text, add_special_tokens=False).ids
        assert got[doc].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert np.frombuffer(got[doc].ids, "<u4").tolist() == ids and got[doc].n_tokens == len(ids)
