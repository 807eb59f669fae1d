"""Language ID: held-out accuracy, mixed texts, and Viterbi against all paths."""

from itertools import product

import numpy as np
import pytest

from codeloom.llm import language_id
from codeloom.llm.queries import QUERIES


@pytest.fixture(scope="module")
def model(spark, sf):
    return language_id.train(spark.read.parquet(f"{sf}/documents.parquet"))


def test_held_out_accuracy(spark, sf):
    sf = sf.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = QUERIES["op7_language_id"](spark, sf).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    out = [r for r in rows if r.held_out]
    assert 0.2 < len(out) / len(rows) < 0.5
    assert np.mean([r.lang == r.lang_pred for r in out]) > 0.98


def test_mixed_text_has_spans(spark, sf, model):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    parts = {lang: docs.filter(f"lang = '{lang}' AND length(text) > 400").first().text[:300] for lang in ("en", "de")}
    text = f"{parts['en']} {parts['de']} {parts['en']}"
    spans = model.spans(text)
    assert [s[2] for s in spans] == ["en", "de", "en"]
    assert abs(spans[1][0] - 301) < 20 and abs(spans[1][1] - 601) < 20


def test_viterbi_is_the_best_path():
    rnd = np.random.default_rng(1)
    model = language_id.Model(["a", "b", "c"], np.zeros((language_id.BUCKETS, 3), np.float32), {})
    for scale in (1, 5, 20, 60):
        for _ in range(20):
            scores = -rnd.random((6, 3)) * scale

            def value(path):
                return sum(scores[t, s] for t, s in enumerate(path)) - language_id.SWITCH * sum(x != y for x, y in zip(path, path[1:]))

            best = max(map(value, product(range(3), repeat=6)))
            assert value(model.labels(scores).tolist()) == pytest.approx(best)


def test_scripts_narrow_candidates(spark):
    rows = [("привет мир как дела", "ru"), ("hello world how are you", "en"), ("γεια σου κόσμε", "el")] * 3
    model = language_id.train(spark.createDataFrame(rows, "text string, lang string"))
    assert [p[0] for p in model.predict(["мвдлж", "qwrtz", "κόσμε", "漢字", "!! 123", None, ""])][:3] == ["ru", "en", "el"]
    assert [p[0] for p in model.predict(["!! 123", None, ""])] == ["und"] * 3
    assert model.score(["мвдлж"]).argmax() == model.languages.index("ru")


def test_numerals_are_no_letters(model):
    texts = ["²", "½ ①", "Ⅷ ³ ㊀", "12 _ ٣", "!"]
    assert [language_id.words_of(t) for t in texts] == [[]] * 5
    assert model.predict(texts) == [("und", 0.0)] * 5
    assert language_id.words_of("x² Ⅷa 漢字½é_ß") == ["x", "a", "漢字", "é", "ß"]
    assert all(c.isalpha() for w in language_id.words_of("".join(map(chr, range(0x3100)))) for c in w)


def test_number_of_languages_is_bounded(spark):
    rows = [(f"some text {i}", f"l{i}") for i in range(6)]
    with pytest.raises(ValueError, match="more than 5"):
        language_id.train(spark.createDataFrame(rows, "text string, lang string"), most=5)


def slow_prediction(model, text):
    """Gram by gram scores of each word, and the best of all sequences by a plain recursion."""
    words, n = [], 0
    for run in "".join(c if c.isalpha() else " " for c in text).split():
        words += [run[i:i + 64] for i in range(0, len(run), 64)]
    if not words:
        return "und", 0.0
    rows = []
    for w in words:
        body, total = f"<{w.lower()}>".encode(), np.zeros(len(model.languages))
        for size in (3, 5):
            for i in range(len(body) - size + 1):
                code = size
                for b in body[i:i + size]:
                    code = (code ^ b) * 0x100000001B3 % 2**64
                total = total + model.weights[(code ^ code >> 32) % 2**15]
        fits = model.scripts[language_id.script_of(w)]
        total[~fits] = -np.inf if fits.any() else total[~fits]
        rows.append(np.maximum(total - total.max(), -6.0))
    best, back = rows[0], []
    for row in rows[1:]:
        moved = best[None, :] - 12.0 * (1 - np.eye(len(best)))
        back.append(moved.argmax(axis=1))
        best = moved.max(axis=1) + row
    path = [int(best.argmax())]
    for step in back[::-1]:
        path.append(int(step[path[-1]]))
    sizes = np.bincount(path[::-1], [len(w) for w in words], len(model.languages))
    return model.languages[int(sizes.argmax())], sizes.max() / sizes.sum()


def test_predictions_equal_the_definitions(spark, sf, model):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").filter("length(text) < 3000").collect()]
    texts = texts[:60] + [a[:200] + b[:200] for a, b in zip(texts, texts[60:90])] + ["", "²", "漢字 the"]
    for text, (lang, score) in zip(texts, model.predict(texts)):
        want = slow_prediction(model, text)
        assert lang == want[0] and score == pytest.approx(want[1], abs=1e-6)


def test_edges(edges, nothing, spark, model):
    got = language_id.detect(edges, model, spans=True).collect()
    assert len(got) == edges.count()
    assert {(r.doc_id, r.lang_pred, r.score) for r in got if r.doc_id in (1, 2, 3)} == {(i, "und", 0.0) for i in (1, 2, 3)}
    assert language_id.detect(nothing, model).count() == 0
    none = language_id.train(spark.createDataFrame([("a", None), (None, "x")], "text string, lang string"))
    assert none.languages == [] and {r.lang_pred for r in language_id.detect(edges, none).collect()} == {"und"}


def test_memo_is_bounded(model, monkeypatch):
    monkeypatch.setattr(language_id, "MEMO_WORDS", 4)
    model.forget()
    texts = [["the", "and", "of", "und", "der"], ["la", "les", "the"]]
    got = model.scores(texts)
    monkeypatch.undo()
    model.forget()
    assert all(np.array_equal(a, b) for a, b in zip(got, model.scores(texts)))


def test_ascii_words_are_those_of_any_text():
    """The pattern for ASCII finds what the general one finds, with long runs cut alike."""
    from codeloom.llm import language_id as L

    text = "".join(map(chr, range(128))) * 2 + " x1y_z " + "Ab" * 70 + "9" + "c" * 64
    assert text.isascii() and L.words_of(text) == L._words().findall(text) and len(L.words_of(text)) > 9


def test_numbers_and_arrays_give_one_path():
    """The recursion by plain numbers, which few languages take, is that by arrays, ties included."""
    random = np.random.default_rng(7)
    for n, k in ((1, 1), (1, 3), (9000, 4), (400, 30)):
        scores = -6 * random.integers(0, 3, (n, k)).astype(np.float32) / 2
        assert language_id._path(scores, True).tolist() == language_id._path(scores, False).tolist()
        assert language_id._path(scores, True).size == n
