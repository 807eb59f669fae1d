"""Personal data: patterns against plain searches, the network's gradients, and redaction."""

import hashlib
import re
from itertools import product

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codeloom.llm import personal_data
from codeloom.llm.personal_data import KINDS, Tagger
from codeloom.llm.queries import QUERIES

TEXT = "write to jo.doe@mail.example.org or +1 (988) 555-2485, host 10.0.0.7 card 4041894974608795 end"


def slow_base(text):
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            found.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m.group())
        s = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d)))
        if 12 <= len(d) <= 19 and s % 10 == 0:
            found.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab@.-+ 012589()%é", max_size=60))
def test_base_equals_plain_search(text):
    assert personal_data.base_spans(text)[0] == slow_base(text)


def test_base_of_documents(spark, sf, monkeypatch):
    monkeypatch.setattr(personal_data, "STEPS", 60)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    rows = QUERIES["op9_personal_data"](spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        want = slow_base(docs[r.doc_id])
        joined = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in want)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in personal_data.BASE_KINDS] == [sum(w[1] == i for w in want) for i in range(4)]
        assert set(filter(None, joined.split(","))) <= set(r.spans.split(","))


def test_gradients_are_right():
    rnd = np.random.default_rng(0)
    tagger = Tagger.fresh()
    tagger.w = {k: v.astype(np.float64) for k, v in tagger.w.items()}
    ids, gold = rnd.integers(1, 24, (2, personal_data.WINDOW)) + 32 * rnd.integers(0, 40, (2, personal_data.WINDOW)), rnd.integers(0, 9, (2, personal_data.WINDOW))

    def loss():
        e = tagger.emissions(ids)
        score = e[np.arange(2)[:, None], np.arange(personal_data.WINDOW)[None], gold].sum(1)
        return (tagger._passes(e)[2] - score - tagger.w["trans"][gold[:, :-1], gold[:, 1:]].sum(1)).mean()

    for name, g in tagger.gradients(ids, gold).items():
        at = (int(ids[0, 0]) & 31, 1) if name == "embed" else (int(ids[0, 0]) >> 5, 1) if name == "shape" else tuple(rnd.integers(0, s) for s in tagger.w[name].shape)
        old = tagger.w[name][at]
        tagger.w[name][at] = old + 0.01
        high = loss()
        tagger.w[name][at] = old - 0.01
        low = loss()
        tagger.w[name][at] = old
        assert g[at] == pytest.approx((high - low) / 0.02, abs=2e-3)


@pytest.fixture(scope="module")
def trained():
    """A network for windows around the two kinds of spans of made-up texts."""
    rnd = np.random.default_rng(3)
    texts = []
    for _ in range(240):
        words = ["".join(rnd.choice(list("abcdefg"), rnd.integers(2, 8))) for _ in range(12)]
        words[int(rnd.integers(0, 12))] = rnd.choice(["ab.12@mail3.example.com", "44.12.200.7", "code 77x", "9.1"])
        texts.append(" ".join(words))
    ids, gold = [], []
    for t in texts:
        classes = personal_data.classes_of(t)
        starts = personal_data.marked_windows(classes)
        ids.append(personal_data.cut(classes, starts))
        gold.append(personal_data.cut(personal_data.gold_labels(len(t), personal_data.base_spans(t)[0]), starts))
    ids, gold = np.concatenate(ids).astype(np.int64), np.concatenate(gold).astype(np.int64)
    gold[:, 0] = np.where((gold[:, 0] > 0) & (gold[:, 0] % 2 == 0), gold[:, 0] - 1, gold[:, 0])
    return Tagger.fresh().fit(ids, gold), texts


def test_network_learns_spans(trained):
    tagger, texts = trained
    base = [personal_data.base_spans(t)[0] for t in texts]
    read = personal_data.read_windows(tagger, texts)
    hits = sum(len(set(a) & set(b)) for a, b in zip(base, read))
    assert hits > 0.5 * sum(map(len, base)) and sum(map(len, read)) - hits < 0.1 * hits


@pytest.fixture(scope="module")
def learnt(spark, sf):
    """A network trained by the operator on three of four documents, and the texts of the others."""
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.1')}/documents.parquet")
    held = [r.text for r in docs.filter("doc_id % 4 = 0 AND text RLIKE '[0-9@]'").orderBy("doc_id").collect()]
    return personal_data.train(docs.filter("doc_id % 4 > 0")), held


def test_network_finds_spans_of_held_out_texts(learnt):
    """Each kind as it stands, and written so that no pattern finds it; hardly anything else."""
    tagger, held = learnt
    marked = [personal_data.labelled_spans(t) for t in held]
    pairs = list(zip(held, marked)), [personal_data.rewritten(t, s) for t, s in zip(held, marked)]
    for part in pairs:
        read = personal_data.read_windows(tagger, [t for t, _ in part])
        for kind in range(len(KINDS)):
            want = {(i, s) for i, (_, spans) in enumerate(part) for s in spans if s[1] == kind}
            got = {(i, s) for i, spans in enumerate(read) for s in spans if s[1] == kind}
            assert len(want) > 20 and len(want & got) >= 0.85 * len(want) and len(got - want) <= 0.1 * len(want)


def test_network_adds_unlisted_forms(learnt):
    """Forms that no pattern finds, planted in prose; nothing is added to numbers of other kinds."""
    tagger, held = learnt
    rnd = np.random.default_rng(2)
    digits = lambda k: "".join(map(str, rnd.integers(0, 10, k)))
    hexes = lambda k: "".join(rnd.choice(list("0123456789abcdef"), k))
    forms = {"secret": lambda: hexes(40), "phone": lambda: f"{digits(3)}-{digits(3)}-{digits(4)}",
             "email": lambda: f"erlee.{digits(2)}[at]mail{digits(1)}[dot]example[dot]com"}
    before = {"secret": 'token = "', "phone": "", "email": ""}  # the form that these documents hold
    prose = [t[:60] for t in held if not re.search("[0-9@]", t[:60])][:20]
    for kind, form in forms.items():
        found = 0
        for words in prose:
            piece = form()
            text = f"{words} {before[kind]}{piece} {words}"
            base, spans = personal_data.find_spans(tagger, [text])[0]
            found += any(text[s:e] == piece and KINDS[k] == kind for s, k, e in spans) and not base
        assert found >= 0.75 * len(prose)
    plain = ["Licensed under CC BY-NC 4.0.", "section 3.2 of 14 pages, 2019", "version 10.2 has 4000 lines"]
    added = [s for words in prose for p in plain for _, s in personal_data.find_spans(tagger, [f"{words} {p} {words}"]) if s]
    assert len(added) <= 2


def test_credentials_are_drawn_out_to_their_token():
    text = "key AB12cd34EF56+/x9, and 'zz99zz99zz' end"
    spans = [(6, 4, 10), (12, 4, 15), (27, 4, 30)]
    assert [text[s:e] for s, _, e in personal_data.whole_credentials(text, spans)] == ["AB12cd34EF56+/x9", "zz99zz99zz"]


def test_characters_know_the_shape_of_their_token():
    classes = personal_data.classes_of("ab AB12 x@y\né")
    assert (classes & personal_data._CLASS).tolist() == [2, 2, 11, 3, 3, 4, 4, 11, 2, 5, 2, 12, 23]
    shape = (classes >> personal_data.CLASS_BITS).tolist()
    assert shape[0] == shape[1] == 14 and shape[3:7] == [36] * 4 and shape[2] == shape[7] == shape[11] == 0 and shape[12] == 0

def test_decoding_equals_all_paths():
    rnd = np.random.default_rng(5)
    tagger = Tagger.fresh()
    tagger.w["trans"] = rnd.normal(0, 1, tagger.w["trans"].shape).astype(np.float32)
    tagger.w["out"] = rnd.normal(0, 2, tagger.w["out"].shape).astype(np.float32)
    ids = rnd.integers(1, 24, (3, 4))
    e, trans = tagger.emissions(ids).astype(float), tagger.w["trans"].astype(float)
    labels, sure = tagger.decode(ids)
    paths = np.array(list(product(range(personal_data.LABELS), repeat=4)))
    for row in range(3):
        value = e[row, np.arange(4), paths].sum(axis=1) + trans[paths[:, :-1], paths[:, 1:]].sum(axis=1)
        share = np.exp(value - value.max())
        share /= share.sum()
        assert paths[value.argmax()].tolist() == labels[row].tolist()
        for t in range(4):
            assert sure[row, t] == pytest.approx(share[paths[:, t] == labels[row, t]].sum(), abs=1e-3)
        _, _, total = tagger._passes(tagger.emissions(ids))
        assert total[row] == pytest.approx(value.max() + np.log(np.exp(value - value.max()).sum()), abs=1e-3)


def test_windows_are_reconciled(trained):
    """Where the spans lie relative to the grid of windows makes little difference."""
    tagger, _ = trained
    text = "abc fed " * 40
    found = 0
    for at in range(0, 96, 8):
        body = text[:100 + at] + " 44.12.200.7 " + text[100 + at:]
        read = personal_data.read_windows(tagger, [body])[0]
        assert len(read) <= 1
        found += bool(read)
    assert found >= 6


def test_added_spans_keep_clear_of_base(trained):
    tagger, texts = trained
    for base, spans in personal_data.find_spans(tagger, [*texts, TEXT, ""]):
        assert set(base) <= set(spans)
        for s, k, e in set(spans) - set(base):
            assert all(e <= a or s >= b for a, _, b in base)


@pytest.mark.parametrize("phone", ["0171 2345678", "(555) 123-4567"])
def test_network_may_add_a_phone_without_plus(monkeypatch, phone):
    text = f"call {phone} or 4041 8949 7460 8796"
    span = (text.index(phone), 3, text.index(phone) + len(phone))
    wrong = (text.index("4041"), 2, len(text))  # a card that fails its own check stays out
    monkeypatch.setattr(personal_data, "read_windows", lambda tagger, texts: [[span, wrong]])
    assert personal_data.find_spans(None, [text]) == [([], [span])]


class Digits:
    """Labels each run of digits and letters ``x`` as a phone."""

    def decode(self, ids):
        plain = ids & personal_data._CLASS
        inside = (plain == personal_data._CLASSES[ord("5")]) | (plain == personal_data._CLASSES[ord("A")])
        first = inside & ~np.concatenate((np.zeros((len(ids), 1), bool), inside[:, :-1]), axis=1)
        return np.where(first, 7, np.where(inside, 8, 0)), np.ones(ids.shape)


@pytest.mark.parametrize("size", [20, 47, 60, 96, 130, 400])
@pytest.mark.parametrize("at", [0, 1, 40, 90, 143])
def test_pieces_cut_by_windows_are_joined(size, at):
    for run in ("5" * size, "A" * (size - 1) + "5"):
        text = "-" * at + run + "-" * 60
        assert personal_data.read_windows(Digits(), [text, "", "-" * 99]) == [[(at, 3, at + size)], [], []]


def test_copies_of_a_window_count_once(spark, monkeypatch):
    texts = ["copy 1.2.3.4 here"] * 50 + [f"own {'b' * i} 5" for i in range(9)]
    monkeypatch.setattr(Tagger, "fit", lambda self, ids, gold: ids)
    ids = personal_data.train(spark.createDataFrame([(t,) for t in texts], "text string"), sample=10)
    assert len(ids) == len(np.unique(ids, axis=0)) == 10


def test_rewritten_spans_keep_their_text():
    text = f"{TEXT} and password=abc123def456"
    spans = personal_data.labelled_spans(text)
    assert [KINDS[k] for _, k, _ in spans] == ["email", "phone", "ip", "card", "secret"]
    other, moved = personal_data.rewritten(text, spans)
    assert [k for _, k, _ in moved] == [k for _, k, _ in spans]
    for (a, k, b), (s, _, e) in zip(spans, moved):
        assert personal_data._otherwise(text[a:b], k, personal_data.crc32(text[a:b].encode())) == other[s:e]
    assert not {tuple(x) for x in moved} & {tuple(x) for x in personal_data.base_spans(other)[0] if x[1] in (0, 1)}


def test_edges(spark, edges, nothing, trained):
    tagger = trained[0]
    assert personal_data.find(edges, tagger).count() == edges.count()
    assert personal_data.find(nothing, tagger).count() == 0
    clean = personal_data.redact(edges.withColumn("text", edges.text), tagger)
    assert clean.columns == edges.columns
    assert {r.doc_id: r.text for r in clean.collect()}[1] is None
    hidden = personal_data.redact(spark.createDataFrame([(TEXT, 1), (TEXT, 1), ("", 2)], "text string, spans int"), tagger)
    assert [r.text for r in hidden.collect()] == [
        "write to [EMAIL] or [PHONE], host [IP] card [CARD] end"] * 2 + [""]
    untrained = personal_data.train(nothing)
    assert personal_data.find(edges, untrained).count() == edges.count()


def test_long_runs_are_linear():
    text = "a" * 300_000 + "@" + "9" * 3_000 + "@b.c"
    assert personal_data.base_spans(text)[0] == [(300_001, 0, len(text))]


def test_windows_of_written_addresses_and_long_credentials_are_read():
    """No digit and no @ near: a window is read for its ``at``, and for a digit further on in its run."""
    import numpy as np

    from codeloom.llm import personal_data as P

    class Stub:
        """Takes every stretch without a line end for an address."""

        def decode(self, ids):
            plain = ids & P._CLASS
            inside = (plain != P._CLASSES[ord("\n")]) & (plain > 0)
            first = inside & ~np.concatenate((np.zeros((len(ids), 1), bool), inside[:, :-1]), axis=1)
            return np.where(first, 1, np.where(inside, 2, 0)), np.ones(ids.shape)

    blank, address = "\n" * 200, "jane [at] example [dot] com"
    (base, every), = P.find_spans(Stub(), [blank + address + blank])
    assert base == [] and every == [(200, 0, 200 + len(address))]
    assert P.find_spans(Stub(), [blank + "plain words of prose" + blank]) == [([], [])]
    text = "x" * 300 + "7" + "\n" * 300
    assert P.marked_windows(P.classes_of(text), text).tolist() == list(range(0, 301, P.STRIDE))
    assert P.marked_windows(P.classes_of(""), "").tolist() == []
