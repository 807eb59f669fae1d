"""BPE coding and token counts against the tokenizers library."""

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from codeloom.llm import bpe, token_counts
from codeloom.llm.bpe import PairTest
from codeloom.llm.bpe_files import bpe_file, merge_word

WORD, BYTE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
ODD = ["", " ", "a  b\n\n c\t\td ", "it's I'LL don't 's's", "<|endoftext|> x <|endoftext|>", "<|startoftext|>a<|endoftext|>",
       "ΣΑΣ İI ǅ", "x</w>y </w>", "\x1c a\x1d\x85 b\xa0c", "a" * 5000, "é é ́", "12 345 ½ x²", "漢字かな 한국어 اب"]
BOTH = {"word": (Tokenizer.from_file(WORD), bpe.codec(WORD)), "byte": (Tokenizer.from_file(BYTE), token_counts.counter(BYTE))}


def ids(packed):
    return np.frombuffer(packed, "<u4").tolist()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=80), max_size=5))
def test_coding_equals_library(texts):
    library, own = BOTH["word"]
    for text, packed in zip(texts + ODD, own.encode(texts + ODD)):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids(packed) == want
        assert own.decode(packed) == library.decode(want, skip_special_tokens=False)


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=80))
def test_counts_equal_library(text):
    library, own = BOTH["byte"]
    for t in [text, *ODD]:
        assert own.of_text(t) == len(library.encode(t, add_special_tokens=False).ids)


def test_pair_test_agrees_with_exact_merging():
    file = bpe_file(WORD)
    test = PairTest(file.ranks, file.made, max(file.names) + 1)
    rnd = np.random.default_rng(1)
    a = rnd.choice(np.array(sorted(file.inner.values())), 3000)
    b = rnd.choice(np.array(sorted([*file.final.values()])), 3000)
    raw = {n: w for w, n in [*file.inner.items(), *file.final.items()]}
    own = bpe.codec(WORD)
    want = [own.exact(raw[x] + raw[y]) == [x, y] for x, y in zip(a.tolist(), b.tolist())]
    assert test(a, b).tolist() == want
    assert 0 < sum(want) < len(want)


def test_merging_takes_leftmost_of_equal_ranks():
    ranks, made = {(1, 1): 0}, [2]
    assert merge_word([1, 1, 1], ranks, made) == (1, [2, -1, 1])
    assert merge_word([], ranks, made)[0] == merge_word([1], ranks, made)[0] == 0


def test_memo_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_CHUNKS", 3)
    monkeypatch.setattr(token_counts, "MEMO_CHUNKS", 3)
    texts = ["one two three four five six", "seven eight one two"]
    own, counter = bpe.BpeCodec(WORD), token_counts.TokenCounter(BYTE)
    for text, packed in zip(texts, own.encode(texts)):
        assert ids(packed) == BOTH["word"][0].encode(text, add_special_tokens=False).ids
        assert counter.of_text(text) == len(BOTH["byte"][0].encode(text, add_special_tokens=False).ids)
    assert len(own.memo) <= 3 and len(counter.memo) <= 4


def test_frames(edges, nothing):
    coded = bpe.encode(edges, WORD, decoded=True)
    assert coded.columns == ["doc_id", "n_tokens", "ids", "decoded"]
    rows = coded.collect()
    assert len(rows) == edges.count()
    library = BOTH["word"][0]
    texts = [r.text for r in edges.select("text").collect()]
    assert sorted(ids(r.ids) for r in rows) == sorted(library.encode(t or "", add_special_tokens=False).ids for t in texts)
    again = {(r.doc_id, r.decoded) for r in bpe.decode(coded, WORD).collect()}
    assert again == {(r.doc_id, r.decoded) for r in rows}
    counted = token_counts.count_tokens(edges, BYTE).collect()
    assert sorted(r.n_tokens for r in counted) == sorted(
        len(BOTH["byte"][0].encode(t or "", add_special_tokens=False).ids) for t in texts)
    assert sorted(r.n_bytes for r in counted) == sorted(len((t or "").encode()) for t in texts)
    assert all(r.over_limit == (r.n_tokens > 512) for r in counted)
    for empty in (bpe.encode(nothing, WORD), token_counts.count_tokens(nothing, BYTE)):
        assert empty.count() == 0


@pytest.mark.parametrize("name", ["op1_bpe", "op5_token_counts"])
def test_queries(spark, sf, name):
    import hashlib

    from codeloom.llm.queries import QUERIES

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    rows = QUERIES[name](spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        text = docs[r.doc_id]
        if name == "op5_token_counts":
            n = len(BOTH["byte"][0].encode(text, add_special_tokens=False).ids)
            assert tuple(r) == (r.doc_id, len(text.encode()), n, n > 512)
        else:
            want = BOTH["word"][0].encode(text, add_special_tokens=False).ids
            decoded = BOTH["word"][0].decode(want, skip_special_tokens=False)
            assert tuple(r) == (r.doc_id, len(want), hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest(),
                                hashlib.sha256(decoded.encode()).hexdigest())
