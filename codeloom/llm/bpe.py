"""BPE encoding and decoding (1): speculate with greedy longest match, verify pairs, merge the rest.

For each distinct word a greedy longest match proposes tokens. A proposal is the BPE encoding
exactly if every adjacent pair of it is what BPE gives for that pair's own text; numpy tests all
pairs of all new words at once. Only words with a failing pair are merged exactly.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import regex
import tokenizers
from pyspark.sql import DataFrame

from codeloom.llm.bpe_files import bpe_file, merge_word
from codeloom.llm.common import fields, map_rows

# Encodings of at most this many different chunks are remembered in a Python worker, then forgotten.
MEMO_CHUNKS = 800_000
_FAR = np.int64(1) << 40
_ODD = re.compile("[\x1c-\x1f]")
_WHITE = regex.compile(r"\s+")
# Up to here Unicode is settled; beyond, letter classes and case follow the tables of the library.
_NEWER = re.compile("[^\x00-\u024f]")


class PairTest:
    """Vectorised test of adjacent token pairs against the merge order."""

    def __init__(self, ranks: dict[tuple[int, int], int], made: list[int], n_ids: int):
        self.rank = np.full(n_ids, -1, np.int64)  # of the merge that makes a token; -1: a single byte
        self.left = np.zeros(n_ids, np.int64)
        self.right = np.zeros(n_ids, np.int64)
        for (a, b), rank in ranks.items():
            merged = made[rank]
            self.rank[merged], self.left[merged], self.right[merged] = rank, a, b
        keys = np.array([(a << 32) | b for a, b in ranks], np.int64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.ranks = np.array(list(ranks.values()), np.int64)[order]

    def cross(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(a), _FAR)
        key = (a << 32) | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _FAR)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """True where BPE keeps the border between tokens ``a`` and ``b``.

        The merges of both sides are undone, latest first. Before each one the two pieces at the
        border existed side by side; had their own merge come earlier, BPE would have joined them.
        Of equal ranks the one further left comes first.
        """
        good = np.ones(len(a), bool)
        at = np.arange(len(a))
        a, b, limit = a.copy(), b.copy(), np.full(len(a), _FAR)
        while len(at):
            joined = self.cross(a, b) < limit
            good[at[joined]] = False
            ra, rb = self.rank[a], self.rank[b]
            on = ~joined & ((ra >= 0) | (rb >= 0))
            at, a, b, ra, rb = at[on], a[on], b[on], ra[on], rb[on]
            of_left = ra > rb
            limit = np.where(of_left, ra, rb + 1)
            a, b = np.where(of_left, self.right[a], a), np.where(of_left, b, self.left[b])
        return good


class BpeCodec:
    """Encoder and decoder for files with a normalizer list, a split pattern and word ends."""

    def __init__(self, path: str):
        self.file = bpe_file(path)
        spec = self.file.spec
        self.steps = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        if unknown := set(self.steps) - {"NFC", "Replace", "Lowercase"}:
            raise ValueError(f"{path}: normalizers {unknown}")
        for step in (spec["normalizer"] or {}).get("normalizers", []):
            if step["type"] == "Replace" and (step["pattern"], step["content"]) != ({"Regex": r"\s+"}, " "):
                raise ValueError(f"{path}: a normalizer that replaces {step['pattern']}")  # white space splits words anyhow
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        if split["type"] != "Split" or split["behavior"] != "Removed" or not split["invert"] or spec["decoder"]:
            raise ValueError(f"{path}: only files that split into words, without a decoder")
        self.pieces = regex.compile(split["pattern"]["Regex"])
        self.newer = tokenizers.pre_tokenizers.Split(
            tokenizers.Regex(split["pattern"]["Regex"]), "removed", invert=True)
        self.special = re.compile("(" + "|".join(map(re.escape, self.file.added)) + ")") if self.file.added else None
        self.pairs = PairTest(self.file.ranks, self.file.made, max(self.file.names) + 1)
        # A token that merging its own bytes does not give can't be proposed.
        self.inner, self.final = (
            {raw: n for raw, n in pieces.items() if self.exact(raw, last) == [n]}
            for pieces, last in ((self.file.inner, False), (self.file.final, True)))
        # Longest inner piece for each first two bytes: the greedy match starts there.
        self.reach: dict[bytes, int] = {}
        for raw in self.inner:
            self.reach[raw[:2]] = max(self.reach.get(raw[:2], 1), len(raw))
        self.names = self.file.names
        self.memo: dict[str, bytes] = {}
        self.merged_words = 0

    def exact(self, word: bytes, last: bool = True) -> list[int]:
        symbols = self.file.symbols(word)
        if not last:
            symbols[-1] = self.file.inner[word[-1:]]
        return [i for i in merge_word(symbols, self.file.ranks, self.file.made)[1] if i >= 0]

    def proposal(self, word: bytes) -> list[int]:
        """Greedy longest match from the left."""
        inner, final, longest, reach = self.inner, self.final, self.file.longest, self.reach
        out, at, n = [], 0, len(word)
        while True:
            rest = n - at
            if rest <= longest and (token := final.get(word[at:])) is not None:
                out.append(token)
                return out
            for size in range(min(reach.get(word[at:at + 2], 1), rest - 1), 0, -1):
                if (token := inner.get(word[at:at + size])) is not None:
                    break
            out.append(token)
            at += size

    def words(self, words: list[bytes]) -> list[list[int]]:
        """Encodings of words: proposals where all pairs hold, exact merging elsewhere."""
        out = [self.proposal(w) for w in words]
        sizes = np.fromiter(map(len, out), np.int64, len(out))
        flat = np.fromiter((t for tokens in out for t in tokens), np.int64, int(sizes.sum()))
        of = np.repeat(np.arange(len(out)), sizes)
        inside = of[1:] == of[:-1]
        a, b, of = flat[:-1][inside], flat[1:][inside], of[1:][inside]
        for i in np.unique(of[~self.pairs(a, b)]).tolist():
            out[i] = self.exact(words[i])
            self.merged_words += 1
        return out

    def normal(self, text: str) -> str:
        for step in self.steps:
            if step == "NFC" and not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            elif step == "Lowercase":  # letter by letter: no final form of sigma
                text = tokenizers.normalizers.Lowercase().normalize_str(text) if _NEWER.search(text) else text.lower()
        return text

    def split(self, chunk: str) -> list[str]:
        if _NEWER.search(chunk):
            return [p for p, _ in self.newer.pre_tokenize_str(chunk)]
        return self.pieces.findall(chunk)

    def _learn(self, chunks: list[str]) -> dict[str, bytes]:
        """Packed ids of new chunks."""
        found = [[p.encode() for p in self.split(c)] for c in chunks]
        distinct = list({p for pieces in found for p in pieces})
        ids = dict(zip(distinct, self.words(distinct)))
        return {c: np.array([t for p in pieces for t in ids[p]], "<u4").tobytes()
                for c, pieces in zip(chunks, found)}

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text, packed as little-endian unsigned 32-bit integers."""
        split = []  # for each text: packed special tokens and lists of chunks
        for text in texts:
            parts: list = []
            for part in (self.special.split(text) if self.special else [text]) if text else []:
                if part in self.file.added:
                    parts.append(np.array([self.file.added[part]], "<u4").tobytes())
                elif part:
                    part = self.normal(part)
                    parts.append(_WHITE.split(part) if _ODD.search(part) else part.split())
            split.append(parts)
        new = {c for parts in split for p in parts if isinstance(p, list) for c in p}.difference(self.memo)
        if len(self.memo) + len(new) > MEMO_CHUNKS:
            self.memo.clear()
            new = {c for parts in split for p in parts if isinstance(p, list) for c in p}
        self.memo.update(self._learn(list(new)))
        get = self.memo.__getitem__
        out = [b"".join([p if isinstance(p, bytes) else b"".join(map(get, p)) for p in parts]) for parts in split]
        if len(self.memo) > MEMO_CHUNKS or any(len(c) > 256 for c in new):
            self.memo.clear()
        return out

    def decode(self, packed: bytes) -> str:
        """Token strings joined by a space: what a file without a decoder gives."""
        return " ".join(map(self.names.__getitem__, np.frombuffer(packed, "<u4").tolist()))


_codecs: dict[str, BpeCodec] = {}


def codec(path: str) -> BpeCodec:
    """The worker's codec for a file; it outlives a task."""
    if path not in _codecs:
        _codecs[path] = BpeCodec(path)
    return _codecs[path]


def encode(df: DataFrame, path: str, text: str = "text", key: str = "doc_id", decoded: bool = False) -> DataFrame:
    """Rows ``(key, n_tokens, ids[, decoded])``, one for each row of ``df``, in place.

    ``ids`` are packed as little-endian unsigned 32-bit integers; ``decoded`` adds their decoding.
    ``path`` names a BPE file that every node has. Every whole text is encoded; special strings
    inside texts become their special token. Null text counts as empty (no ids, empty decoding);
    repeated rows and null keys give a row each; an empty table gives an empty result; other
    columns are not read. No shuffle.
    """
    kind = df.schema[key].dataType.simpleString()

    def kernel(keys: list, texts: list) -> list:
        one = codec(path)
        ids = one.encode(texts)
        out = [keys, [len(i) // 4 for i in ids], ids]
        return [*out, list(map(one.decode, ids))] if decoded else out

    more = ", decoded string" if decoded else ""
    return map_rows(df.select(key, text), kernel, fields(f"`{key}` {kind}, n_tokens long, ids binary{more}"))


def decode(df: DataFrame, path: str, ids: str = "ids", key: str = "doc_id") -> DataFrame:
    """Rows ``(key, decoded)`` from packed ids; null ids decode to null."""
    kind = df.schema[key].dataType.simpleString()

    def kernel(keys: list, packed: list) -> list:
        one = codec(path)
        return [keys, [None if p is None else one.decode(p) for p in packed]]

    return map_rows(df.select(key, ids), kernel, fields(f"`{key}` {kind}, decoded string"))
