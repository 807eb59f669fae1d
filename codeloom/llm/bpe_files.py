"""Merge tables of the public tokenizer files (JSON), and exact merging of one word."""

from __future__ import annotations

import heapq
import json
from functools import lru_cache


def byte_letters() -> dict[int, str]:
    """Byte-level alphabet: printable Latin-1 bytes stand for themselves, the others follow from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class BpeFile:
    """Vocabulary and merges of a byte-level BPE file, keyed by raw bytes.

    ``inner``: pieces that may stand anywhere but at a word's end; ``final``: pieces at the end
    (the same table where the file has no end-of-word suffix). ``ranks``: (left, right) ids to
    the rank of their merge; ``made``: rank to merged id. ``names``: id to the file's token string.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            self.spec = json.load(f)
        model = self.spec["model"]
        if model["type"] != "BPE" or model.get("byte_fallback") or model.get("dropout"):
            raise ValueError(f"{path}: not a plain byte-level BPE file")
        suffix = model.get("end_of_word_suffix") or ""
        vocab: dict[str, int] = model["vocab"]
        raw = {letter: bytes([b]) for b, letter in byte_letters().items()}
        self.inner: dict[bytes, int] = {}
        self.final: dict[bytes, int] = {}
        for token, number in vocab.items():
            ends = bool(suffix) and token.endswith(suffix) and len(token) > len(suffix)
            body = token.removesuffix(suffix) if ends else token
            (self.final if ends else self.inner)[b"".join(raw[c] for c in body)] = number
        if not suffix:
            self.final = self.inner
        self.ranks: dict[tuple[int, int], int] = {}
        self.made: list[int] = []
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[vocab[left], vocab[right]] = rank
            self.made.append(vocab[left + right])
        self.added = {t["content"]: t["id"] for t in self.spec["added_tokens"]}
        self.names = {n: t for t, n in vocab.items()} | {n: t for t, n in self.added.items()}
        self.longest = max(map(len, [*self.inner, *self.final]))

    def symbols(self, word: bytes) -> list[int]:
        """Ids of the single bytes of a word, the last one in its final form."""
        return [self.inner[word[i:i + 1]] for i in range(len(word) - 1)] + [self.final[word[-1:]]]


@lru_cache(maxsize=4)
def bpe_file(path: str) -> BpeFile:
    return BpeFile(path)


def merge_word(symbols: list[int], ranks: dict[tuple[int, int], int], made: list[int]) -> tuple[int, list[int]]:
    """Merge one word exactly; returns (number of merges, symbols with -1 where one was absorbed).

    A heap holds adjacent pairs as rank and position in one integer; neighbours form a linked list,
    so a word of n symbols takes O(n log n) steps however long it is. ``now`` holds the rank of the
    pair that starts at a position; heap entries that differ from it no longer stand.
    """
    n = len(symbols)
    if n < 2:
        return 0, symbols
    get, ids = ranks.get, list(symbols)
    now = [get(pair, -1) for pair in zip(ids, ids[1:])]
    now.append(-1)
    bits = n.bit_length()
    mask = (1 << bits) - 1
    heap = [(rank << bits) | i for i, rank in enumerate(now) if rank >= 0]
    if not heap:
        return 0, ids
    heapq.heapify(heap)
    pop, push = heapq.heappop, heapq.heappush
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    done = 0
    while heap:
        entry = pop(heap)
        i, rank = entry & mask, entry >> bits
        if now[i] != rank:
            continue
        j = after[i]
        merged = ids[i] = made[rank]
        ids[j] = now[j] = now[i] = -1
        done += 1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if (found := get((merged, ids[k]), -1)) >= 0:
                now[i] = found
                push(heap, (found << bits) | i)
        h = before[i]
        if h >= 0:
            found = now[h] = get((ids[h], merged), -1)
            if found >= 0:
                push(heap, (found << bits) | h)
    return done, ids
