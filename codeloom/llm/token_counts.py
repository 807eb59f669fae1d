"""Token counts (5): heap-and-linked-list byte-pair merging, counting merges instead of emitting ids."""

from __future__ import annotations

import re

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.bpe_files import bpe_file, merge_word
from codeloom.llm.common import fields, map_rows

# Fixed value: the pre-tokenizer pattern that "ByteLevel" with use_regex stands for in tokenizer files.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# Counts of at most this many different chunks are remembered in a Python worker, then forgotten.
MEMO_CHUNKS = 1_000_000

# Python's own \s also takes the separators \x1c-\x1f, which the pattern does not.
_ODD = re.compile("[\x1c-\x1f]")
_CHUNKS = r" ?\S+|\s+(?!\S)|\s"
_FAST, _EXACT = re.compile(_CHUNKS), regex.compile(_CHUNKS)


class TokenCounter:
    """Counts the tokens of texts. The pattern never joins characters across a chunk (one space at
    most, then non-space; or white space alone), so a chunk's count is computed once and remembered."""

    def __init__(self, path: str):
        self.file = bpe_file(path)
        self.pieces = regex.compile(BYTE_LEVEL_PATTERN)
        if self.file.spec["normalizer"] or self.file.spec["pre_tokenizer"]["type"] != "ByteLevel":
            raise ValueError(f"{path}: only byte-level files without normalizer")
        self.special = re.compile("|".join(map(re.escape, self.file.added)) or r"(?!)")
        self.memo: dict[str, int] = {}

    def of_chunk(self, chunk: str) -> int:
        total = 0
        for piece in self.pieces.findall(chunk):
            raw = piece.encode()
            if raw in self.file.inner and len(raw) == 1:
                total += 1
                continue
            symbols = self.file.symbols(raw)
            total += len(symbols) - merge_word(symbols, self.file.ranks, self.file.made)[0]
        return total

    def of_segment(self, text: str) -> int:
        memo, total = self.memo, 0
        chunks = (_EXACT if _ODD.search(text) else _FAST).findall(text)
        for chunk in chunks:
            count = memo.get(chunk)
            if count is None:
                if len(memo) >= MEMO_CHUNKS:
                    memo.clear()
                count = self.of_chunk(chunk)
                if len(chunk) <= 64:
                    memo[chunk] = count
            total += count
        return total

    def of_text(self, text: str | None) -> int:
        if not text:
            return 0
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self.of_segment, parts))


_counters: dict[str, TokenCounter] = {}


def counter(path: str) -> TokenCounter:
    """The worker's counter for a file; it outlives a task."""
    if path not in _counters:
        _counters[path] = TokenCounter(path)
    return _counters[path]


def count_tokens(df: DataFrame, path: str, text: str = "text", key: str = "doc_id",
                 limit: int = 512) -> DataFrame:
    """Rows ``(key, n_bytes, n_tokens, over_limit)``, one for each row of ``df``, in place.

    ``path`` names a byte-level BPE file that every node has. Every whole text is counted; special
    strings inside texts are one token. Null text counts as empty (0 bytes, 0 tokens); repeated
    rows and null keys give a row each; an empty table gives an empty result; other columns are
    not read. No shuffle.
    """
    kind = df.schema[key].dataType.simpleString()

    def kernel(keys: list, texts: list) -> list:
        one = counter(path)
        return [keys, [len(t.encode()) if t else 0 for t in texts], [one.of_text(t) for t in texts]]

    out = map_rows(df.select(key, text), kernel, fields(f"`{key}` {kind}, n_bytes long, n_tokens long"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
