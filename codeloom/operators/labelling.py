"""Labels of functions by the findings of their file.

The findings of a file become one automaton over their contexts (Aho and Corasick, 1975), so a function is read
once whatever the number of findings. Files meet their findings by key; nothing is compared across files.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.operators.scale import bounded_parts
from codeloom.schemas import BENIGN

# What a task holds of a file at a time: functions of so many characters, and an automaton of so many findings.
PART_CHARS = 8 << 20
BLOCK_FINDINGS = 20_000
_OUT_CHARS = 16 << 20


def squeezed(text: str) -> str:
    return "".join(text.split())


class Matcher:
    """Findings (context, cwe), to be found in functions, white space aside."""

    def __init__(self, findings: Iterable[tuple[str | None, str | None]]) -> None:
        self.findings = list(findings)
        owners: dict[str, list[int]] = {}
        for i, (context, _) in enumerate(self.findings):
            if context is not None and len(context) > 1:  # shorter ones count as not found
                owners.setdefault(squeezed(context), []).append(i)
        self._blank = owners.pop("", [])  # white space occurs everywhere
        self._automaton = ahocorasick.Automaton()
        for norm, own in owners.items():
            self._automaton.add_word(norm, own)
        if owners:
            self._automaton.make_automaton()

    def hits(self, body: str) -> list[int]:
        """Positions of the findings that a squeezed function holds, in order."""
        found = set(self._blank)
        if len(self._automaton):
            for _, own in self._automaton.iter(body):
                found.update(own)
        return sorted(found)


def function_id(file: Column, code: Column) -> Column:
    return F.md5(F.concat_ws("\n", file, code))


def identified(functions: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """Distinct functions (file, code, *carry) with their id ``_fun``."""
    return functions.select("file", "code", *carry).withColumn(
        "_fun", function_id(F.col("file"), F.col("code"))).dropDuplicates(["_fun"])


def _labelled(schema: T.StructType, most: int):
    names = schema.fieldNames()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, functions, misses, block = None, [], [], []
        rows, held = [], 0

        def labels(last: bool) -> Iterator[tuple]:
            """Rows of the findings held; at the end of a group also those of functions that miss one."""
            if functions and block:
                matcher = Matcher(block)
                for i, (file, code, body, *kept) in enumerate(functions):
                    hits = matcher.hits(body)
                    misses[i] |= len(hits) < len(block)
                    for h in hits:
                        yield (file, code, *block[h], *kept)
            if last:
                for miss, (file, code, _, *kept) in zip(misses, functions):
                    if miss:
                        yield (file, code, "", BENIGN, *kept)

        for batch in batches:
            for file, part, kind, code, context, cwe, *kept in batch.itertuples(index=False, name=None):
                done = (file, part) != group
                if done or len(block) >= most:
                    for row in labels(done):
                        rows.append(row)
                        held += len(row[1])
                        if held > _OUT_CHARS:
                            yield pd.DataFrame(rows, columns=names)
                            rows, held = [], 0
                    block = []
                if done:
                    group, functions, misses = (file, part), [], []
                if kind == 0:
                    functions.append((file, code, squeezed(code), *kept))
                    misses.append(False)
                else:
                    block.append((context, cwe))
        rows += labels(True)
        if rows:
            yield pd.DataFrame(rows, columns=names)

    return run


def label_functions(functions: DataFrame, findings: DataFrame, carry: Sequence[str] = (),
                    part_chars: int = PART_CHARS, block: int = BLOCK_FINDINGS) -> DataFrame:
    """Label each function by the findings of its file: (file, code, context, cwe, *carry), distinct.

    A finding whose context occurs in the function, whitespace aside, gives its weakness; a function
    that misses any finding of its file also gets a ``Benign`` row. ``carry`` names function columns
    that the file determines. Functions may come with the ids of ``identified``; then they are taken
    to be distinct.

    Functions and findings are dealt and sorted by file. The functions of a file of more than
    ``part_chars`` characters are dealt to several tasks, each of which gets the file's findings. A task
    holds one such part and ``block`` findings at a time, so neither a file with very many functions nor one
    with very many findings is held whole, and no pair of function and finding is formed but those
    that are labels.
    """
    carry = list(carry)
    funs = functions if "_fun" in functions.columns else identified(functions, carry)
    funs = funs.filter(F.col("file").isNotNull() & F.col("code").isNotNull())
    found = findings.select("file", "context", "cwe").filter(F.col("file").isNotNull()).dropDuplicates()
    # Files of one part need no row here; the others are at most the text's size / part_chars.
    large = bounded_parts(funs, "file", F.length("code"), part_chars)
    parts = F.coalesce(F.col("parts").cast("int"), F.lit(1))
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("file", "code", "context", "cwe")])
    for c in carry:
        schema.add(funs.schema[c])
    text = F.lit(None).cast("string")
    dealt = funs.join(large, "file", "left").select(
        "file", F.pmod(F.xxhash64("_fun"), parts.cast("long")).cast("int").alias("_part"), F.lit(0).alias("_kind"), "code",
        text.alias("context"), text.alias("cwe"), *carry)
    asked = found.join(large, "file", "left").select(
        "file", F.explode(F.sequence(F.lit(0), parts - 1)).alias("_part"), F.lit(1).alias("_kind"),
        text.alias("code"), "context", "cwe", *[F.lit(None).cast(funs.schema[c].dataType).alias(c) for c in carry])
    met = dealt.unionByName(asked).repartition("file", "_part").sortWithinPartitions("file", "_part", "_kind")
    return met.mapInPandas(_labelled(schema, block), schema)
