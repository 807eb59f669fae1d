"""Quality rules (6): a threshold table compiled into one projection, without user functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import WHITE, free_name, let

SYMBOLS = "#*$%&|<>"

# Very frequent short words of four languages.
STOP_WORDS = tuple(
    "the of and to in is that it for was as with on by are this be at or an a "
    "de la le les et des du un une que est pour dans en il qui au par sur ne pas avec "
    "der die und das den von zu mit sich dem ein ist eine einer nicht auch auf im es "
    "el los las del se por con para su al lo como más sus no y o".split())


@dataclass(frozen=True)
class Rule:
    """``low <= 100 * part / whole <= high`` in percent; whole numbers, so all engines agree."""

    name: str
    part: str
    whole: str
    low: int | None = None
    high: int | None = None


# Set from the labelled documents: clean ones stay well inside, each kind of junk falls outside.
RULES = (
    Rule("mean_word_length", "word_chars", "n_words", low=200, high=1000),
    Rule("symbols_per_word", "n_symbols", "n_words", high=20),
    Rule("shouts_per_word", "n_shouts", "n_words", high=10),
    Rule("stop_words", "n_stop", "n_words", low=5),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", high=50),
    Rule("line_ends", "n_lines", "n_words", high=60),
)


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that a text holds twice or more. Sorting brings equal windows
    together, so no pairs are compared; texts without equal windows stop before the sort."""
    three = F.transform(F.sequence(F.lit(1), F.size(words) - 2), lambda i: F.concat_ws(
        " ", F.element_at(words, i), F.element_at(words, i + 1), F.element_at(words, i + 2)))

    def covered(s: Column) -> Column:
        same = lambda e, j: F.coalesce(F.get(s, j)["w"] == e["w"], F.lit(False))
        again = F.filter(s, lambda e, j: same(e, j - 1) | same(e, j + 1))
        return F.size(F.array_distinct(F.flatten(
            F.transform(again, lambda e: F.array(e["i"], e["i"] + 1, e["i"] + 2)))))

    found = let(three, lambda t: F.when(F.size(F.array_distinct(t)) == F.size(t), F.lit(0)).otherwise(
        let(F.sort_array(F.transform(t, lambda w, i: F.struct(w.alias("w"), i.alias("i")))), covered)))
    return F.when(F.size(words) < 3, F.lit(0)).otherwise(found)


def _without(text: Column, letters: str) -> Column:
    return F.translate(text, letters, "")


def measures(text: Column) -> Column:
    """A struct of counts (longs) of a text, null as empty, as one expression."""
    white = "[" + r"\x20\x09-\x0D" + "]"

    def counts(t: Column, words: Column, lines: Column) -> Column:
        stop = F.filter(words, lambda w: F.lower(_without(w, ".,;:!?")).isin(*STOP_WORDS))
        return F.struct(*[c.cast("long").alias(name) for name, c in {
            "n_words": F.size(words),
            "word_chars": F.length(_without(t, WHITE)),
            "n_symbols": F.length(t) - F.length(_without(t, SYMBOLS)),
            "n_shouts": F.length(t) - F.length(_without(t, "!")),
            "n_stop": F.size(stop),
            "n_lines": F.size(lines),
            "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
            "n_repeat_words": _repeat_words(words),
        }.items()])

    return let(F.coalesce(text, F.lit("")), lambda t: let(
        F.filter(F.split(t, white + "+"), lambda w: w != ""), lambda words: let(
            F.filter(F.split(t, "\n"), lambda x: F.length(_without(x, WHITE)) > 0),
            lambda lines: counts(t, words, lines))))


def failed_base(m: Column) -> Column:
    return (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])


def passes(m: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """True if a text's measures lie within all thresholds."""
    held = F.lit(True)
    for r in rules:
        if r.low is not None:
            held = held & (100 * m[r.part] >= r.low * m[r.whole])
        if r.high is not None:
            held = held & (100 * m[r.part] <= r.high * m[r.whole])
    return held


def judge(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, name: str = "quality") -> DataFrame:
    """``df`` with a struct column ``name``: all measures, ``base_failed`` and ``kept``.

    One projection, no shuffle and no user functions. Null and empty texts have no words and fail
    the base; repeated rows are judged alike; all columns of ``df`` stay, and a struct name that
    clashes is an error. ``kept`` is never null.
    """
    if name in df.columns:
        raise ValueError(f"column {name} is already there")
    whole = let(measures(F.col(text)), lambda m: F.struct(
        m.alias("measures"), failed_base(m).alias("base_failed"),
        (~failed_base(m) & passes(m, rules)).alias("kept")))
    return df.withColumn(name, whole)


def keep_good(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Rows of ``df`` whose text passes base and rules, with the columns of ``df``."""
    name = free_name(df, "quality")
    return judge(df, text, rules, name).filter(F.col(name)["kept"]).drop(name)


def rules_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """The table as a SQL condition."""
    parts = []
    for r in rules:
        if r.low is not None:
            parts.append(f"100 * {r.part} >= {r.low} * {r.whole}")
        if r.high is not None:
            parts.append(f"100 * {r.part} <= {r.high} * {r.whole}")
    return " AND ".join(parts)
