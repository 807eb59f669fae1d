"""Queries of quality rules (6) and benchmark decontamination (10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import decontamination, quality_rules
from codeloom.llm.common import query, table

_STOP = ", ".join(f"'{w}'" for w in quality_rules.STOP_WORDS)

#: Measures of the table {source}(doc_id, text), for DuckDB.
MEASURES_SQL = """
texts AS (
    SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS row
    FROM {source}),
split AS (
    SELECT row, doc_id, t,
        list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
    FROM texts),
threes AS (
    SELECT row, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS w
    FROM (SELECT row, words, unnest(range(1, len(words) - 1)) AS i FROM split)),
again AS (SELECT row, i FROM threes QUALIFY count(*) OVER (PARTITION BY row, w) > 1),
repeats AS (
    SELECT row, count(DISTINCT i + k) AS n FROM again, (SELECT unnest([0, 1, 2]) AS k) GROUP BY row),
measured AS (
    SELECT row, doc_id, t, len(words)::BIGINT AS n_words,
        length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        (length(t) - length(replace(t, '!', '')))::BIGINT AS n_shouts,
        len(list_filter(words, lambda w: lower(regexp_replace(w, '[.,;:!?]', '', 'g')) IN ({stop})))::BIGINT AS n_stop,
        len(lines)::BIGINT AS n_lines,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
        coalesce(n, 0)::BIGINT AS n_repeat_words
    FROM split LEFT JOIN repeats USING (row)),
judged AS (
    SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {rules} AS good FROM measured)
""".replace("{stop}", _STOP).replace("{rules}", quality_rules.rules_sql())

_OP6_SQL = "WITH " + MEASURES_SQL.replace("{source}", "documents") + """
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND good AS kept
FROM judged
"""


@query("op6_quality_rules", _OP6_SQL)
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document."""
    judged = quality_rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged.select(
        "doc_id", *[F.col("quality")["measures"][c].alias(c) for c in counts],
        F.col("quality")["base_failed"].alias("base_failed"), F.col("quality")["kept"].alias("kept"))


#: Five-word shingles of {source}(key, text), for DuckDB.
SHINGLES_SQL = """
    SELECT DISTINCT key, array_to_string(w[i:i + 4], ' ') AS s
    FROM (SELECT key, w, unnest(range(1, len(w) - 3)) AS i
          FROM (SELECT key, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
              'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM {source}))
"""

LEAKS_SQL = """
doc_shingles AS (""" + SHINGLES_SQL.replace("{source}", "(SELECT doc_id AS key, text FROM {source})") + """),
item_shingles AS (""" + SHINGLES_SQL.replace("{source}", "(SELECT item_id AS key, text FROM benchmark)") + """),
leaks AS (
    SELECT d.key AS doc_id, i.key AS item_id, count(*) AS n_shared, any_value(n) AS n_item,
        count(*) / any_value(n) AS containment
    FROM doc_shingles d JOIN item_shingles i USING (s)
    JOIN (SELECT key, count(*) AS n FROM item_shingles GROUP BY key) sizes ON sizes.key = i.key
    GROUP BY d.key, i.key HAVING count(*) * 100 >= 80 * any_value(n))
"""

_OP10_SQL = "WITH " + LEAKS_SQL.replace("{source}", "documents") + "SELECT * FROM leaks"


@query("op10_decontamination", _OP10_SQL)
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items."""
    return decontamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
