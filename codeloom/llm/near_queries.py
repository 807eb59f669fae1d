"""Queries of SimHash near-dedup (2) and substring dedup (4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import simhash, substrings
from codeloom.llm.common import query, table


@query("op2_simhash")
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, distance=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


_OP4_SQL = """
WITH docs AS (
    SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words
    FROM documents),
windows AS (
    SELECT doc_id, p, array_to_string(words[p:p + 49], ' ') AS body
    FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS p FROM docs)),
firsts AS (SELECT body, min(doc_id) AS first FROM windows GROUP BY body HAVING min(doc_id) < max(doc_id)),
gone AS (
    SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS i
    FROM windows JOIN firsts USING (body) WHERE doc_id > first),
placed AS (SELECT doc_id, unnest(words) AS w, unnest(range(1, len(words) + 1)) AS i FROM docs),
kept AS (
    SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS body, count(*) AS n
    FROM placed ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed,
    sha256(coalesce(body, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (doc_id)
"""


@query("op4_substrings", _OP4_SQL)
def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words that an earlier document has, taken out of all documents."""
    found = substrings.remove_repeats(table(spark, sf_dir, "documents"), window=50)
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
