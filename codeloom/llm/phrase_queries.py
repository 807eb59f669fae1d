"""Query of phrase collocation mining (11)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codeloom.llm import collocations
from codeloom.llm.common import query, table

_OP11_SQL = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents),
worded AS (
    SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS words FROM pieces),
totals AS (SELECT lang, sum(len(words))::BIGINT AS n FROM worded GROUP BY lang),
spans AS (
    SELECT lang, k, unnest(list_transform(range(1, len(words) - k + 2), lambda i: array_to_string(words[i:i + k - 1], ' '))) AS phrase
    FROM worded, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(words) >= k),
counts AS (SELECT lang, k, phrase, count(*)::BIGINT AS f FROM spans GROUP BY ALL HAVING count(*) >= 30),
candidates AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS words FROM counts WHERE k > 1),
cuts AS (
    SELECT lang, phrase, a, unnest(range(1, k)) AS cut, words FROM candidates),
scored AS (
    SELECT c.lang, c.phrase, a, cut, x.f AS l, y.f AS r, (2000000::HUGEINT * a) // (x.f::HUGEINT + y.f) AS score
    FROM cuts c JOIN counts x ON x.lang = c.lang AND x.phrase = array_to_string(words[1:cut], ' ')
    JOIN counts y ON y.lang = c.lang AND y.phrase = array_to_string(words[cut + 1:], ' ')),
best AS (
    SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inside AS (
    SELECT c.lang, c.a AS longer, array_to_string(words[i:i + m - 1], ' ') AS phrase
    FROM candidates c, (SELECT unnest([2, 3]) AS m), (SELECT unnest([1, 2, 3]) AS i) WHERE m < k AND i + m - 1 <= k),
around AS (SELECT lang, phrase, max(longer) AS longer FROM inside GROUP BY ALL),
kept AS (
    SELECT b.* FROM best b LEFT JOIN around o ON o.lang = b.lang AND o.phrase = b.phrase
    WHERE o.longer IS NULL OR 100::HUGEINT * o.longer < 80::HUGEINT * b.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM kept JOIN totals USING (lang) QUALIFY rank <= 2000
"""


@query("op11_collocations", _OP11_SQL)
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 best collocations of each language, from the counts of all documents."""
    return collocations.collocations(table(spark, sf_dir, "documents"), support=30, share=80, limit=2000)
