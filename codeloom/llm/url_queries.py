"""Query of URL filters (8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codeloom.llm import url_models
from codeloom.llm.common import query, table
from codeloom.llm.url_models import BINS, N_LETTERS, STRENGTH, UNIT, UrlRule

RULES = (
    UrlRule("allow", "com", "/"),
    UrlRule("block", "example.com", "/en/"),
    UrlRule("allow", "www.example.com", "/en/"),
    UrlRule("block", "net", "/es/"),
    UrlRule("block", "net", "/fr/"),
)

_CASE_RULE = " ".join(
    f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{r.text}'"
    for r in sorted(RULES, key=lambda r: -len(r.text)))
_CASE_VERDICT = " ".join(f"WHEN rule = '{r.text}' THEN '{r.verdict}'" for r in RULES)


def _order_sql(order: int) -> str:
    own = f"own{order} AS (SELECT right(gram, {order}) AS gram, sum(a) AS a, sum(r) AS r FROM counts GROUP BY 1)"
    if order == 1:
        return own + f""",
order1 AS (SELECT gram, (a + 1) / ((SELECT sum(a) FROM counts) + {N_LETTERS}) AS pa,
    (r + 1) / ((SELECT sum(r) FROM counts) + {N_LETTERS}) AS pr FROM own1)"""
    return own + f""",
order{order} AS (
    SELECT o.gram, (a + {STRENGTH} * q.pa) / (ca + {STRENGTH}) AS pa, (r + {STRENGTH} * q.pr) / (cr + {STRENGTH}) AS pr
    FROM own{order} o JOIN (SELECT left(gram, {order - 1}) AS context, sum(a) AS ca, sum(r) AS cr FROM own{order}
                            GROUP BY 1) s ON s.context = left(o.gram, {order - 1})
    JOIN order{order - 1} q ON q.gram = right(o.gram, {order - 1}))"""


_OP8_SQL = """
WITH parts AS (
    SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*(/[^?#]*)', 1, 's') AS path
    FROM pages),
ruled AS (SELECT *, CASE """ + _CASE_RULE + """ END AS rule FROM parts),
rows AS (
    SELECT *, CASE """ + _CASE_VERDICT + """ END AS ruled,
        '^^^' || regexp_replace(translate(host || path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789',
            'abcdefghijklmnopqrstuvwxyz000000000'), '[^a-z0./\\-_~%:@]', '?', 'g') AS padded
    FROM ruled),
texts AS (SELECT padded, bool_or(ruled = 'allow') AS a, bool_or(ruled = 'block') AS r FROM rows GROUP BY padded),
labelled AS (
    SELECT padded, TRUE AS ok FROM texts WHERE a UNION ALL SELECT padded, FALSE FROM texts WHERE r),
places AS (SELECT padded, substring(padded, i, 4) AS gram
    FROM (SELECT padded, unnest(range(1, length(padded) - 2)) AS i FROM texts)),
counts AS MATERIALIZED (
    SELECT gram, count(*) FILTER (ok) AS a, count(*) FILTER (NOT ok) AS r
    FROM places JOIN labelled USING (padded) GROUP BY gram),
""" + ",\n".join(map(_order_sql, range(1, 5))) + """,
model AS MATERIALIZED (
    SELECT gram, round({unit} * (ln(pa) - ln(pr)))::BIGINT AS score FROM (
        SELECT * FROM order1 UNION ALL SELECT * FROM order2 UNION ALL SELECT * FROM order3 UNION ALL SELECT * FROM order4)),
totals AS MATERIALIZED (
    SELECT padded, sum(coalesce(m4.score, m3.score, m2.score, m1.score, 0))::BIGINT AS total, count(*) AS n
    FROM places p LEFT JOIN model m4 ON m4.gram = p.gram LEFT JOIN model m3 ON m3.gram = right(p.gram, 3)
    LEFT JOIN model m2 ON m2.gram = right(p.gram, 2) LEFT JOIN model m1 ON m1.gram = right(p.gram, 1) GROUP BY padded),
bins AS (
    SELECT greatest(-{bins}, least({bins}, floor(total / n / {cent})::INT)) AS bin, ok
    FROM labelled JOIN totals USING (padded)),
gains AS (
    SELECT b, (SELECT count(*) FROM bins WHERE ok AND bin >= b) * (SELECT count(*) FROM bins WHERE NOT ok)
        + (SELECT count(*) FROM bins WHERE NOT ok AND bin < b) * (SELECT count(*) FROM bins WHERE ok) AS gain
    FROM (SELECT unnest(range(-{bins}, {bins} + 1)) AS b)),
best AS (
    SELECT CASE WHEN (SELECT count(*) FROM bins WHERE ok) > 0 AND (SELECT count(*) FROM bins WHERE NOT ok) > 0
        THEN (SELECT floor((min(b) + max(b)) / 2)::BIGINT FROM gains WHERE gain = (SELECT max(gain) FROM gains)) END AS least)
SELECT page_id, host, path, rule,
    coalesce(ruled, CASE WHEN coalesce(total >= least * {cent} * n, TRUE) THEN 'allow' ELSE 'block' END) AS verdict,
    total / n / {unit} AS score
FROM rows LEFT JOIN totals USING (padded), best
""".replace("{unit}", str(UNIT)).replace("{cent}", str(UNIT // 100)).replace("{bins}", str(BINS))


@query("op8_url_filters", _OP8_SQL)
def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL."""
    return url_models.judge(table(spark, sf_dir, "pages"), RULES)
