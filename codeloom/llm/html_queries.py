"""Query of HTML extraction (12)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import html_text
from codeloom.llm.common import query, table

# States the result for pages whose article is marked as such and holds paragraphs only, as here.
_OP12_SQL = r"""
WITH articles AS (
    SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(</article>|$)', 1) AS body FROM pages),
blocks AS (
    SELECT page_id, url, list_transform(regexp_split_to_array(body, '</?(?:p|h[1-6])>'), lambda b: trim(regexp_replace(
        regexp_replace(regexp_replace(regexp_replace(regexp_replace(b, '<br>', ' ', 'g'), '<[^>]*>', '', 'g'),
            '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) AS found
    FROM articles),
texts AS (
    SELECT page_id, url, coalesce(array_to_string(list_filter(found, lambda b: b <> ''), chr(10)), '') AS text FROM blocks)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM texts
"""


@query("op12_html_text", _OP12_SQL)
def op12_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages, site templates counted over all pages of each host."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_text.extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
