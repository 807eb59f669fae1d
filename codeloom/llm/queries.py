"""Registers the queries of this folder: each module below adds its own."""

from codeloom.llm import classifier_queries, html_queries, language_queries, near_queries, personal_queries, phrase_queries, quality_queries, run_queries, tokenizer_queries, url_queries  # noqa: F401
from codeloom.llm.common import ORACLES, QUERIES  # noqa: F401
