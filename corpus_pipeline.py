"""A training corpus from documents: quality, near copies, benchmark leaks, personal data, tokens.

Stages run one after the other; each works on all that the one before kept, which is written as
Parquet to the shared folder and read again. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import bpe, decontamination, personal_data, quality_rules, simhash
from codeloom.llm.common import free_name, table
from codeloom.session import staged

TOKENIZER = "word_bpe_49k.json"


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules. Null and empty texts fail; repeated rows are judged alike."""
    return quality_rules.keep_good(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of near copies by SimHash (three-word shingles, three bits).

    Null and empty texts are alike and so one group. Of rows with one id the one with the least hash
    of all columns stays; rows with a null id stay, as no group can name them. An empty table gives
    an empty one. Texts are moved once, to meet the ids that stay.
    """
    groups = staged(simhash.near_duplicates(docs.select("doc_id", "text"), shingle=3, distance=3), "groups")
    heads = groups.filter("doc_id = component_id").select("doc_id").distinct()
    pick = free_name(docs, "pick")
    rows = docs.withColumn(pick, F.xxhash64(*docs.columns))
    kept = staged(rows.select("doc_id", pick).join(heads, "doc_id", "left_semi").groupBy("doc_id").agg(
        F.min(pick).alias(pick)), "kept")
    named = rows.join(kept, ["doc_id", pick], "left_semi").dropDuplicates(["doc_id", pick])
    return named.select(*docs.columns).unionByName(docs.filter("doc_id IS NULL"))


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item: none with 80 % of an item's five-word shingles.

    Null, empty and short texts hold none and stay; rows of one id are one document and go or stay
    together; long texts are searched whole; an empty table gives an empty one.
    """
    return decontamination.remove_leaks(docs, table(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; ``n_chars`` follows the new text.

    Null texts stay null, with a null ``n_chars``; empty texts stay; repeated rows are redacted alike;
    long texts are read whole, window by window; an empty table gives an empty one.
    """
    found = personal_data.redact(docs, personal_data.train(docs))
    return found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def as_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's tokens: packed ids, their number, and digests of ids and decoded text.

    Null and empty texts have no tokens; repeated rows give a row each; long texts are coded whole;
    an empty table gives an empty result.
    """
    coded = bpe.encode(docs, public_tokenizers.path(TOKENIZER), decoded=True)
    return coded.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("quality_rules", good_quality),
    ("near_duplicates", one_of_each),
    ("decontamination", clean_of_benchmark),
    ("personal_data", without_personal_data),
    ("bpe", as_tokens),
]

# Fingerprints, the network and the merges are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
