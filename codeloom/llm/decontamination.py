"""Benchmark decontamination (10): size-partitioned MinHash containment search, verified exactly.

Items are partitioned by the size of their shingle set. From each item its partition's number k of
least hashed shingles (a bottom-k MinHash sketch) is kept, with k so large that a document holding
the wanted share of any item of that size must hold one of the k: a containment search that loses
nothing, however long the documents are. Documents probe all of their shingles; only those that some
item has leave the scan, and candidates from the sketches are verified by exact containment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.common import let
from codeloom.session import staged

SHINGLE = 5
SHARE = 80  # percent of an item's shingles
# A table of item shingles up to these bounds goes to every executor (some 100 MB); a larger one is joined by
# a shuffle. The plan differs in that hint only.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 50_000_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shingles(text: Column, n: int = SHINGLE) -> Column:
    """Distinct ``n``-word shingles of a text, A-Z lower-cased; none if it has fewer words or is null."""
    lowered = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    words = F.filter(F.split(lowered, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    runs = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.concat_ws(
        " ", *[F.element_at(w, i + j) for j in range(n)]))
    none = F.array().cast("array<string>")
    return let(words, lambda w: F.when(F.size(w) < n, none).otherwise(F.array_distinct(runs(w))))


def item_shingles(items: DataFrame, text: str = "text", key: str = "item_id") -> DataFrame:
    """Distinct rows ``(key, s)`` of the shingles of items; rows with equal keys are one item."""
    return items.filter(F.col(key).isNotNull()).select(
        F.col(key), F.explode(shingles(F.col(text))).alias("s")).distinct()


def sketched(sets: DataFrame, key: str, share: int = SHARE) -> DataFrame:
    """Rows ``(key, s, n_item)``: the sketches of the items of ``sets(key, s)``, and their sizes.

    Partitions are powers of two of the set size q. A document with ``share`` percent of an item
    lacks at most q - ceil(share q / 100) shingles, so one of any q - ceil(share q / 100) + 1 is
    there; k is that number for the largest item of the partition.
    """
    sizes = sets.groupBy(key).agg(F.count("*").alias("n_item")).withColumn("part", F.floor(F.log2("n_item")))
    largest = sizes.groupBy("part").agg(F.max("n_item").alias("q"))
    k = F.col("q") - F.ceil(F.col("q") * share / 100) + 1
    wanted = sizes.join(largest, "part").select(key, "n_item", k.alias("k"))
    order = Window.partitionBy(key).orderBy(F.xxhash64("s"), "s")
    return sets.join(wanted, key).withColumn("place", F.row_number().over(order)).filter("place <= k").select(
        key, "s", "n_item")


def _lookup(table: DataFrame, column: str) -> DataFrame:
    """``table`` marked for broadcast if its counted rows and bytes are within the bounds."""
    rows, size = table.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()
    return F.broadcast(table) if rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES else table


def find_leaks(documents: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id",
               item_text: str = "text", item_key: str = "item_id", share: int = SHARE) -> DataFrame:
    """Rows ``(key, item_key, n_shared, n_item, containment)``: documents with at least ``share``
    percent of the distinct five-word shingles of an item.

    Rows with equal keys are one document (or item). Null texts, null keys and texts under five
    words have no shingles: such documents are clean, such items are not searched. Empty tables
    give an empty result; other columns are not read. DataFrame functions only; long texts are
    searched whole; texts are scanned once and not shuffled, and what leaves the scan are shingles that some
    item has.
    """
    name, item = "__doc", "__item"
    sets = staged(item_shingles(items.select(F.col(item_key).alias(item), F.col(item_text).alias("text")), "text", item), "items")
    sketches = staged(sketched(sets, item, share), "sketches")
    hits = staged(
        documents.filter(F.col(key).isNotNull())
        .select(F.col(key).alias(name), F.explode(shingles(F.col(text))).alias("s"))
        .join(_lookup(sets.select("s").distinct(), "s"), "s").select(name, "s"), "hits").distinct()
    # Candidates share a sketch shingle. Each then asks for all shingles of its item; nothing else is counted.
    pairs = hits.join(sketches, "s").select(name, item, "n_item").distinct()
    asked = pairs.join(sets, item)
    found = asked.join(hits, [name, "s"]).groupBy(name, item, "n_item").agg(F.count("*").alias("n_shared"))
    return found.filter(F.col("n_shared") * 100 >= share * F.col("n_item")).select(
        F.col(name).alias(key), F.col(item).alias(item_key), "n_shared", "n_item",
        (F.col("n_shared") / F.col("n_item")).alias("containment"))


def remove_leaks(documents: DataFrame, items: DataFrame, **columns: str) -> DataFrame:
    """Documents without those that ``find_leaks`` reports; columns and clean rows stay as they are.

    Null texts, null keys and texts under five words stay; long texts are searched whole.
    """
    key = columns.get("key", "doc_id")
    leaked = staged(find_leaks(documents, items, **columns).select(key).distinct(), "leaked")
    return documents.join(leaked, key, "left_anti").select(*documents.columns)
