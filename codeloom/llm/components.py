"""Connected components of a link table, by alternating star contractions with reliable checkpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.session import staged

# Alternation ends in O(log^2 n) rounds; this only stops a loop that a defect would make endless.
MAX_ROUNDS = 100


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction. Each node's least neighbour (itself included) becomes the neighbour of its
    larger neighbours (``large``), or of its smaller ones and of itself."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        both = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    linked = both.join(least, "u")
    if large:
        out = linked.filter(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = linked.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(
            least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """Rows ``(node, root)`` for every node of ``links(a, b)``; ``root`` is the least node reachable.

    Each round is two joins on the node with map-side combined minima, so a node with very many
    links needs no task to hold them; adaptive execution splits it. Rounds are written to the
    shared folder, which cuts the lineage and outlives executors. The end is found from a count
    and a sum of hashes, not from the links themselves.
    """
    edges, before = staged(links.filter("a <> b").distinct(), "links"), None
    for _ in range(MAX_ROUNDS):
        edges = staged(_star(_star(edges, True), False), "stars")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    members = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return members.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
