"""Projects named in vulnerability descriptions."""

from __future__ import annotations

import re
import re._constants as C

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.text import path_basename
from codeloom.operators.containment import contained, occurring
from codeloom.session import staged

# Patterns that one row of a description tests; more make further rows.
BLOCK_PATTERNS = 500


def required_literal(pattern: str) -> tuple[str, bool]:
    """The longest text that each match of a pattern holds, and whether the pattern is that text and no more.

    Groups and repeated parts that must occur count, alternatives don't. Empty if the pattern requires
    none, or is written in a way that only Java reads.
    """
    try:
        tree = re._parser.parse(pattern)
    except (re.error, OverflowError):
        return "", False
    if "\\v" in pattern:  # a class in Java
        return "", False
    if tree.state.flags & re.IGNORECASE:
        return "", False
    runs = [""]

    def walk(items) -> bool:
        """Collect runs of literals; is all of it literal text?"""
        plain = True
        for op, value in items:
            if op is C.LITERAL:
                runs[-1] += chr(value)
            elif op is C.SUBPATTERN and not value[1] and not value[2]:
                plain &= walk(value[3])
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT) and value[0] > 0:
                runs.append("")
                walk(value[2])
                runs.append("")
                plain = False
            else:
                plain = False
                if op is not C.AT:
                    runs.append("")
        return plain

    plain = walk(tree)
    return max(runs, key=len), plain


def _indexed(texts: DataFrame, patterns: DataFrame, record_id: str) -> DataFrame:
    """The patterns ``(_name, _literal, _plain)`` that match a text: each text meets those whose literal it holds.

    A text is moved once for each block of the patterns that it meets, whatever the number of all patterns.
    """
    held = contained(texts, patterns.select("_literal").distinct(), record_id, "_text", "_literal")
    plain = held.select("_literal").distinct().join(patterns.filter("_plain"), "_literal").select("_name")
    met = held.join(patterns.filter("NOT _plain"), "_literal").withColumn("_block", F.floor(
        (F.row_number().over(Window.partitionBy(record_id, "_literal").orderBy("_name")) - 1) / BLOCK_PATTERNS))
    # A group is a block of each literal that the text holds, cut again to bounded lists.
    lists = met.groupBy(record_id, "_block", F.pmod(F.xxhash64("_literal"), F.lit(64)).alias("_part")).agg(
        F.collect_list("_name").alias("_patterns"))
    tested = lists.join(texts, record_id).select(F.explode(F.filter(
        "_patterns", lambda p: F.rlike("_text", p))).alias("_name")).distinct()
    return plain.unionByName(tested)


def projects_in_cve(records: DataFrame, projects: DataFrame, record_id: str = "cve_id",
                    description: str = "description", regex: bool = False) -> DataFrame:
    """(project, in_cve): does any description contain the project's base name, case aside?

    Names are literal text. With ``regex`` they are patterns. Most patterns require some text: descriptions
    that hold it are found as literal names are, and only they are tested. Blocks of the patterns
    that require none meet all descriptions.
    """
    names = projects.select("project").distinct().withColumn(
        "_name", F.lower(path_basename(F.col("project"))))
    texts = records.select(record_id, F.lower(description).alias("_text")).filter("_text is not null")
    if regex:
        shape = F.udf(required_literal, "struct<literal: string, plain: boolean>")
        patterns = staged(names.select("_name").distinct().filter("_name is not null").withColumn("_s", shape("_name")).select(
            "_name", F.col("_s.literal").alias("_literal"), F.col("_s.plain").alias("_plain")), "patterns")
        found = _indexed(texts, patterns.filter("_literal <> ''"), record_id)
        open_ones = patterns.filter("_literal = ''")
        n_blocks = -(-open_ones.count() // BLOCK_PATTERNS)
        if n_blocks:
            blocks = open_ones.groupBy(F.pmod(F.xxhash64("_name"), F.lit(n_blocks)).cast("int").alias("_block")).agg(
                F.collect_list("_name").alias("_patterns"))
            asked = texts.select("_text", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("_block"))
            found = found.unionByName(asked.join(blocks, "_block").select(F.explode(F.filter(
                "_patterns", lambda p: F.rlike("_text", p))).alias("_name")).distinct())
    else:
        found = occurring(texts, names, record_id, "_text", "_name")
    found = found.distinct().withColumn("_hit", F.lit(True))
    return names.join(found, "_name", "left").select(
        "project", F.coalesce("_hit", F.lit(False)).alias("in_cve"))
