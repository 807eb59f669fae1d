"""URL filters (8): rules, and for other URLs a ratio of two character language models.

Variable-order Markov models of accepted and rejected URLs are learnt from the URLs that the rules
decide. A character's probability is smoothed with those of shorter contexts; the longest context
that was seen with the character scores it. The mean log-likelihood difference per character is
held against a limit calibrated on the same URLs. DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import let
from codeloom.session import staged

# The letters of the models. Digits count as 0, all others as "?", a start as "^".
LETTERS = "abcdefghijklmnopqrstuvwxyz0./-_~%:@"
N_LETTERS = len(LETTERS) + 2
# A gram is a letter and up to three before it, so a model has at most 37 + 37**2 + 37**3 + 37**4 rows, however
# many URLs it is learnt from: the proven bound of what is broadcast.
ORDER = 4
STRENGTH = 5  # of the shorter context, in characters
UNIT = 1_000_000  # scores are whole millionths, so sums don't depend on their order
BINS = 400  # of the calibration on each side of zero, a hundredth wide

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased; else empty."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty. Only the first ``://`` counts."""
    whole = F.coalesce(url, F.lit(""))
    at = F.locate("://", whole)
    rest = F.when(at > 0, F.substring(whole, at + 3, F.length(whole))).otherwise(F.lit(""))
    return F.regexp_extract(rest, r"(?s)^[^/?#]*(/[^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: Sequence[UrlRule]) -> Column:
    """Text of the longest rule that fits, else null."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.text)):
        of_host = (host == rule.host) | F.endswith(host, F.lit("." + rule.host))
        found = F.when(of_host & F.startswith(path, F.lit(rule.path)), F.lit(rule.text)).otherwise(found)
    return found


def letters(host: Column, path: Column) -> Column:
    text = F.regexp_replace(F.translate(F.concat(host, path), _UPPER + "123456789", _LOWER + "0" * 9),
                            "[^a-z0./\\-_~%:@]", "?")
    return F.concat(F.lit("^" * (ORDER - 1)), text)


def grams(padded: Column) -> Column:
    """The gram of full order at each position of a padded text."""
    chars = F.filter(F.split(padded, ""), lambda c: c != "")
    at = lambda c: F.transform(F.sequence(F.lit(ORDER), F.size(c)), lambda i: F.concat(
        *[F.element_at(c, i - j) for j in reversed(range(ORDER))]))
    return let(chars, lambda c: F.when(F.size(c) < ORDER, F.array().cast("array<string>")).otherwise(at(c)))


def model(labelled: DataFrame) -> DataFrame:
    """Rows ``(gram, score)`` of all orders from ``labelled(padded, accepted)``.

    ``score`` is the difference of the smoothed log-likelihoods of the gram's last letter after the
    letters before it, accepted less rejected, in millionths.
    """
    counts = staged(
        labelled.select("accepted", F.explode(grams(F.col("padded"))).alias("gram"))
        .groupBy("gram").agg(F.count_if(F.col("accepted")).alias("a"), F.count_if(~F.col("accepted")).alias("r")),
        "grams")
    base = counts.agg(F.sum("a").alias("ca"), F.sum("r").alias("cr"))
    scored, shorter = None, None
    for order in range(1, ORDER + 1):
        own = counts.groupBy(F.right("gram", F.lit(order)).alias("gram")).agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
        if order == 1:
            now = own.select(
                "gram",
                ((F.col("a") + 1) / (base.select("ca").scalar() + N_LETTERS)).alias("pa"),
                ((F.col("r") + 1) / (base.select("cr").scalar() + N_LETTERS)).alias("pr"))
        else:
            context = F.left("gram", F.lit(order - 1))
            sums = own.groupBy(context.alias("context")).agg(F.sum("a").alias("ca"), F.sum("r").alias("cr"))
            before = shorter.select(F.col("gram").alias("tail"), F.col("pa").alias("qa"), F.col("pr").alias("qr"))
            now = (
                own.withColumn("context", context).withColumn("tail", F.right("gram", F.lit(order - 1)))
                .join(sums, "context").join(before, "tail")
                .select("gram", ((F.col("a") + STRENGTH * F.col("qa")) / (F.col("ca") + STRENGTH)).alias("pa"),
                        ((F.col("r") + STRENGTH * F.col("qr")) / (F.col("cr") + STRENGTH)).alias("pr")))
        shorter = now = staged(now, f"order{order}")
        scored = now if scored is None else scored.unionByName(now)
    return staged(scored.select("gram", F.round(UNIT * (F.ln("pa") - F.ln("pr"))).cast("long").alias("score")), "model")


def score(df: DataFrame, scores: DataFrame, padded: str, key: str) -> DataFrame:
    """Rows ``(key, total, n)``: summed score and number of letters of each row of ``df`` that has any."""
    out = df.select(key, F.explode(grams(F.col(padded))).alias("gram"))
    found = F.lit(0).cast("long")
    for order in range(1, ORDER + 1):
        part = scores.filter(F.length("gram") == order).select(
            F.col("gram").alias(f"g{order}"), F.col("score").alias(f"s{order}"))
        out = out.withColumn(f"g{order}", F.right("gram", F.lit(order))).join(F.broadcast(part), f"g{order}", "left")
        found = F.coalesce(f"s{order}", found)
    return out.groupBy(key).agg(F.sum(found).alias("total"), F.count("*").alias("n"))


def limit(judged: DataFrame) -> DataFrame:
    """One row ``(bin)``: the middle of the bins that best part accepted from rejected rows of
    ``judged(total, n, accepted)``; null if a class is missing. At most 801 bins are compared."""
    at = F.greatest(F.lit(-BINS), F.least(F.lit(BINS), F.floor(F.col("total") / F.col("n") / (UNIT // 100)))).cast("int")
    bins = judged.groupBy(at.alias("bin")).agg(
        F.count_if(F.col("accepted")).alias("a"), F.count_if(~F.col("accepted")).alias("r"))
    filled = judged.sparkSession.range(-BINS, BINS + 1).select(F.col("id").cast("int").alias("bin")).join(bins, "bin", "left")
    rows = F.sort_array(F.collect_list(F.struct(
        "bin", F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("r", F.lit(0)).alias("r"))))
    whole = filled.agg(rows.alias("rows"), F.sum("a").alias("all_a"), F.sum("r").alias("all_r"))
    # Accepted at or above the bin, and rejected below it, as whole products.
    gains = F.transform("rows", lambda x: F.struct(
        (F.aggregate(F.filter("rows", lambda y: y["bin"] >= x["bin"]), F.lit(0).cast("long"), lambda s, y: s + y["a"])
         * F.col("all_r") + F.aggregate(F.filter("rows", lambda y: y["bin"] < x["bin"]), F.lit(0).cast("long"),
                                        lambda s, y: s + y["r"]) * F.col("all_a")).alias("gain"),
        x["bin"].alias("bin")))
    top = let(gains, lambda g: let(F.filter(g, lambda y: y["gain"] == F.array_max(g)["gain"]), lambda t: F.floor(
        (F.array_max(t["bin"]) + F.array_min(t["bin"])) / 2)))
    best = F.when((F.col("all_a") > 0) & (F.col("all_r") > 0), top)
    return whole.select(best.alias("bin"))


def judge(pages: DataFrame, rules: Sequence[UrlRule], url: str = "url", key: str = "page_id") -> DataFrame:
    """Rows ``(key, host, path, rule, verdict, score)``, one for each row of ``pages``.

    ``verdict`` is the longest fitting rule's, else that of the models: ``allow`` at or above the
    calibrated limit. ``score`` is the mean log-likelihood difference per letter (null without
    letters). URLs without host and path, and all URLs if the rules accepted or rejected none,
    are allowed when no rule fits. Null URLs have empty host and path; repeated rows and null keys
    give a row each; an empty table gives an empty result; other columns are not read.

    Scoring broadcasts the models, whose rows are bounded by the alphabet, and shuffles one row
    of sums for each different URL text; equal texts are scored once.
    """
    host, path = host_of(F.col(url)), path_of(F.col(url))
    rows = pages.select(key, host.alias("host"), path.alias("path")).withColumn(
        "rule", matching_rule(F.col("host"), F.col("path"), rules)).withColumn(
        "padded", letters(F.col("host"), F.col("path")))
    verdicts = F.lit(None).cast("string")
    for rule in rules:
        verdicts = F.when(F.col("rule") == rule.text, F.lit(rule.verdict)).otherwise(verdicts)
    rows = rows.withColumn("ruled", verdicts)
    texts = staged(
        rows.groupBy("padded").agg(F.count_if(F.col("ruled") == "allow").alias("a"),
                                   F.count_if(F.col("ruled") == "block").alias("r")), "texts")
    labelled = texts.select("padded", F.explode(F.expr(
        "filter(array(named_struct('ok', true, 'n', a), named_struct('ok', false, 'n', r)), x -> x.n > 0)")).alias("x"))
    scores = model(labelled.select("padded", F.col("x.ok").alias("accepted")))
    totals = staged(score(texts, scores, "padded", "padded"), "totals")
    best = limit(labelled.join(totals, "padded").select("total", "n", F.col("x.ok").alias("accepted")))
    judged = rows.join(totals, "padded", "left").withColumn("least", best.scalar())
    passed = F.coalesce(F.col("total") >= F.col("least").cast("long") * (UNIT // 100) * F.col("n"), F.lit(True))
    return judged.select(
        key, "host", "path", "rule",
        F.coalesce("ruled", F.when(passed, F.lit("allow")).otherwise(F.lit("block"))).alias("verdict"),
        (F.col("total") / F.col("n") / UNIT).alias("score"))
