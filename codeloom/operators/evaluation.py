"""Classifier quality as relations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.labels import threshold_scores
from codeloom.operators.scale import running_totals


def evaluate(df: DataFrame, truth: str, score: str, cut: float = 0.5) -> DataFrame:
    """One row: n, accuracy, precision, recall, log loss and exact AUC of binary scores; the AUC is
    null if there is one class only, and all but n are null or zero without rows.

    Rows are first counted per distinct score, so ranks are only taken over distinct scores.
    """
    y, pred = F.col(truth), threshold_scores(F.col(score), cut)
    p = F.least(F.greatest(F.col(score), F.lit(1e-7)), F.lit(1 - 1e-7))
    num = lambda c: F.sum(c.cast("int"))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn = num((y == 1) & (pred == 1)), num((y == 0) & (pred == 1)), num((y == 1) & (pred == 0))
    base = df.agg(
        F.count("*").alias("n"), F.try_divide(num(y == pred), F.count("*")).alias("accuracy"),
        share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"),
        F.avg(-F.when(y == 1, F.log(p)).otherwise(F.log(1 - p))).alias("loss"))
    by_score = df.groupBy(F.col(score).alias("_s")).agg(
        num(y == 1).alias("_pos"), num(y == 0).alias("_neg"))
    ranked = running_totals(by_score, [F.asc("_s")], {"_upto": "_neg"})
    # A positive wins against every negative below it, and half against those at its score.
    wins = F.sum(F.col("_pos") * (F.col("_upto") - F.col("_neg") / 2))
    auc = ranked.agg(F.struct(F.try_divide(wins, F.sum("_pos") * F.sum("_neg")).alias("v")).alias("a")).scalar()
    return base.withColumn("_a", auc).select("*", F.col("_a.v").alias("auc")).drop("_a")


def classification_report(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """(row, precision, recall, f1, support) per label, then accuracy, macro and weighted averages.

    Everything after the first aggregation works on at most labels x labels rows.
    """
    cells = df.groupBy(F.col(truth).alias("t"), F.col(pred).alias("p")).agg(F.count("*").alias("n"))
    sides = cells.select(
        F.explode(F.array(
            F.struct(F.col("t").cast("string").alias("label"), F.col("n").alias("actual"),
                     F.lit(0).cast("bigint").alias("predicted"),
                     F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("right")),
            F.struct(F.col("p").cast("string").alias("label"), F.lit(0).cast("bigint").alias("actual"),
                     F.col("n").alias("predicted"), F.lit(0).cast("bigint").alias("right")),
        )).alias("s")).select("s.*")
    totals = sides.groupBy("label").agg(
        F.sum("actual").alias("support"), F.sum("predicted").alias("predicted"),
        F.sum("right").alias("right"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    per_label = totals.select(
        F.col("label").alias("row"), ratio(F.col("right"), F.col("predicted")).alias("precision"),
        ratio(F.col("right"), F.col("support")).alias("recall"),
        ratio(2 * F.col("right"), F.col("support") + F.col("predicted")).alias("f1"),
        "support", "right")
    metrics = ["precision", "recall", "f1"]
    whole = F.sum("support")
    accuracy = (F.sum("right") / whole)
    summary = per_label.agg(F.array(
        F.struct(F.lit("accuracy").alias("row"), *[accuracy.alias(m) for m in metrics], whole.alias("support")),
        F.struct(F.lit("macro avg").alias("row"), *[F.avg(m).alias(m) for m in metrics], whole.alias("support")),
        F.struct(F.lit("weighted avg").alias("row"),
                 *[(F.sum(F.col(m) * F.col("support")) / whole).alias(m) for m in metrics],
                 whole.alias("support")),
    ).alias("rows"))
    return per_label.drop("right").unionByName(summary.select(F.inline("rows")))


def label_distribution(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """(label, actual, predicted) counts."""
    pair = F.explode(F.array(
        F.struct(F.col(truth).cast("string").alias("label"), F.lit(1).alias("a"), F.lit(0).alias("p")),
        F.struct(F.col(pred).cast("string").alias("label"), F.lit(0).alias("a"), F.lit(1).alias("p"))))
    return df.select(pair.alias("s")).groupBy("s.label").agg(
        F.sum("s.a").alias("actual"), F.sum("s.p").alias("predicted"))
