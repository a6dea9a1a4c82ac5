"""Evaluation of any table with a true and a predicted label.

Every metric derives from the long confusion table (one row per occurring label pair), so the
predictions are read and shuffled once, by partial counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def pair_counts(pred: DataFrame, true: str = "true_label", guess: str = "predicted_label") -> DataFrame:
    return pred.groupBy(F.col(true).alias("t"), F.col(guess).alias("p")).agg(F.count("*").alias("n"))


def confusion(
    pred: DataFrame, labels: list[str], true: str = "true_label", guess: str = "predicted_label"
) -> DataFrame:
    """Labels by labels, zeros kept: column ``label`` and one column per predicted label."""
    known = pred.where(F.col(true).isin(labels) & F.col(guess).isin(labels))
    counted = known.groupBy(F.col(true).alias("label")).pivot(guess, labels).count()
    spine = pred.sparkSession.createDataFrame([(x,) for x in labels], "label string")
    return spine.join(counted, "label", "left").na.fill(0).orderBy("label")


def accuracy(pred: DataFrame, true: str = "true_label", guess: str = "predicted_label") -> DataFrame:
    hit = (F.col(true) == F.col(guess)).cast("int")
    return pred.agg(F.avg(hit).alias("accuracy"))


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def per_class(
    pred: DataFrame,
    true: str = "true_label",
    guess: str = "predicted_label",
    labels: list[str] | None = None,
) -> DataFrame:
    """``langue, precision, recall, f1, support``; a zero denominator gives 0.

    Without ``labels``, every label that occurs as true or predicted is reported.
    """
    pairs = pair_counts(pred, true, guess)
    hit = F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0)
    # each pair contributes to its true and to its predicted class
    sides = pairs.select(
        F.inline(
            F.array(
                F.struct(F.col("t").alias("langue"), hit.alias("tp"), F.col("n").alias("actual"), F.lit(0).cast("long").alias("guessed")),
                F.struct(F.col("p").alias("langue"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("actual"), F.col("n").alias("guessed")),
            )
        )
    )
    sums = sides.groupBy("langue").agg(
        F.sum("tp").alias("tp"), F.sum("actual").alias("support"), F.sum("guessed").alias("guessed")
    )
    if labels is not None:
        spine = pred.sparkSession.createDataFrame([(x,) for x in labels], "langue string")
        sums = spine.join(sums, "langue", "left").na.fill(0)
    tp, support, guessed = F.col("tp"), F.col("support"), F.col("guessed")
    return sums.select(
        "langue",
        _ratio(tp, guessed).alias("precision"),
        _ratio(tp, support).alias("recall"),
        _ratio(2 * tp, support + guessed).alias("f1"),
        "support",
    )


def macro(classes: DataFrame) -> DataFrame:
    """One row of unweighted means, plus the total support."""
    return classes.agg(
        F.avg("precision").alias("precision"),
        F.avg("recall").alias("recall"),
        F.avg("f1").alias("f1"),
        F.sum("support").alias("support"),
    )


def weighted(classes: DataFrame) -> DataFrame:
    """One row of support-weighted means."""
    total = F.sum("support")
    mean = lambda c: _ratio(F.sum(F.col(c) * F.col("support")), total).alias(c)
    return classes.agg(mean("precision"), mean("recall"), mean("f1"), total.alias("support"))


def metrics_table(classes: DataFrame, digits: int = 3) -> DataFrame:
    """Per-class rows and the ``GLOBAL`` macro row, rounded half to even."""
    rows = classes.unionByName(macro(classes).withColumn("langue", F.lit("GLOBAL")))
    rounded = [F.bround(c, digits).alias(c) for c in ("precision", "recall", "f1")]
    return rows.select("langue", *rounded, "support")


def without_global(metrics: DataFrame) -> DataFrame:
    return metrics.where(F.col("langue") != "GLOBAL")


def report(pred: DataFrame, true: str = "true_label", guess: str = "predicted_label") -> DataFrame:
    """Per-class rows, then accuracy, macro average and weighted average.

    ``position`` gives the reading order. The accuracy row carries its value in ``f1``.
    """
    classes = per_class(pred, true, guess)
    order = F.row_number().over(W.orderBy("langue")).cast("long")
    body = classes.withColumn("position", order)
    pairs = pair_counts(pred, true, guess)
    right = F.sum(F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0))
    none = F.lit(None).cast("double")
    acc = pairs.agg(_ratio(right, F.sum("n")).alias("f1"), F.sum("n").alias("support")).select(
        F.lit("accuracy").alias("langue"), none.alias("precision"), none.alias("recall"), "f1", "support",
        F.lit(1_000_001).cast("long").alias("position"),
    )
    tail = [
        macro(classes).withColumns({"langue": F.lit("macro avg"), "position": F.lit(1_000_002).cast("long")}),
        weighted(classes).withColumns({"langue": F.lit("weighted avg"), "position": F.lit(1_000_003).cast("long")}),
    ]
    for part in [acc, *tail]:
        body = body.unionByName(part)
    return body


def score_spread(scores: DataFrame, column: str = "score") -> DataFrame:
    """Mean and population deviation of fold scores."""
    return scores.agg(F.avg(column).alias("mean"), F.stddev_pop(column).alias("std"))
