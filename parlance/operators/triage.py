"""Upper-case curve of a corpus, its zones, and the rows in each zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from parlance.functions import lexicon as lx
from parlance.functions.text import uppercase_ratio


def with_ratio(corpus: DataFrame, text: str = "Texte") -> DataFrame:
    return corpus.withColumn("ratio", uppercase_ratio(F.coalesce(F.col(text), F.lit(""))))


def threshold_curve(rated: DataFrame) -> DataFrame:
    """``threshold, n, pct, drop``: texts at or above each threshold, in one pass.

    A single partial aggregate yields one row of ten counts; only that row is unpivoted, so
    the window below runs over ten rows whatever the corpus size.
    """
    thresholds = [p / 100 for p in lx.THRESHOLD_PERCENTS]
    reached = [
        F.count(F.when(F.col("ratio") >= F.lit(t), 1)).alias(f"n{p}")
        for t, p in zip(thresholds, lx.THRESHOLD_PERCENTS)
    ]
    totals = rated.agg(F.count("*").alias("total"), *reached)
    points = F.array(
        *[
            F.struct(F.lit(t).alias("threshold"), F.col(f"n{p}").alias("n"))
            for t, p in zip(thresholds, lx.THRESHOLD_PERCENTS)
        ]
    )
    curve = totals.select("total", F.inline(points))
    pct = F.when(F.col("total") > 0, F.col("n") / F.col("total") * 100).otherwise(F.lit(0.0))
    before = F.lag("n").over(W.orderBy("threshold"))
    return curve.select("threshold", "n", pct.alias("pct"), (before - F.col("n")).alias("drop"))


def drop_median(curve: DataFrame) -> DataFrame:
    """Upper median of the drops."""
    return curve.agg(F.sort_array(F.collect_list("drop")).alias("d")).select(
        F.expr("d[size(d) div 2]").alias("median")
    )


def zones(curve: DataFrame) -> DataFrame:
    """One row ``seuil_min, seuil_max, seuil_nettoyage``.

    A drop is stable when it does not exceed the median. The triage zone runs from the first
    threshold to the last one before the first stable drop; the clean-up zone starts at the
    threshold of the last stable drop. The median is itself a drop, so a stable one exists.
    """
    packed = curve.agg(F.array_sort(F.collect_list(F.struct("threshold", "drop"))).alias("c"))
    arrays = packed.select(
        F.expr("transform(c, p -> p.threshold)").alias("t"),
        F.expr("transform(slice(c, 2, size(c)), p -> p.drop)").alias("d"),
    ).withColumn("stable", F.expr("transform(d, x -> x <= sort_array(d)[size(d) div 2])"))
    return arrays.select(
        F.expr("t[0]").alias("seuil_min"),
        F.expr("t[int(array_position(stable, true)) - 1]").alias("seuil_max"),
        F.expr("t[size(d) - int(array_position(reverse(stable), true)) + 1]").alias("seuil_nettoyage"),
    )


def _limits(zone_row: DataFrame) -> Column:
    """The one-row zone table as a single scalar subquery, so that its limits share one run."""
    return zone_row.select(F.struct("seuil_min", "seuil_max", "seuil_nettoyage")).scalar()


def cleanup_rows(rated: DataFrame, zone_row: DataFrame) -> DataFrame:
    return rated.where(F.col("ratio") >= _limits(zone_row)["seuil_nettoyage"])


def triage_rows(rated: DataFrame, zone_row: DataFrame) -> DataFrame:
    limits = _limits(zone_row)
    return rated.where((F.col("ratio") >= limits["seuil_min"]) & (F.col("ratio") < limits["seuil_max"]))
