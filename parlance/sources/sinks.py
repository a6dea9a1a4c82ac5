"""Writers: corpora, zone exports, reports, predictions and run records."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from parlance.functions import lexicon as lx


def write_csv(df: DataFrame, path: str, sep: str = ",", mode: str = "overwrite") -> None:
    """Header, doubled quotes, one part file per partition; reads back with ``read_corpus``.

    Empty strings stay quoted, null stays bare, and ``read_corpus`` tells the two apart.
    """
    writer = df.write.mode(mode).option("header", True).option("sep", sep).option("escape", '"')
    writer = writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    writer.option("emptyValue", '""').option("nullValue", "").csv(path)


def four_decimals(share: Column) -> Column:
    """A number from 0 to 1 as text with four decimals, rounded by its exact binary value.

    The number is cut into two parts whose products with 20,000 are exact, so that the sign of
    its distance from the middle between two texts is exact too; a true middle goes to even.
    """
    high = F.floor(share * (1 << 26)) / (1 << 26)
    low = share - high
    below = F.floor(share * 10000)
    beyond = (high * 20000 - (2 * below + 1)) + low * 20000
    up = (beyond > 0) | ((beyond == 0) & (below % 2 == 1))
    units = below + F.when(up, 1).otherwise(0)
    return F.concat(F.floor(units / 10000).cast("string"), F.lit("."), F.lpad((units % 10000).cast("string"), 4, "0"))


def zone_export(rows: DataFrame, ratio: str = "ratio") -> DataFrame:
    """Corpus columns plus the ratio as text with four decimals."""
    return rows.select("ID", "Texte", "Langue", "Niveau", four_decimals(F.col(ratio)).alias("ratio_majuscules"))


def zone_file_names(zones_row) -> dict[str, str]:
    """Export names that carry the zone limits in percent (Python truncation kept)."""
    low, high, clean = (
        int(zones_row[c] * 100) for c in ("seuil_min", "seuil_max", "seuil_nettoyage")
    )
    return {"clean": f"nettoyage_{clean}pct_et_plus.csv", "triage": f"tri_manuel_{low}_{high}pct.csv"}


def threshold_report(curve: DataFrame) -> DataFrame:
    """The curve as report lines: percent, count, share, drop ("-" on the first)."""
    return curve.select(
        F.concat((F.col("threshold") * 100).cast("int").cast("string"), F.lit("%")).alias("seuil"),
        F.col("n").alias("detectes"),
        F.format_string("%.2f%%", F.col("pct")).alias("pct_corpus"),
        F.coalesce(F.col("drop").cast("string"), F.lit("-")).alias("chute"),
    )


def threshold_lines(curve: DataFrame, zones: DataFrame) -> DataFrame:
    """The report as text: a line for each threshold, then one for each zone."""
    report = threshold_report(curve.withColumn("threshold", F.col("threshold")))
    rows = curve.select("threshold").withColumn("seuil", F.concat((F.col("threshold") * 100).cast("int").cast("string"), F.lit("%"))).join(report, "seuil")
    body = rows.select(F.col("threshold").alias("position"), F.format_string("%s\t%s\t%s\t%s", "seuil", F.col("detectes").cast("string"), "pct_corpus", "chute").alias("value"))
    percent = lambda c: (F.col(c) * 100).cast("int").cast("string")
    triage = zones.select(F.lit(2.0).alias("position"), F.concat(F.lit("tri manuel\t"), percent("seuil_min"), F.lit("-"), percent("seuil_max"), F.lit("%")).alias("value"))
    clean = zones.select(F.lit(3.0).alias("position"), F.concat(F.lit("nettoyage\t"), percent("seuil_nettoyage"), F.lit("%+")).alias("value"))
    return body.unionByName(triage).unionByName(clean).orderBy("position").select("value")


def write_threshold_report(curve: DataFrame, zones: DataFrame, path: str) -> None:
    threshold_lines(curve, zones).coalesce(1).write.mode("overwrite").text(path)


def run_stamp() -> str:
    """Second-precise name of a run folder."""
    return datetime.now().strftime("%Y%m%d_%H%M%S")


def report_lines(report: DataFrame, digits: int = 3) -> DataFrame:
    """A classification report as ordered text lines, ready for ``write.text``."""
    number = f"%.{digits}f"
    score = lambda c: F.coalesce(F.format_string(number, F.col(c)), F.lit(""))
    line = F.format_string(
        "%16s%10s%10s%10s%10d", "langue", score("precision"), score("recall"), score("f1"), "support"
    )
    return report.orderBy("position").select(line.alias("value"))


def experiment_name(model: str, features: list[str]) -> str:
    return f"{model}_{'+'.join(features)}" if features else f"{model}_bert_only"


RUN_CONFIG = T.StructType(
    [
        T.StructField("csv", T.StringType()),
        T.StructField("model_choice", T.StringType()),
        T.StructField("model_name", T.StringType()),
        T.StructField("features", T.ArrayType(T.StringType())),
        T.StructField("feature_columns", T.ArrayType(T.StringType())),
        T.StructField("feature_hidden_dim", T.IntegerType()),
        T.StructField("max_length", T.IntegerType()),
        T.StructField("epochs", T.IntegerType()),
        T.StructField("batch_size", T.IntegerType()),
        T.StructField("lr", T.DoubleType()),
        T.StructField("test_size", T.DoubleType()),
        T.StructField("seed", T.IntegerType()),
        T.StructField("labels", T.ArrayType(T.StringType())),
        T.StructField("label2id", T.MapType(T.StringType(), T.IntegerType())),
    ]
)


def scorer_settings(model: str, **overrides) -> dict:
    """Preset of a model with the caller's non-null overrides on top."""
    settings = {**lx.PRESET_FALLBACK, **lx.MODEL_PRESETS.get(model, {})}
    settings.update({k: v for k, v in overrides.items() if v is not None})
    return settings


def run_config(
    spark: SparkSession,
    csv: str,
    model: str,
    features: list[str],
    feature_columns: list[str],
    labels: list[str],
    test_size: float = 0.20,
    seed: int = 42,
    feature_hidden_dim: int = 64,
    **overrides,
) -> DataFrame:
    """One row with everything needed to repeat a run."""
    settings = scorer_settings(model, **overrides)
    row = (
        csv, model, lx.MODEL_NAMES.get(model, model), features, feature_columns, feature_hidden_dim,
        settings["max_length"], settings["epochs"], settings["batch_size"], settings["lr"],
        test_size, seed, labels, {label: i for i, label in enumerate(labels)},
    )
    return spark.createDataFrame([row], RUN_CONFIG)


def run_metrics(report: DataFrame, elapsed: float) -> DataFrame:
    """One row: accuracy, the report keyed by class, elapsed seconds."""
    scores = F.struct("precision", "recall", "f1", "support")
    return report.agg(
        F.max(F.when(F.col("langue") == "accuracy", F.col("f1"))).alias("accuracy"),
        F.map_from_entries(
            F.collect_list(F.when(F.col("langue") != "accuracy", F.struct(F.col("langue"), scores)))
        ).alias("classification_report"),
        F.lit(float(elapsed)).alias("elapsed_seconds"),
    )


def write_run(
    root: str,
    experiment: str,
    stamp: str,
    config: DataFrame,
    metrics: DataFrame,
    report: DataFrame,
    predictions: DataFrame,
) -> str:
    """Save a run under ``root/experiment/stamp`` and return that folder."""
    folder = f"{root.rstrip('/')}/{experiment}/{stamp}"
    config.write.mode("overwrite").json(f"{folder}/config.json")
    metrics.write.mode("overwrite").json(f"{folder}/metrics.json")
    report_lines(report).coalesce(1).write.mode("overwrite").text(f"{folder}/classification_report.txt")
    write_csv(predictions, f"{folder}/predictions.csv")
    return folder
