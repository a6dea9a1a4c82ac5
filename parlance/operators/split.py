"""Labels, class weights, exact stratified splits and folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from parlance.session import materialize

# Hex digits of a shuffle key that form its bucket: 4,096 of them.
BUCKET_DIGITS = 3
# Rows of a class table that are broadcast at most.
MAX_CLASSES = 1_000_000


def labels_of(df: DataFrame, label: str) -> DataFrame:
    """Sorted distinct labels."""
    return df.select(label).distinct().orderBy(label)


def label_list(df: DataFrame, label: str) -> list[str]:
    """The labels on the driver: one short row per class."""
    return [r[0] for r in labels_of(df, label).collect()]


def label_ids(df: DataFrame, label: str) -> DataFrame:
    """``label, label_id``: ids from 0 in label order, numbered over the class table only."""
    order = W.orderBy(label)
    return df.select(label).distinct().select(label, (F.row_number().over(order) - 1).alias("label_id"))


def class_table(classes: DataFrame) -> DataFrame:
    """A table of one row per class, broadcast once its size is checked.

    Joining rows by class through a shuffle would put each class, and all its texts, into one
    task. With more than ``MAX_CLASSES`` rows no class can be that large, so Spark may choose.
    """
    stored = materialize(classes, "classes")
    return F.broadcast(stored) if stored.count() <= MAX_CLASSES else stored


def encode_labels(df: DataFrame, ids: DataFrame, label: str) -> DataFrame:
    return df.join(class_table(ids), label)


def decode_labels(df: DataFrame, ids: DataFrame, label: str, id_column: str, out: str) -> DataFrame:
    names = ids.select(F.col("label_id").alias(id_column), F.col(label).alias(out))
    return df.join(class_table(names), id_column)


def class_distribution(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("n")).orderBy(F.desc("n"), label)


def corpus_summary(df: DataFrame, label: str) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows"), F.count_distinct(label).alias("n_classes"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weights ``n / (k * n_class)``; the windows run over one row per class."""
    per_class = df.groupBy(label).agg(F.count("*").alias("n"))
    everything = W.partitionBy()
    weight = F.sum("n").over(everything) / (F.count("*").over(everything) * F.col("n"))
    return per_class.select(label, "n", weight.alias("weight"))


def with_class_weight(df: DataFrame, weights: DataFrame, label: str) -> DataFrame:
    """Join weights to rows; a class absent from the weights gets 0.0."""
    joined = df.join(class_table(weights.select(label, "weight")), label, "left")
    return joined.withColumn("weight", F.coalesce("weight", F.lit(0.0)))


def bounded(train: DataFrame, ident: str, label: str, max_rows: int | None) -> DataFrame:
    """``train``, or a stratified share of it with at most about ``max_rows`` rows."""
    if max_rows is None:
        return train
    n = train.count()
    if n <= max_rows:
        return train
    return stratified_split(train.drop("is_test"), ident, label, max_rows / n).where("is_test")


def shuffle_key(ident: str, seed: int) -> Column:
    """A repeatable pseudo-random order over ids."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(ident).cast("string")))


def _rank_cuts(keyed: DataFrame, label: str, positions: DataFrame) -> DataFrame:
    """The keys at given ranks (``label, cut, rank``) of each label, by key order.

    Ranking a whole label would put a third of all rows into one task. Instead rows are
    counted per key prefix, which finds the prefix holding each wanted rank, and only rows of
    those prefixes are ranked: about one in 4,096. Both small results are written, so that
    whatever uses the cuts later reads a few rows instead of counting again.
    """
    prefix = F.substring("_key", 1, BUCKET_DIGITS)
    counts = keyed.groupBy(label, prefix.alias("_bucket")).agg(F.count("*").alias("_size"))
    running = F.sum("_size").over(W.partitionBy(label).orderBy("_bucket"))
    ranges = counts.withColumn("_end", running).withColumn("_start", F.col("_end") - F.col("_size"))
    hits = ranges.join(positions, label).where((F.col("rank") > F.col("_start")) & (F.col("rank") <= F.col("_end")))
    hits = hits.select(label, "_bucket", "cut", (F.col("rank") - F.col("_start")).alias("_local"))
    hits = materialize(hits, "cut-buckets")
    edge = keyed.withColumn("_bucket", prefix).join(
        hits.select(label, "_bucket").distinct(), [label, "_bucket"], "left_semi"
    )
    local = F.row_number().over(W.partitionBy(label, "_bucket").orderBy("_key"))
    ranked = edge.select(label, "_bucket", "_key", local.alias("_local"))
    cuts = ranked.join(hits, [label, "_bucket", "_local"]).select(label, "cut", F.col("_key").alias("_cut_key"))
    return materialize(cuts, "cuts")


def _keyed(df: DataFrame, ident: str, label: str, seed: int) -> DataFrame:
    unique = F.concat(shuffle_key(ident, seed), F.lit(":"), F.col(ident).cast("string"))
    return df.select(F.col(label), unique.alias("_key"))


def split_sizes(df: DataFrame, label: str, test_size: float) -> DataFrame:
    """``label, n, n_train, n_test``: the test part is ``ceil(share * n)`` rows overall.

    Train counts are the floors of the proportional shares, topped up by largest remainder
    (ties by label). Everything here is one row per class.
    """
    everything = W.partitionBy()
    sizes = df.groupBy(label).agg(F.count("*").alias("n")).withColumn("total", F.sum("n").over(everything))
    n_train = F.col("total") - F.ceil(F.col("total") * F.lit(test_size))
    sizes = sizes.withColumn("total_train", n_train)
    share = F.col("n") / F.col("total") * F.col("total_train")
    sizes = sizes.withColumn("share", share).withColumn("base", F.floor("share"))
    order = F.row_number().over(W.orderBy(F.desc(F.col("share") - F.col("base")), F.col(label)))
    missing = F.col("total_train") - F.sum("base").over(everything)
    sizes = sizes.withColumn("missing", missing).withColumn("order", order)
    n_fit = F.col("base") + F.when(F.col("order") <= F.col("missing"), 1).otherwise(0)
    return sizes.select(label, "n", n_fit.alias("n_train"), (F.col("n") - n_fit).alias("n_test"))


def stratified_split(
    df: DataFrame, ident: str, label: str, test_size: float = 0.20, seed: int = 42
) -> DataFrame:
    """Add ``is_test``: in each class the first rows by shuffled order form the test part.

    The decision is a comparison with one cut key per class, so rows are never shuffled with
    their texts.
    """
    positions = split_sizes(df, label, test_size).select(
        label, F.lit(1).alias("cut"), F.col("n_test").alias("rank")
    )
    cuts = _rank_cuts(_keyed(df, ident, label, seed), label, positions).select(label, "_cut_key")
    key = F.concat(shuffle_key(ident, seed), F.lit(":"), F.col(ident).cast("string"))
    joined = df.join(cuts, label, "left")
    return joined.withColumn("is_test", F.coalesce(key <= F.col("_cut_key"), F.lit(False))).drop("_cut_key")


def stratified_folds(df: DataFrame, ident: str, label: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Add ``fold`` in 0..k-1: equal slices of each class's shuffled order.

    Fold sizes of a class differ by one row at most. The k-1 cut keys of a class travel as one
    array, found the same way as for a split.
    """
    sizes = df.groupBy(label).agg(F.count("*").alias("n"))
    cuts = F.explode(F.sequence(F.lit(1), F.lit(k - 1))).alias("cut")
    positions = sizes.select(label, "n", cuts).select(
        label, "cut", F.expr(f"(n * cut) div {k}").alias("rank")
    )
    keys = _rank_cuts(_keyed(df, ident, label, seed), label, positions)
    keys = keys.groupBy(label).agg(F.collect_list("_cut_key").alias("_cuts"))
    key = F.concat(shuffle_key(ident, seed), F.lit(":"), F.col(ident).cast("string"))
    found = df.join(keys, label, "left").withColumn("_key", key)
    passed = F.expr("size(filter(_cuts, c -> c < _key))")
    absent = F.lit(k - 1) - F.coalesce(F.size("_cuts"), F.lit(0))
    fold = F.when(F.col("_cuts").isNull(), F.lit(k - 1)).otherwise(passed + absent)
    return found.withColumn("fold", fold.cast("int")).drop("_cuts", "_key")
