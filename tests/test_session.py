"""Scratch folders, class joins, the annotator's life and stream restarts."""

import os
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from parlance import session
from parlance.operators import annotate as an, split
from parlance.plans import workflows as wf
from parlance.streaming import rowlocal


def test_a_cluster_must_name_its_scratch_folder():
    conf = SimpleNamespace(get=lambda key, default: default)
    cluster = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://head:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.scratch_root(cluster)


def test_a_scope_deletes_what_was_written_in_it(spark):
    with session.scratch_scope(spark):
        stored = session.materialize(spark.range(5), "scoped")
        folder = stored.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
        assert os.path.isdir(folder) and stored.count() == 5
    assert not os.path.exists(folder)


def test_rows_are_not_shuffled_by_class(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10")
    try:
        df = spark.createDataFrame([(i, "x" * 50, "ab"[i % 2]) for i in range(40)], "doc_id long, text string, label string")
        df = session.materialize(df, "labelled")
        for out in (split.encode_labels(df, split.label_ids(df, "label"), "label"), split.with_class_weight(df, split.class_weights(df, "label"), "label")):
            plan = out._jdf.queryExecution().executedPlan().toString()
            assert "BroadcastHashJoin" in plan and "hashpartitioning(label" not in plan
            assert out.count() == 40
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_an_annotator_is_loaded_once_a_worker(spark, tmp_path):
    folder = str(tmp_path)

    def factory():
        open(os.path.join(folder, f"{os.getpid()}-{os.urandom(4).hex()}"), "w").close()
        return lambda texts: [[] for _ in texts]

    df = spark.range(64).select(F.col("id").alias("doc_id"), F.lit("a").alias("text")).repartition(32)
    assert an.annotate(df, "text", factory).count() == 64
    workers = [name.split("-")[0] for name in os.listdir(folder)]
    assert len(workers) == len(set(workers)) and workers


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    for n in (1, 2):
        rows.withColumn("doc_id", F.lit(n).cast("long")).write.mode("append").parquet(source)
        stream = rowlocal.read_texts(spark, source, rows.schema)
        rowlocal.write_rows(stream, lambda df: df.withColumn("n", F.length("text")), out).awaitTermination()
    assert sorted(r["doc_id"] for r in spark.read.parquet(out).collect()) == [1, 2]


def test_repeated_ids_in_the_clean_up_zone(spark):
    rows = [("1", "ABCD", "x", "s"), ("1", "abcd", "x", "s"), ("2", "abcd", "x", "s"), (None, "abcd", "x", "s")]
    corpus = spark.createDataFrame(rows, "ID string, Texte string, Langue string, Niveau string")
    assert sorted((r["ID"], r["Texte"]) for r in wf.triage_and_clean(corpus).collect()) == [("1", "abcd"), ("2", "abcd")]
    assert [r["ID"] for r in wf.triage_and_clean(corpus, unique_ids=False).collect()] == ["2"]
