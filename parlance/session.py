"""Session helpers: tuning defaults, the shared scratch folder, written intermediates."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
ARROW_ROWS_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Spark's setting to delete a query's shuffle files as soon as it has ended.
CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app: str = "parlance", master: str | None = None, **conf: str) -> SparkSession:
    """A session with AQE on; pass any further setting as a keyword with dots as ``__``."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local master may leave it unset: driver and executors are then one process, so a
    temporary folder is shared. On a cluster that would scatter the files, so it is an error.
    """
    root = spark.conf.get(CHECKPOINT_CONF, None)
    if not root:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="parlance-")
        spark.conf.set(CHECKPOINT_CONF, root)
    return root.rstrip("/")


_SCOPES: list[list[str]] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{scratch_root(spark)}/parlance/{name}-{uuid.uuid4().hex}"
    for scope in _SCOPES:
        scope.append(path)
    return path


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Deletes all intermediates written inside the block, at its end.

    Results that are still to be computed read them: write or collect those inside the block.
    """
    paths: list[str] = []
    _SCOPES.append(paths)
    try:
        yield
    finally:
        _SCOPES.remove(paths)
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for path in paths:
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(conf).delete(target, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage before iterative or repeated use. The copy outlives lost executors, and
    its file statistics let the optimizer choose broadcast or shuffle joins by real size. The
    shuffle files of the write go with it; otherwise they stay until the driver happens to collect garbage.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with _shuffles_go(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def _shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Queries that begin inside delete their shuffle files when they end."""
    before = spark.conf.get(CLEANUP_CONF, None)
    spark.conf.set(CLEANUP_CONF, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP_CONF, before) if before else spark.conf.unset(CLEANUP_CONF)


def short_batches(spark: SparkSession, rows: int = 1000) -> None:
    """From now on Python workers get batches of no more than ``rows`` rows, however long their texts are."""
    if int(spark.conf.get(ARROW_ROWS_CONF)) > rows:
        spark.conf.set(ARROW_ROWS_CONF, str(rows))


def shuffle_width(spark: SparkSession) -> int:
    """Partition count for explicit repartitions: the session's own shuffle setting."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(scan: DataFrame, *keys: str) -> DataFrame:
    """Repartition a plain scan only when it has fewer splits than the cluster has cores.

    A large table arrives in many splits and passes through untouched; a single-file table
    would otherwise run its row-local work in one task.
    """
    spark = scan.sparkSession
    cores = spark.sparkContext.defaultParallelism
    if scan.rdd.getNumPartitions() >= cores:
        return scan
    return scan.repartition(cores, *keys) if keys else scan.repartition(cores)
