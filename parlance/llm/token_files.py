"""Token-id files: Parquet list columns, dictionary-coded, in small row groups with page indexes.

Documents are dealt out by ranges of ``doc_id`` and sorted within each file, so that files in
name order are in id order, min/max of row groups and pages are narrow, and a reader that asks
for some ids, or only for the metadata columns, touches just those pages. Each row carries the
ids before it in its own part; parts are added up by their totals, a few numbers a part.

Nulls: a null text has no ids but the end id; a null ``doc_id`` sorts first. Repeated rows are
kept, ties of ``doc_id`` in the order of their texts. Empty tables give empty files. Other
columns are not written unless named in ``keep``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from parlance.llm import common
from parlance.llm.fragments import coder

#: Row groups of 16 MB and pages of 256 KB: a selective read fetches little, a full one seeks rarely.
LAYOUT = {
    "parquet.block.size": str(16 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
    "parquet.enable.dictionary": "true",
    "parquet.dictionary.page.size": str(1 << 20),
    "compression": "zstd",
}


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, text: str = "text", doc_id: str = "doc_id") -> None:
    """Encodes each whole text, appends ``end_id`` and writes part, doc_id, before, n_tokens, ids.

    The tokenizer drops white space and lower-cases, so a text's pre-tokens are looked up one by one.
    """
    width = docs.sparkSession.conf.get("spark.sql.shuffle.partitions")
    kind = dict(docs.dtypes)[doc_id]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, before = coder(tokenizer), 0
        last = np.array([end_id], dtype="<i4").tobytes()
        for whole in batches:
            for part in common.slices(whole, text):
                texts = part.column(text).cast(pa.binary()).to_pylist()
                ids = [model.text_ids(t) + last if t else last for t in texts]
                counts = np.array([len(x) // 4 for x in ids])
                starts = before + np.cumsum(counts) - counts
                before += int(counts.sum())
                yield pa.RecordBatch.from_arrays(
                    [part.column(doc_id), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), common.lists(np.frombuffer(b"".join(ids), "<i4"), counts, pa.int32())],
                    names=["doc_id", "before", "n_tokens", "ids"],
                )

    (
        common.pick(docs, doc_id, text)
        .repartitionByRange(int(width), F.col(doc_id).asc_nulls_first())
        .sortWithinPartitions(F.col(doc_id).asc_nulls_first(), text)
        .mapInArrow(run, f"doc_id {kind}, before long, n_tokens long, ids array<int>")
        .withColumn("part", F.spark_partition_id())
        .select("part", "doc_id", "before", "n_tokens", "ids")
        .write.options(**LAYOUT).mode("errorifexists").parquet(path)
    )


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens: from the metadata columns only, no ids are read."""
    rows = spark.read.parquet(path).select("part", "doc_id", "before", "n_tokens")
    return _started(rows, spark, path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids. Filters on ``doc_id`` reach row groups and pages."""
    return _started(spark.read.parquet(path), spark, path)


def _started(rows: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    totals = spark.read.parquet(path).groupBy("part").agg(F.sum("n_tokens").alias("total"))
    # one row a file, so both the running sum and the broadcast are small
    bases = totals.select("part", (F.sum("total").over(W.orderBy("part")) - F.col("total")).alias("base"))
    return rows.join(F.broadcast(bases), "part").withColumn("start", F.col("base") + F.col("before")).drop("part", "base", "before")


def ids_crc32(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of the ids as little-endian 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            column = part.column("ids")
            offsets = column.offsets.to_numpy().tolist()
            raw = memoryview(np.ascontiguousarray(column.values.to_numpy(), dtype="<i4")).cast("B")
            sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(offsets, offsets[1:])]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("start"), part.column("n_tokens"), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"]
            )

    narrow = common.pick(tokens, "doc_id", "start", "n_tokens", "ids")
    return narrow.mapInArrow(run, f"doc_id {dict(narrow.dtypes)['doc_id']}, start long, n_tokens long, ids_crc32 long")
