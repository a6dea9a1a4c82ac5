"""Row-local work on a stream of texts.

Cleaning, features and scoring look at one text at a time, so the
batch functions run on a ``readStream`` table unchanged. These helpers only put a stream's
source and sink around them; whatever needs the whole corpus (curve, zones, vocabularies,
scaler) is fitted on a batch and passed in.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.streaming import StreamingQuery


def read_texts(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def write_rows(
    stream: DataFrame, row_local: Callable[[DataFrame], DataFrame], path: str, checkpoint: str | None = None
) -> StreamingQuery:
    """Apply ``row_local`` and append to parquet until the available input is used up.

    Without ``checkpoint``, progress is kept beside the output, so a restart goes on from there.
    """
    checkpoint = checkpoint or f"{path.rstrip('/')}/_checkpoint"
    out = row_local(stream)
    return (
        out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
