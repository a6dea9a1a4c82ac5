"""Removal by id and tag stripping."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from parlance.functions.text import strip_tags
from parlance.sources.corpus import ID, LABEL, TEXT, require_columns


def remove_ids(corpus: DataFrame, ids: DataFrame, ident: str = ID) -> DataFrame:
    """Rows whose id is not listed; rows without id go too, as a list is given.

    No broadcast hint: the optimizer broadcasts a list whose size allows it and shuffles a
    longer one, and the key is unique on the list side.
    """
    require_columns(corpus, [ident])
    listed = ids.select(F.col(ids.columns[0]).cast("string").alias("_listed")).distinct()
    keyed = corpus.where(F.col(ident).isNotNull())
    return keyed.join(listed, keyed[ident].cast("string") == F.col("_listed"), "left_anti")


def removed_count(corpus: DataFrame, kept: DataFrame) -> DataFrame:
    """One row ``before, kept, removed``."""
    counts = corpus.agg(F.count("*").alias("before"))
    after = kept.agg(F.count("*").alias("n")).scalar()
    return counts.select("before", after.alias("kept"), (F.col("before") - after).alias("removed"))


def clean_corpus(
    corpus: DataFrame, ids: DataFrame | None = None, text: str = TEXT, label: str = LABEL, ident: str = ID
) -> DataFrame:
    """Checked columns, listed ids removed, null text emptied, tags stripped."""
    require_columns(corpus, [text, label])
    if ids is not None:
        corpus = remove_ids(corpus, ids, ident)
    filled = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return corpus.withColumn(text, strip_tags(filled))
