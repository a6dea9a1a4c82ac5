"""Readers for delimited corpora, id lists and parquet tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F, types as T

from parlance.functions import lexicon as lx
from parlance.functions.text import SPACE
from parlance.session import materialize, spread

ID, TEXT, LABEL, LEVEL = "ID", "Texte", "Langue", "Niveau"
SALTS = 64
NOTHING = "\x00"  # what the CSV reader takes for null; no text holds it
CORPUS_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in (ID, TEXT, LABEL, LEVEL)])


def _header(spark: SparkSession, path: str) -> str:
    """The first line of the corpus: one short row reaches the driver."""
    first = spark.read.text(path).limit(1).collect()
    return first[0][0].lstrip("﻿").rstrip("\r") if first else ""


def detect_sep(spark: SparkSession, path: str, candidates: str = ";,\t|") -> str:
    """The first candidate that splits the header into two columns or more, else a comma.

    What stands in quotes is part of a name and separates nothing.
    """
    header = re.sub(r'"[^"]*"', "", _header(spark, path))
    return next((sep for sep in candidates if sep in header), ",")


def read_corpus(
    spark: SparkSession,
    path: str,
    sep: str | None = ",",
    nulls: bool = False,
    multi_line: bool = True,
) -> DataFrame:
    """Every column as string, in the file's own order; a missing file raises.

    ``sep=None`` detects the separator. ``nulls=True`` reads the usual null tokens as null,
    as the learners do; the cleaning reader keeps them as text. Quoted line breaks need
    ``multi_line`` and make a file one split: for a large corpus write many files, or turn it
    off where texts hold no line breaks.
    """
    sep = sep or detect_sep(spark, path)
    reader = spark.read.option("sep", sep).option("header", True).option("escape", '"')
    # bare nothing is null, quoted nothing is empty text: the token keeps the two apart
    reader = reader.option("multiLine", multi_line).option("encoding", "UTF-8").option("nullValue", NOTHING)
    names = [c.lstrip("\ufeff").strip('"') for c in reader.csv(path).columns]
    schema = T.StructType([T.StructField(c, T.StringType()) for c in names])
    df = reader.schema(schema).option("enforceSchema", False).csv(path)
    return null_tokens(df) if nulls else df


def null_tokens(df: DataFrame) -> DataFrame:
    """Turn null tokens of string columns into null."""
    strings = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    return df.select(
        *[
            F.when(F.col(c).isin(lx.NULL_TOKENS), None).otherwise(F.col(c)).alias(c) if c in strings else F.col(c)
            for c in df.columns
        ]
    )


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Removal list: one id per line, trimmed, blanks and repeats dropped. Column ``ID``."""
    return clean_ids(spark.read.text(path), "value")


def clean_ids(df: DataFrame, column: str) -> DataFrame:
    ident = F.regexp_replace(F.col(column).cast("string"), rf"\A{SPACE}+|{SPACE}+\z", "")
    return df.select(ident.alias(ID)).filter(F.col(ID) != "").distinct()


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    for column in columns:
        if column not in df.columns:
            raise ValueError(f"column not found: {column!r}; available columns: {', '.join(df.columns)}")
    return df


def labelled(df: DataFrame, text: str = TEXT, label: str = LABEL) -> DataFrame:
    """Rows with text and label, both as strings."""
    require_columns(df, [text, label])
    kept = df.na.drop(subset=[text, label])
    return kept.withColumns({text: F.col(text).cast("string"), label: F.col(label).cast("string")})


def with_row_ids(df: DataFrame, ident: str = ID) -> DataFrame:
    """Give a corpus without ids stable ones: a hash of the row and a number among equal rows.

    Equal rows can swap numbers without any change, so the ids depend on the rows alone, not on
    how files are split. A row that is repeated very often is numbered in ``SALTS`` shares that
    are put one behind the other.
    """
    row_hash = F.md5(F.to_json(F.struct(*[F.col(c) for c in df.columns])))
    salted = df.withColumn("_h", row_hash).withColumn("_s", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
    salted = materialize(salted, "hashed-rows")  # the shares of a row must not change between the two uses
    sizes = salted.groupBy("_h", "_s").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy("_h").orderBy("_s")) - F.col("_n")
    place = F.row_number().over(W.partitionBy("_h", "_s").orderBy("_h"))
    placed = salted.withColumn("_i", place).join(sizes.select("_h", "_s", before.alias("_start")), ["_h", "_s"])
    return placed.withColumn(ident, F.concat_ws("-", "_h", (F.col("_start") + F.col("_i")).cast("string"))).drop("_h", "_s", "_i", "_start")


def documents_as_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``documents`` table under the corpus column names."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    return spread(docs, "doc_id").select(
        F.col("doc_id").cast("string").alias(ID),
        F.col("text").alias(TEXT),
        F.col("lang").alias(LABEL),
        F.col("source").alias(LEVEL),
    )
