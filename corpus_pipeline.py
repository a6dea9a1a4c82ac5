"""From raw documents to token ids in five stages, each written as Parquet and read again.

1. ``quality`` drops the lines that fail a rule and the documents that are rejected.
2. ``near_duplicates`` keeps one document of each group, the one with the smallest id.
3. ``substrings`` removes repeated passages; documents of which nothing is left go.
4. ``decontaminate`` drops documents that hold benchmark passages.
5. ``tokens`` encodes what is left and decodes it again.

All stages but the last return the columns of ``documents`` with ``n_chars`` brought up to date.
A row with a null id is kept by the second stage and left whole by the third.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm import bpe, decontaminate, line_rules, simhash, substring
from parlance.session import materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _documents(line_rules.clean(docs.select(*COLUMNS)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    groups = simhash.near_duplicates(docs.select("doc_id", "text"))
    first = groups.filter(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    # rows of one id share its fate; of equal ones among them one stays
    kept = docs.join(first, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return _documents(kept.unionByName(docs.filter(F.col("doc_id").isNull())))


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    left = substring.dedup(docs.select(*COLUMNS))
    return _documents(left.filter((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words"))))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.find(docs.select(*COLUMNS), benchmark, keep=COLUMNS)
    return _documents(found.filter(F.col("n_hit") == 0))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoded = bpe.encode(docs.select(*COLUMNS), path, keep=("doc_id", "lang", "source"))
    decoded = bpe.decode(encoded, path, keep=("doc_id", "lang", "source", "ids"))
    return decoded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "text")


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("substrings", substrings),
    ("decontaminate", decontaminated),
    ("tokens", tokens),
]

#: Fingerprints and token ids are not expressible in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
