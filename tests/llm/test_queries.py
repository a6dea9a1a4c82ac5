"""Every registered query over the smallest tables: its columns, and a row for each document or conversation."""

import pytest
from pyspark.sql import functions as F

from parlance.llm.queries import ORACLES, QUERIES

COLUMNS = {
    "op1_toxicity": {"doc_id", "held_out", "score", "predicted"},
    "op3_bpe": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
    "op4_substring": {"doc_id", "n_words", "n_removed", "kept_sha256"},
    "op5_simhash": {"doc_id", "fingerprint", "component_id"},
    "op6_context_mixing": {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"},
    "op7_token_files": {"doc_id", "start", "n_tokens", "ids_crc32"},
    "op10_langid": {"doc_id", "held_out", "lang_pred", "score"},
    "op13_mixture": {"doc_id", "size", "source_size", "target", "taken"},
}


@pytest.mark.parametrize("name", COLUMNS)
def test_a_row_for_each_document(spark, sf, docs, name):
    rows = QUERIES[name](spark, sf).toPandas()
    assert COLUMNS[name] <= set(rows.columns) and len(rows) == docs.count()
    assert set(rows["doc_id"]) == {r[0] for r in docs.select("doc_id").collect()}


def test_words_and_nodes(spark, sf):
    words = QUERIES["op11_spelling"](spark, sf)
    assert set(words.columns) == {"word", "form", "root", "n", "n_near", "form_n"} and words.filter((F.length("word") < 7) | (F.col("n") < 2)).isEmpty()
    nodes = QUERIES["op12_trie"](spark, sf).toPandas()
    root = nodes[nodes["depth"] == 0].iloc[0]
    assert root["n_convs"] == spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id").distinct().count()
    assert root["n_leaves"] == (nodes["n_children"] == 0).sum() and nodes["n_children"].sum() == len(nodes) - 1


def test_all_queries_are_tested():
    assert set(QUERIES) == set(COLUMNS) | set(ORACLES) | {"op11_spelling", "op12_trie"}
