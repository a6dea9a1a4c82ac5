import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from parlance.llm import token_files

PATH = public_tokenizers.path("word_bpe_49k.json")


def written(docs, tmp_path):
    path = str(tmp_path / "ids")
    token_files.write(docs, path, PATH)
    return path


def test_files_hold_every_text_in_id_order(spark, odd_docs, tmp_path):
    path = written(odd_docs, tmp_path)
    library, start = Tokenizer.from_file(PATH), 0
    source = sorted(((r["doc_id"], r["text"]) for r in odd_docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    rows = token_files.read(spark, path).orderBy("start").collect()
    for (doc_id, text), row in zip(source, rows, strict=True):
        ids = library.encode(text or "", add_special_tokens=False).ids + [1]
        assert (row["doc_id"], row["start"], row["n_tokens"], list(row["ids"])) == (doc_id, start, len(ids), ids)
        start += len(ids)
    sums = {r["start"]: r["ids_crc32"] for r in token_files.ids_crc32(token_files.read(spark, path)).collect()}
    assert sums == {r["start"]: zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes()) for r in rows}


def test_the_index_reads_no_ids(spark, docs, tmp_path):
    path = written(docs, tmp_path)
    index = token_files.read_index(spark, path)
    plan = index._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in [c for line in plan.splitlines() if "ReadSchema" in line for c in line.split("ReadSchema")[1].replace(":", ",").replace("<", ",").split(",")]
    assert index.count() == docs.count()
    one = token_files.read(spark, path).filter(F.col("doc_id") == 7)
    assert "EqualTo(doc_id,7)" in one._jdf.queryExecution().executedPlan().toString() and one.count() == 1


def test_no_rows(spark, no_docs, tmp_path):
    assert token_files.read(spark, written(no_docs, tmp_path)).count() == 0


def test_footers_show_dictionaries_row_groups_and_page_indexes(spark, docs, tmp_path):
    import glob

    import pyarrow.parquet as pq

    many = docs.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(29)))).select((F.col("doc_id") * 100 + F.col("k")).alias("doc_id"), "text").repartition(4)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    path = written(many, tmp_path)
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    for name in glob.glob(f"{path}/*.parquet"):
        meta = pq.ParquetFile(name).metadata
        for g in range(meta.num_row_groups):
            group = meta.row_group(g)
            assert group.total_byte_size <= 2 * int(token_files.LAYOUT["parquet.block.size"])
            for c in range(group.num_columns):
                column = group.column(c)
                assert column.has_offset_index and column.has_column_index
                assert column.path_in_schema != "ids.list.element" or column.has_dictionary_page
            ids = [group.column(c) for c in range(group.num_columns) if group.column(c).path_in_schema == "doc_id"][0]
            assert ids.statistics.has_min_max and ids.statistics.min <= ids.statistics.max


def test_memory_of_pieces_is_bounded():
    from parlance.llm import fragments

    held = fragments.Remembered(lambda piece: piece.encode() * 2, 40_000)
    for k in range(2000):
        for word in (f"w{k}", "often", "x" * 100):
            assert held[word] == word.encode() * 2
        assert sum(200 + 3 * len(w) for w in [*held, *held.older]) <= 41_000
    assert "often" in held and "x" * 100 not in held and "x" * 100 not in held.older
