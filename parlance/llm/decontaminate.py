"""Benchmark decontamination by winnowing.

Words are digits, letters a-z after lower-casing A-Z, and whatever is not ASCII. A window is
``WINDOW`` consecutive words of a benchmark item; a shorter item is one window as a whole. Of the
``GRAM``-word hashes in each window the least is its fingerprint. It depends on the window's
words alone, so a shared window has the same fingerprint on both sides: no span of ``WINDOW``
words can be missed. Shorter items use their own length as window and gram.

Both sides are fingerprinted by the same code. A bitmap of fixed size of the benchmark's
fingerprints, 512 KB, thins out the documents' side within the scan; what passes is joined on
the fingerprint and extended, that is, confirmed on 128 bits over all words of the window. A
confirmed window marks its words in the document; the marks of a row are united in order of
position. Benchmark rows with the same window are kept apart only as a list of item ids.

Nulls: null texts have no words; a null ``item_id`` is no item and its text is not looked for;
a null ``doc_id`` is a row like any other. Repeated rows are judged each, repeated item ids
count once. Empty tables give no rows, or no hits. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.llm import common
from parlance.session import materialize

WINDOW, GRAM = 10, 5
BITS = 22  # of the bitmap's address
SHAPES = "array<struct<fp:bigint,h1:bigint,h2:bigint,at:int,size:int>>"
_SHAPE = pa.struct([("fp", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("at", pa.int32()), ("size", pa.int32())])


def passes(fingerprints: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    """Whether the bitmap, of 2**b bits, has the first b bits of each fingerprint."""
    where = (fingerprints >> np.uint64(65 - (8 * len(bitmap)).bit_length())).astype(np.int64)
    return (bitmap[where >> 3] >> (where & 7).astype(np.uint8)) & 1 > 0


class Windows:
    """All windows of one size in a slice of texts: fingerprint, 128-bit hash, start, text."""

    def __init__(self, words: common.Words, h1: np.ndarray, h2: np.ndarray, size: int):
        gram = GRAM if size == WINDOW else size
        least = common.sliding_min(common.grams(h1, gram), size - gram + 1)
        self.start, self.count = common.run_starts(words.first, size)
        self.fp = common.mix(least[self.start] + np.uint64(size))
        self._h1, self._h2, self.size = h1, h2, size

    def structs(self, chosen: np.ndarray, first: np.ndarray, texts: np.ndarray) -> dict[str, np.ndarray]:
        at = self.start[chosen]
        return {
            "text": texts,
            "fp": self.fp[chosen],
            "h1": common.grams(self._h1, self.size, 0)[at],
            "h2": common.grams(self._h2, self.size, 1)[at],
            "at": at - first[texts],
            "size": np.full(len(at), self.size),
        }


def window_lists(column: pa.Array, sizes: list[int], bitmap: np.ndarray | None = None, whole_only: bool = False) -> tuple[np.ndarray, pa.Array]:
    """Word counts, and for each text its windows (with ``bitmap``, only those that pass it).

    ``whole_only``: windows shorter than ``WINDOW`` only where they are the whole text.
    """
    data, offsets = common.text_bytes(column)
    words = common.Words(common.LOWER[data], offsets, common.ALNUM)
    h1, h2 = words.hashes(0), words.hashes(1)
    found = []
    for size in sizes:
        windows = Windows(words, h1, h2, size)
        texts = np.repeat(np.arange(len(column)), windows.count)
        keep = np.ones(len(texts), bool)
        if bitmap is not None:
            keep = passes(windows.fp, bitmap)
        if whole_only and size < WINDOW:
            keep &= words.count[texts] == size
        if keep.any():
            found.append(windows.structs(np.flatnonzero(keep), words.first, texts[keep]))
    if not found:
        return words.count, common.lists_of(np.zeros(len(column), np.int64), pa.array([], _SHAPE))
    joined = {k: np.concatenate([f[k] for f in found]) for k in found[0]}
    order = np.argsort(joined["text"], kind="stable")
    values = [pa.array(joined[k][order].astype(np.int64), pa.int64()) for k in ("fp", "h1", "h2")] + [pa.array(joined[k][order], pa.int32()) for k in ("at", "size")]
    return words.count, common.lists_of(np.bincount(joined["text"], minlength=len(column)), pa.StructArray.from_arrays(values, fields=list(_SHAPE)))


def item_windows(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """item_id, fp, h1, h2, size: the distinct windows of each item."""
    kind = dict(benchmark.dtypes)[item_id]

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        _, windows = window_lists(part.column(text), list(range(1, WINDOW + 1)), whole_only=True)
        return common.batch(item_id=part.column(item_id), windows=windows)

    known = common.pick(benchmark, item_id, text).filter(F.col(item_id).isNotNull() & F.col(text).isNotNull())
    listed = common.map_slices(known, run, f"item_id {kind}, windows {SHAPES}", text)
    return listed.select("item_id", F.explode("windows").alias("w")).select("item_id", "w.fp", "w.h1", "w.h2", "w.size").distinct()


def fingerprint_bitmap(windows: DataFrame) -> np.ndarray:
    """At most 2**BITS addresses come to the driver, whatever the benchmark holds."""
    address = F.shiftrightunsigned("fp", 64 - BITS)
    used = windows.select(address.cast("int").alias("slot")).distinct().toArrow().column("slot").to_numpy()
    flags = np.zeros(1 << BITS, np.uint8)
    flags[used] = 1
    return np.packbits(flags, bitorder="little")


def hit_words(spans: Column) -> Column:
    """Words in the union of (at, size) spans, read in order of ``at``."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def step(acc: Column, s: Column) -> Column:
        end = s["at"] + s["size"]
        new = F.greatest(end - F.greatest(s["at"], acc["end"]), F.lit(0))
        return F.struct(F.greatest(end, acc["end"]).alias("end"), (acc["n"] + new).alias("n"))

    return F.aggregate(F.array_sort(spans), zero, step, lambda acc: acc["n"])


def find(docs: DataFrame, benchmark: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns, n_words, n_hit, items (sorted ids as strings) and spans of each row."""
    windows = materialize(item_windows(benchmark), "benchmark-windows")
    sizes = sorted(r["size"] for r in windows.select("size").distinct().collect())  # at most WINDOW values
    bitmap = docs.sparkSession.sparkContext.broadcast(fingerprint_bitmap(windows))

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        counts, found = window_lists(part.column(text), sizes, bitmap.value)
        return pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.array(counts, pa.int64()), found], names=[*keep, "n_words", "found"])

    narrow = common.pick(docs, *keep, text)
    kinds = dict(narrow.dtypes)
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in keep], f"n_words long, found {SHAPES}"])
    # written once: the number of a row is then the same for every later reader
    scanned = materialize(common.map_slices(narrow, run, schema, text).withColumn("row__", F.monotonically_increasing_id()), "document-windows")

    passed = scanned.filter(F.size("found") > 0).select("row__", F.explode("found").alias("w")).select("row__", "w.*")
    shapes = windows.select("fp", "h1", "h2", "size").distinct()
    hits = materialize(passed.join(shapes, ["fp", "h1", "h2", "size"], "left_semi"), "confirmed-windows")
    spans = hits.groupBy("row__").agg(F.collect_list(F.struct("at", "size")).alias("spans"))
    named = hits.select("row__", "h1", "h2", "size").distinct().join(windows.select("h1", "h2", "size", "item_id"), ["h1", "h2", "size"])
    items = named.groupBy("row__").agg(F.collect_set(F.col("item_id").cast("string")).alias("items"))
    found = spans.join(items, "row__").select("row__", hit_words(F.col("spans")).alias("n_hit"), F.array_sort("items").alias("items"), F.array_sort("spans").alias("spans"))
    return scanned.drop("found").join(found, "row__", "left").select(
        *[F.col(f"`{c}`") for c in keep],
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast(T.ArrayType(T.StringType()))).alias("items"),
        "spans",
    )
