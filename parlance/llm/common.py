"""Helpers of the training-data operators: tables, folds, Arrow slices, word and window hashes.

Words and windows are cut and hashed with numpy over the bytes of many texts at once, inside
Spark tasks. Hashes only propose; what must be exact is compared on 128 bits or on text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.session import spread

SLICE_BYTES = 1 << 20  # text bytes worked on at once; a longer text is worked on alone
BATCH_ROWS = 1000  # texts that Spark hands to a Python worker at once
MASK64 = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A given table, spread over all cores where it is one small file."""
    scan = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(scan.select(*columns) if columns else scan)


def fold(doc_id: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string")) % parts


def pick(docs: DataFrame, *columns: str) -> DataFrame:
    """Just the named columns: any others, whatever they are called, cannot clash with ours.

    Whole texts are long rows, so the session's batches for Python workers are made short here.
    """
    conf = docs.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys(columns)])


def map_slices(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, text: str = "text") -> DataFrame:
    """``mapInArrow`` over slices of about ``SLICE_BYTES`` of text, so that memory stays bounded.

    What a batch took is given back before the next one, so that workers which wait hold little.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                yield fn(part)
            del batch
            pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0)
    total = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        before = total[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(total, before + SLICE_BYTES, side="right")))
        yield batch.slice(start, end - start)
        start = end


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts end to end, and the n + 1 offsets. Null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]], at - at[0]


def byte_class(inside: Callable[[int], bool]) -> np.ndarray:
    return np.array([inside(b) for b in range(256)])


#: Words are runs of anything but blank, tab, line feed, vertical tab, form feed, return.
PLAIN = byte_class(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
#: Words are runs of digits, lower-case letters and whatever is not ASCII.
ALNUM = byte_class(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], dtype=np.uint8)

_RANDOM = np.random.default_rng(20240607)
_LETTER = [_RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) for _ in range(2)]
_BASE = [int(x) | 1 for x in _RANDOM.integers(1 << 62, 1 << 63, 4, dtype=np.uint64)]
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the next call."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        table = np.full(max(n, 1024), base, dtype=np.uint64)
        table[0] = 1
        have = _POWERS[base] = np.multiply.accumulate(table)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Words:
    """The words of a slice of texts: byte limits, first word of each text, 64-bit hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, inside: np.ndarray = PLAIN):
        self.data, self.offsets = data, offsets
        word = inside[data]
        begins, ends = word.copy(), word.copy()
        if len(data):
            begins[1:] &= ~word[:-1]
            ends[:-1] &= ~word[1:]
            edges = offsets[:-1][offsets[:-1] < offsets[1:]]  # texts with bytes
            begins[edges] = word[edges]
            last = offsets[1:][offsets[:-1] < offsets[1:]] - 1
            ends[last] = word[last]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)  # n + 1 word offsets
        self.count = np.diff(self.first)
        self._word = word

    def hashes(self, which: int = 0) -> np.ndarray:
        """A polynomial over the bytes of each word, scrambled."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        lengths = self.end - self.start
        head = np.cumsum(lengths) - lengths
        place = np.arange(int(lengths.sum())) - np.repeat(head, lengths)
        terms = _LETTER[which][self.data[self._word]] * powers(_BASE[which], int(lengths.max()))[place]
        return mix(np.add.reduceat(terms, head) + lengths.astype(np.uint64))


def grams(values: np.ndarray, k: int, which: int = 0) -> np.ndarray:
    """Hash of each run of ``k`` consecutive values, limits of texts not regarded."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    base = _BASE[2 + which]
    inverse = pow(base, -1, 1 << 64)
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * powers(base, len(values)), out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * powers(inverse, n))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each run of ``width`` values, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:]) if len(out) > step else out[:0]
        have += step
    return out


def run_starts(first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all runs of ``k`` words that lie in one text, and how many each text has."""
    count = np.maximum(np.diff(first) - k + 1, 0)
    total = int(count.sum())
    before = np.cumsum(count) - count
    return np.arange(total) - np.repeat(before, count) + np.repeat(first[:-1], count), count


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """One list of ``counts[i]`` values a row."""
    return lists_of(counts, pa.array(values, kind))


def lists_of(counts: np.ndarray, values: pa.Array) -> pa.Array:
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
