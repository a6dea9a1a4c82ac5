"""Links between texts that share most of their five-word shingles.

Candidates share one of ``BANDS`` keys, each made of ``ROWS`` least hashes (MinHash) over the shingles:
two texts of similarity 0.8 share none with a chance of 3 in a million. Every candidate is then
confirmed by the exact similarity of both shingle sets (by 64-bit hashes). A key's members are met
each with the ``NEXT`` after it, in an order of the key's own, so a key of up to ``NEXT`` + 1 texts
is met in full and a larger one is linked through its neighbours, never through all its pairs.

Texts of fewer than five words have no shingle and no links here. Equal texts count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from parlance.llm import common
from parlance.session import materialize

BANDS, ROWS, NEXT = 24, 4, 16
_ODD = np.random.default_rng(5).integers(1 << 62, 1 << 63, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)


def _shingles(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all shingles, how many each text has, and a hash of each whole text's words."""
    data, offsets = common.text_bytes(column)
    words = common.Words(common.LOWER[data], offsets)
    hashes = words.hashes()
    starts, count = common.run_starts(words.first, width)
    place = np.arange(len(hashes)) - np.repeat(words.first[:-1], words.count)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(common.mix(hashes + place.astype(np.uint64)))])
    whole = common.mix(sums[words.first[1:]] - sums[words.first[:-1]] + words.count.astype(np.uint64))
    return common.grams(hashes, width)[starts], count, whole


def links(docs: DataFrame, fingerprinted: DataFrame, width: int, least: float, known_bits: int, text: str = "text") -> DataFrame:
    """(a, b): fingerprints of texts whose similarity is ``least`` or more.

    ``fingerprinted`` has the text and its ``fp``; pairs within ``known_bits`` are linked already.
    """

    def signed(values: np.ndarray) -> pa.Array:
        return pa.array(values.view(np.int64))

    def keys(part: pa.RecordBatch) -> pa.RecordBatch:
        hashes, count, whole = _shingles(part.column(text), width)
        some = np.flatnonzero(count)
        heads = (np.cumsum(count) - count)[some]
        bands = np.zeros((len(some), BANDS), np.uint64)
        for b in range(BANDS if len(some) else 0):
            for odd in _ODD[b]:
                bands[:, b] = common.mix(bands[:, b] + np.minimum.reduceat(common.mix(hashes * odd), heads))
            bands[:, b] = common.mix(bands[:, b] + np.uint64(b))
        lists = common.lists_of(np.full(len(some), BANDS), signed(bands.reshape(-1)))
        return common.batch(sid=signed(whole[some]), fp=part.column("fp").take(pa.array(some)), bands=lists)

    def sets(part: pa.RecordBatch) -> pa.RecordBatch:
        hashes, count, whole = _shingles(part.column(text), width)
        ends = np.cumsum(count)
        return common.batch(sid=signed(whole), shingles=pa.array([np.unique(hashes[e - n : e]).tobytes() for e, n in zip(ends, count)], pa.binary()))

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            near = []
            for one, other in zip(part.column("one").to_pylist(), part.column("other").to_pylist()):
                x, y = np.frombuffer(one, np.uint64), np.frombuffer(other, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                near.append(both >= least * (len(x) + len(y) - both))
            yield part.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    kind = "sid long, fp long, bands array<long>"
    signed_rows = common.map_slices(fingerprinted.select(text, "fp"), keys, kind, text).dropDuplicates(["sid"])
    rows = materialize(signed_rows, "shingle-bands").select("sid", "fp", F.explode("bands").alias("key"))
    after = W.partitionBy("key").orderBy(F.xxhash64("key", "sid"), "sid").rowsBetween(1, NEXT)
    around = rows.withColumn("others", F.collect_list(F.struct("sid", "fp")).over(after))
    met = around.select("sid", "fp", F.explode("others").alias("o"))
    far = met.filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("o.fp"))) > known_bits)
    first = F.col("sid") < F.col("o.sid")
    pair = [F.when(first, x).otherwise(y).alias(n) for n, x, y in (("s", F.col("sid"), F.col("o.sid")), ("t", F.col("o.sid"), F.col("sid")), ("a", F.col("fp"), F.col("o.fp")), ("b", F.col("o.fp"), F.col("fp")))]
    pairs = materialize(far.select(*pair).dropDuplicates(["s", "t"]), "shingle-pairs")
    wanted = pairs.select(F.col("s").alias("sid")).unionByName(pairs.select(F.col("t").alias("sid"))).distinct()
    every = common.map_slices(docs.select(text), sets, "sid long, shingles binary", text)
    known = materialize(every.join(wanted, "sid", "left_semi").dropDuplicates(["sid"]), "shingle-sets")
    one = known.select(F.col("sid").alias("s"), F.col("shingles").alias("one"))
    other = known.select(F.col("sid").alias("t"), F.col("shingles").alias("other"))
    return pairs.join(one, "s").join(other, "t").select("a", "b", "one", "other").mapInArrow(confirm, "a long, b long")
