"""SimHash near-duplicates with pigeonring filtering.

Texts get 64-bit fingerprints from hashes of four-word shingles; equal fingerprints are one
class. The 64 bits form a ring of five segments. When two fingerprints differ in at most four
bits, some segment starts a chain whose first l segments differ in at most 4l/5 bits, for each l:
none in the first, at most one in the first two, two in three, three in four. Candidates are
therefore looked for by the first two segments with one bit of the second left out, once for
each bit: two fingerprints that can start such a chain share one of these 64 keys, 24 or 25 bits
long. Within a key, longer chains are checked against their budgets before the whole distance.

A key's members are searched from one to the next, each once, and only the links of a spanning
forest leave the task, so dense groups never turn into all their pairs. A key with more than
``BLOCK`` members is cut into blocks that meet two by two in tasks of their own.

Nulls: a null text is empty and has fingerprint zero, like any text without words; a row with a
null ``doc_id`` links others but is nobody's smallest id. Repeated rows are returned each. Empty
tables give empty tables. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from parlance.llm import common, jaccard
from parlance.llm.components import components
from parlance.session import materialize

SHINGLE, SEED, DISTANCE = 4, 42, 4
SEGMENTS = (13, 13, 13, 13, 12)
BLOCK = 4096
CHUNK = 1 << 16  # shingles whose bits are counted at once

STARTS = tuple(int(x) for x in np.cumsum((0, *SEGMENTS[:-1])))
MASKS = tuple(((1 << width) - 1) << start for width, start in zip(SEGMENTS, STARTS))


def fingerprint(text: bytes) -> int:
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    lasts = ends[SHINGLE - 1 :].tolist() or [len(joined)]
    digest = xxhash.xxh64_intdigest
    ones, total = np.zeros(64, np.int64), len(lasts)
    for at in range(0, total, CHUNK):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + CHUNK], lasts[at : at + CHUNK])], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns and ``fp``, the fingerprint as a signed 64-bit integer."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        found = [fingerprint(t) if t else 0 for t in part.column(text).cast(pa.binary()).to_pylist()]
        column = pa.array(np.array(found, dtype=np.uint64).view(np.int64))
        return pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], column], names=[*keep, "fp"])

    narrow = common.pick(docs, *keep, text)
    kinds = dict(narrow.dtypes)
    return common.map_slices(narrow, run, ", ".join([*[f"`{c}` {kinds[c]}" for c in keep], "fp long"]), text)


def keyed(fps: DataFrame) -> DataFrame:
    """key, fp: the 64 keys of each fingerprint, the number of the bit left out on top."""
    places = []
    for bit in range(64):
        s = next(i for i, m in enumerate(MASKS) if m >> bit & 1)
        before = (s - 1) % len(SEGMENTS)
        second = ((1 << SEGMENTS[s]) - 1) & ~(1 << (bit - STARTS[s]))
        places.append(F.struct(*[F.lit(v).alias(n) for n, v in (("bit", bit), ("from1", STARTS[before]), ("mask1", (1 << SEGMENTS[before]) - 1), ("from2", STARTS[s]), ("mask2", second))]))
    laid = fps.select("fp", F.explode(F.array(*places)).alias("p"))
    return laid.select(
        F.expr("(bigint(p.bit) << 26) | ((shiftrightunsigned(fp, p.from1) & p.mask1) << 13) | (shiftrightunsigned(fp, p.from2) & p.mask2)").alias("key"), "fp"
    )


def chain_mask(bit: int, length: int) -> int:
    """Bits of the first ``length`` segments of the chain that the key of this bit stands for."""
    s = next(i for i, m in enumerate(MASKS) if m >> bit & 1)
    return sum(MASKS[(s - 1 + i) % len(SEGMENTS)] for i in range(length))


CHAIN3 = np.array([chain_mask(bit, 3) for bit in range(64)], dtype=np.uint64)
CHAIN4 = np.array([chain_mask(bit, 4) for bit in range(64)], dtype=np.uint64)


def near(one: np.ndarray, others: np.ndarray, bit: int) -> np.ndarray:
    """Positions in ``others`` within the chain's budgets and then within ``DISTANCE``."""
    differ = one ^ others
    at = np.flatnonzero(np.bitwise_count(differ & CHAIN3[bit]) <= 2)
    at = at[np.bitwise_count(differ[at] & CHAIN4[bit]) <= 3]
    return at[np.bitwise_count(differ[at]) <= DISTANCE]


def forest(members: np.ndarray, bit: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the members of one key as their near pairs do, one less than a tree has nodes."""
    left, tails, heads, queue = members, [], [], []
    while len(left) or queue:
        if not queue:
            queue, left = [left[0]], left[1:]
        node = queue.pop()
        found = near(node, left, bit)
        if len(found):
            reached = left[found]
            tails.append(np.full(len(reached), node, np.uint64))
            heads.append(reached)
            queue.extend(reached)
            left = np.delete(left, found)
    empty = np.zeros(0, np.uint64)
    return np.concatenate([empty, *tails]), np.concatenate([empty, *heads])


def _linked(tails: np.ndarray, heads: np.ndarray) -> pa.RecordBatch:
    return common.batch(a=pa.array(tails.view(np.int64)), b=pa.array(heads.view(np.int64)))


def key_links(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of keys whose rows (key, fp) follow one another; only an unfinished key is held."""
    keys, fps = np.zeros(0, np.int64), np.zeros(0, np.uint64)

    def work(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        sizes = np.diff(np.append(heads, len(keys)))
        two = heads[sizes == 2]  # most keys: all at once
        differ, bits = fps[two] ^ fps[two + 1], keys[two] >> 26
        within = (np.bitwise_count(differ & CHAIN3[bits]) <= 2) & (np.bitwise_count(differ & CHAIN4[bits]) <= 3)
        close = two[within & (np.bitwise_count(differ) <= DISTANCE)]
        tails, ends = [fps[close]], [fps[close + 1]]
        for at, size in zip(heads[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            a, b = forest(fps[at : at + size], int(keys[at] >> 26))
            tails.append(a)
            ends.append(b)
        return _linked(np.concatenate(tails), np.concatenate(ends))

    for part in rows:
        keys = np.concatenate([keys, part.column("key").to_numpy()])
        fps = np.concatenate([fps, part.column("fp").to_numpy().view(np.uint64)])
        if len(keys) and keys[0] != keys[-1]:
            last = int(np.flatnonzero(keys != keys[-1])[-1]) + 1
            yield work(keys[:last], fps[:last])
            keys, fps = keys[last:], fps[last:]
    if len(keys):
        yield work(keys, fps)


def links(fps: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b): links that connect distinct fingerprints exactly as all near pairs do."""
    by_key = W.partitionBy("key").orderBy("fp")
    sized = keyed(fps).select("key", "fp", F.count("*").over(by_key.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("n"), F.row_number().over(by_key).alias("place"))
    shared = sized.filter(F.col("n") > 1)
    found = shared.filter(F.col("n") <= block).select("key", "fp").mapInArrow(key_links, "a long, b long")

    own = F.floor((F.col("place") - 1) / block).cast("int")
    blocks = F.ceil(F.col("n") / block).cast("int")
    large = shared.filter(F.col("n") > block).select("key", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    met = large.filter(F.col("own") != F.col("other")).select("key", "fp", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))

    def join_blocks(group: pa.Table) -> pa.Table:
        members = group.column("fp").to_numpy().view(np.uint64)
        return pa.Table.from_batches([_linked(*forest(members, int(group.column("key")[0].as_py() >> 26)))])

    return found.unionByName(met.groupBy("key", "low", "high").applyInArrow(join_blocks, "a long, b long"))


def near_duplicates(docs: DataFrame, text: str = "text", shingle: int | None = None, similarity: float = 0.8) -> DataFrame:
    """doc_id, fp, component_id: the smallest id among all rows that links lead to.

    With ``shingle``, texts whose shingles of so many words have at least this Jaccard similarity are
    linked too (``jaccard``), however far apart their fingerprints are.
    """
    rows = materialize(fingerprints(docs, text), "fingerprints")
    classes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "fingerprint-classes")
    found = links(classes.select("fp"))
    if shingle:
        both = fingerprints(docs, text, keep=(text,))
        found = found.unionByName(jaccard.links(docs, both, shingle, similarity, DISTANCE, text))
    roots = components(found)
    joined = classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    named = materialize(joined.join(smallest, "root").select("fp", "component_id"), "fingerprint-components")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")
