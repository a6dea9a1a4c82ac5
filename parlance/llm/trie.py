"""Prefix trie of conversations as a z-fast trie.

A conversation is a string of turns. Each of its prefixes has a 128-bit digest, chained from turn to
turn, so that equal digests are equal prefixes. The trie is a table of compacted nodes: where
conversations part or one of them ends. A node has its extent (the digest and depth of its prefix),
the edge that leads to it from the node above, and a handle: the digest at the two-fattest depth of
that edge, the depth divisible by the highest power of two. The handles are the hash table.

A conversation finds its exit node by fat binary search: it probes the handle at the two-fattest
depth of what is left of its length, goes on below the extent of a node that it hits and above the
depth of one that it misses; this takes as many probes as its length has bits. All conversations of
a batch search together, one equi-join a probe. They are then inserted together: edges that they
leave in the middle are cut, and their own new nodes are those prefixes beyond the exit where two of
them part or one ends. Batches grow by ``GROWTH``.

Equal conversations are one string with many members from the start, however many they are.
Measures of a node are sums and minima that combine before their exchange. The edges are expanded to
one row for each depth at last.

Nulls: a null ``turn`` sorts first, null role or text is empty, rows without conversation id belong to
none. Turns of equal number are ordered by their digest. Repeated rows are turns each. Texts are
read whole and once; only digests and word counts go on. One conversation's digests are one row.
A table without conversations has no nodes. Other columns of any name are not carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm.mixture import words_in
from parlance.session import materialize, shuffle_width

BATCHES = 3
GROWTH = 8
ROOT = hashlib.blake2b(b"", digest_size=16).digest()
IDS = 1024  # ids joined to one piece of text on the way to an ends digest
_STEPS = "array<struct<said:binary,words:bigint>>"
_NODES = "ext binary, up binary, top int, len int, edge array<binary>, words array<bigint>"


def turns_of(rows: DataFrame) -> DataFrame:
    """conv_id and the array of its turns (digest of role and text, words of the text) in order."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    said = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    narrow = rows.filter(F.col("conv_id").isNotNull()).select("conv_id", "turn", said.alias("said"), words_in(F.col("text")).alias("words"))
    listed = narrow.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "said", "words"))).alias("all"))
    return listed.select("conv_id", F.transform("all", lambda t: F.struct(t["said"].alias("said"), t["words"].alias("words"))).alias("turns"))


def with_shared_openings(turns: DataFrame, group: int = 20, kinds: int = 4) -> DataFrame:
    """Each conversation with its first crc32(id) % ``kinds`` turns taken from the one that heads its group."""
    heads = turns.filter(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("head"), F.slice("turns", 1, kinds - 1).alias("opening"))
    taken = (F.crc32(F.col("conv_id").cast("string")) % kinds).cast("int")
    opening = F.slice(F.coalesce("opening", F.array().cast(_STEPS)), F.lit(1), taken)
    own = F.slice("turns", taken + 1, F.size("turns"))
    joined = turns.withColumn("head", F.col("conv_id") - F.col("conv_id") % group).join(heads, "head", "left")
    return joined.select("conv_id", F.concat(opening, own).alias("turns"))


def paths_of(turns: DataFrame) -> DataFrame:
    """conv_id, end (digest of the whole), path (digests by depth), words (by depth)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, paths, words = [], [], []
            for steps in batch.column("turns").to_pylist():
                path, last = [], ROOT
                for step in steps:
                    last = hashlib.blake2b(last + step["said"], digest_size=16).digest()
                    path.append(last)
                ends.append(last)
                paths.append(path)
                words.append([step["words"] for step in steps])
            columns = [batch.column("conv_id"), pa.array(ends, pa.binary()), pa.array(paths, pa.list_(pa.binary())), pa.array(words, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "end", "path", "words"])

    return turns.mapInArrow(run, "conv_id long, end binary, path array<binary>, words array<bigint>")


def two_fattest(low: Column, high: Column) -> Column:
    """The number in (low, high] that the highest power of two divides; low < high."""
    bit = F.length(F.bin(low.bitwiseXOR(high).cast("long"))) - 1
    unit = F.pow(F.lit(2.0), bit).cast("int")
    return (high - high % unit).cast("int")


def locate(batch: DataFrame, nodes: DataFrame, probes: int) -> DataFrame:
    """Adds ``exit`` (extent of the node on whose edge the conversation leaves the trie, or null), its
    ``top`` and ``len``, and ``common``, the depth down to which the trie has the conversation."""
    size = F.size("path")
    handle = F.element_at("edge", two_fattest(F.col("top"), F.col("len")) - F.col("top"))
    table = nodes.select(handle.alias("probe"), F.col("ext").alias("hit"), F.col("top").alias("hit_top"), F.col("len").alias("hit_len"))
    at = batch.withColumn("low", F.lit(0)).withColumn("high", size)
    absent = F.concat("end", F.lit(b"-"))  # a key that no node has, other for each conversation
    for _ in range(probes):
        low, high, hit = F.col("low"), F.col("high"), F.col("hit").isNotNull()
        middle = F.when(low < high, two_fattest(low, high))
        probing = at.withColumn("middle", middle).withColumn("probe", F.coalesce(F.get("path", F.col("middle") - 1), absent))
        below = hit & (F.get("path", F.col("hit_len") - 1) == F.col("hit"))
        at = probing.join(table, "probe", "left").select(
            *batch.columns,
            F.when(below, F.col("hit_len")).when(hit, F.col("hit_top")).otherwise(low).alias("low"),
            F.when(below, high).when(hit, F.col("hit_top")).when(F.col("middle").isNotNull(), F.col("middle") - 1).otherwise(high).alias("high"),
        )
    # the node below the deepest extent met, where the next turn leads to one
    first = nodes.select(F.get("edge", F.lit(0)).alias("next"), F.col("ext").alias("exit"), "top", "len", "edge")
    found = at.withColumn("next", F.coalesce(F.get("path", F.col("low")), absent)).join(first, "next", "left")
    along = F.filter(F.zip_with("edge", F.slice("path", F.col("low") + 1, F.col("len") - F.col("low")), lambda a, b: a == b), lambda x: x)
    common = F.when(F.col("exit").isNotNull(), F.col("low") + F.size(along)).otherwise(F.col("low"))
    return found.select(*batch.columns, "exit", "top", "len", common.alias("common"))


def insert(located: DataFrame, nodes: DataFrame) -> DataFrame:
    """The trie with the located conversations in it: cut edges and new nodes."""
    inside = (F.col("common") > F.col("top")) & (F.col("common") < F.col("len"))
    cuts = located.filter(inside).groupBy("exit").agg(F.sort_array(F.collect_set("common")).alias("cuts"))
    whole = nodes.join(cuts, F.col("ext") == F.col("exit"), "left")
    bounds = F.concat(F.array("top"), F.coalesce("cuts", F.array().cast("array<int>")), F.array("len"))
    pairs = whole.withColumn("bounds", bounds).withColumn("k", F.explode(F.sequence(F.lit(0), F.size("bounds") - 2)))
    pieces = pairs.withColumn("from", F.get("bounds", F.col("k"))).withColumn("to", F.get("bounds", F.col("k") + 1))
    start, width = F.col("from") - F.col("top"), F.col("to") - F.col("from")
    pieces = pieces.select(
        F.get("edge", F.col("to") - F.col("top") - 1).alias("ext"), F.when(F.col("k") == 0, F.col("up")).otherwise(F.get("edge", start - 1)).alias("up"),
        F.col("from").alias("top"), F.col("to").alias("len"), F.slice("edge", start + 1, width).alias("edge"), F.slice("words", start + 1, width).alias("words"),
    )

    beyond = located.filter(F.col("common") < F.size("path"))
    depth = F.explode(F.sequence(F.col("common") + 1, F.size("path")))
    steps = beyond.select("least", "path", depth.alias("depth"))
    steps = steps.select("least", "depth", F.get("path", F.col("depth") - 1).alias("ext"), F.get("path", F.col("depth")).alias("next"))
    marks = [F.xxhash64("next"), F.xxhash64(F.lit(1), "next")]  # nulls hash alike, so ends are told by ``last``
    last = F.col("next").isNull()
    parted = steps.groupBy("ext").agg(
        F.max(last.cast("int")).alias("ends"), F.min("least").alias("first"),
        *[f(F.when(~last, m)).alias(f"{name}{k}") for k, m in enumerate(marks) for name, f in (("low", F.min), ("high", F.max))],
    )
    stops = parted.filter((F.col("ends") == 1) | (F.col("low0") != F.col("high0")) | (F.col("low1") != F.col("high1"))).select("ext", "first")
    # each new node is written by the first conversation through it, which knows the node above
    chains = steps.select("least", "depth", "ext").join(stops, "ext").groupBy("least")
    chains = chains.agg(F.sort_array(F.collect_list(F.struct("depth", (F.col("first") == F.col("least")).alias("mine")))).alias("stops"))
    told = beyond.join(chains, "least").withColumn("k", F.explode(F.sequence(F.lit(0), F.size("stops") - 1)))
    told = told.withColumn("to", F.get("stops", F.col("k"))["depth"]).withColumn("from", F.when(F.col("k") == 0, F.col("common")).otherwise(F.get("stops", F.col("k") - 1)["depth"]))
    mine, width = F.get("stops", F.col("k"))["mine"], F.col("to") - F.col("from")
    new = told.filter(mine).select(
        F.get("path", F.col("to") - 1).alias("ext"), F.when(F.col("from") == 0, F.lit(ROOT)).otherwise(F.get("path", F.col("from") - 1)).alias("up"),
        F.col("from").alias("top"), F.col("to").alias("len"), F.slice("path", F.col("from") + 1, width).alias("edge"), F.slice("words", F.col("from") + 1, width).alias("words"),
    )
    return pieces.unionByName(new)


def strings_of(paths: DataFrame) -> DataFrame:
    """One row for all equal conversations: end, n, the least conv_id, path and words."""
    equal = paths.groupBy("end").agg(F.count("*").alias("n"), F.min("conv_id").alias("least"))
    one = paths.select(F.col("conv_id").alias("least"), "path", "words")
    return equal.join(one, "least").select("end", "n", "least", "path", "words")


def build(strings: DataFrame, batches: int = BATCHES, growth: int = GROWTH) -> DataFrame:
    """The compacted nodes of the trie, but for the root, which has no edge."""
    longest = strings.agg(F.max(F.size("path"))).first()[0] or 0
    shares = [growth**k for k in range(batches)]
    slot = F.pmod(F.xxhash64("end"), F.lit(sum(shares)))
    nodes = strings.sparkSession.createDataFrame([], _NODES)
    for k in range(batches):
        batch = strings.filter((slot >= sum(shares[:k])) & (slot < sum(shares[: k + 1]))).select("end", "least", "path", "words")
        if k:
            located = locate(batch, nodes, longest.bit_length())
        else:  # nothing to search yet
            located = batch.select("*", F.lit(None).cast("binary").alias("exit"), F.lit(None).cast("int").alias("top"), F.lit(None).cast("int").alias("len"), F.lit(0).alias("common"))
        nodes = materialize(insert(materialize(located, f"located-{k}"), nodes), f"trie-{k}")
    return nodes


def _along(strings: DataFrame) -> DataFrame:
    """Each string once for every depth of its path, the root included."""
    depths = strings.withColumn("depth", F.explode(F.sequence(F.lit(0), F.size("path"))))
    return depths.withColumn("at", F.when(F.col("depth") == 0, F.lit(ROOT)).otherwise(F.get("path", F.col("depth") - 1)))


def _rest(depth: Column) -> Column:
    """Words from a depth on; the root has none of its own."""
    return F.aggregate(F.slice("words", F.greatest(depth, F.lit(1)), F.size("words")), F.lit(0).cast("long"), lambda a, w: a + w)


def ends_digests(paths: DataFrame) -> DataFrame:
    """end and the SHA-256 of the ids that end there, ascending and joined by commas.

    Ids are ranged and sorted over all tasks and joined in pieces of ``IDS``; the digest of an end then
    streams over its pieces, a thousandth of the rows, so a hot end is no burden on its task.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_end, ids = None, []
        out: list[tuple] = []
        for batch in batches:
            for end, conv in zip(batch.column("end").to_pylist(), batch.column("conv_id").to_pylist()):
                if end != held_end or len(ids) >= IDS:
                    if ids:
                        out.append((held_end, ids[0], ",".join(map(str, ids))))
                    held_end, ids = end, []
                ids.append(conv)
            if out:
                yield piece(out)
                out = []
        if ids:
            yield piece([(held_end, ids[0], ",".join(map(str, ids)))])

    def piece(out):
        ends, firsts, texts = zip(*out)
        return pa.RecordBatch.from_arrays([pa.array(ends, pa.binary()), pa.array(firsts, pa.int64()), pa.array(texts, pa.string())], names=["end", "first", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_end, state = None, None
        for batch in batches:
            done = []
            for end, ids in zip(batch.column("end").to_pylist(), batch.column("ids").to_pylist()):
                if end != held_end:
                    if state:
                        done.append((held_end, state.hexdigest()))
                    held_end, state = end, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
            if done:
                yield told(done)
        if state:
            yield told([(held_end, state.hexdigest())])

    def told(done):
        ends, sums = zip(*done)
        return pa.RecordBatch.from_arrays([pa.array(ends, pa.binary()), pa.array(sums, pa.string())], names=["end", "ends_sha256"])

    width = shuffle_width(paths.sparkSession)
    ranged = paths.select("end", "conv_id").repartitionByRange(width, "end", "conv_id").sortWithinPartitions("end", "conv_id")
    pieces = ranged.mapInArrow(join, "end binary, first long, ids string").repartition(width, "end").sortWithinPartitions("end", "first")
    return pieces.mapInArrow(digest, "end binary, ends_sha256 string")


def measures(strings: DataFrame, kids: DataFrame) -> DataFrame:
    """at (digest), n_convs, conv_id, n_leaves and saved of the prefixes of all strings.

    What a subtree saves is its members' words from there on, less the words of its distinct nodes.
    A node counts as its smallest member's, which then owns all the nodes below it on its path too.
    """
    marked = strings.join(kids, "end", "left").withColumn("leaf", F.col("n_children").isNull().cast("long")).drop("n_children")
    whole = _along(marked).groupBy("at", "depth").agg(
        F.sum("n").alias("n_convs"), F.min("least").alias("conv_id"), F.sum("leaf").alias("n_leaves"), F.sum(F.col("n") * _rest(F.col("depth"))).alias("told")
    )
    whole = materialize(whole, "members")
    owned = whole.groupBy(F.col("conv_id").alias("least")).agg(F.min("depth").alias("own"))
    distinct = _along(strings.join(owned, "least")).groupBy("at").agg(F.sum(_rest(F.greatest("depth", "own"))).alias("kept"))
    return whole.join(distinct, "at").select("at", "n_convs", "conv_id", "n_leaves", (F.col("told") - F.col("kept")).alias("saved"))


def expand(nodes: DataFrame, strings: DataFrame, paths: DataFrame) -> DataFrame:
    """One row for each node of the trie, compacted or not, with its measures."""
    kids = nodes.groupBy(F.col("up").alias("end")).agg(F.count("*").alias("n_children"))
    known = materialize(measures(strings, kids), "measures")
    ends = ends_digests(paths)
    empty = F.lit(hashlib.sha256().hexdigest())
    none = F.lit(0).cast("long")

    bottom = nodes.join(known.withColumnRenamed("at", "ext"), "ext").join(known.select(F.col("at").alias("up"), F.col("conv_id").alias("above")), "up")
    bottom = bottom.join(kids.withColumnRenamed("end", "ext"), "ext", "left").join(ends.withColumnRenamed("end", "ext"), "ext", "left")
    each = bottom.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("len") - F.col("top"))))
    width, is_last = F.col("len") - F.col("top"), F.col("k") == F.col("len") - F.col("top")
    between = F.aggregate(F.slice("words", F.col("k"), width - F.col("k")), none, lambda a, w: a + w)
    rows = each.select(
        "conv_id", (F.col("top") + F.col("k")).cast("long").alias("depth"), F.when(F.col("k") == 1, F.col("above")).otherwise(F.col("conv_id")).alias("parent_conv_id"), "n_convs",
        F.when(is_last, F.coalesce("n_children", none)).otherwise(F.lit(1).cast("long")).alias("n_children"), "n_leaves",
        (F.col("saved") + (F.col("n_convs") - 1) * between).alias("saved_tokens"), F.when(is_last, F.coalesce("ends_sha256", empty)).otherwise(empty).alias("ends_sha256"),
    )
    top = known.filter(F.col("at") == F.lit(ROOT)).withColumnRenamed("at", "end").join(kids, "end", "left").join(ends, "end", "left")
    root = top.select(
        "conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", F.coalesce("n_children", none).alias("n_children"), "n_leaves",
        F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", empty).alias("ends_sha256"),
    )
    return rows.unionByName(root)


def trie(turns: DataFrame, batches: int = BATCHES, growth: int = GROWTH) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node."""
    paths = materialize(paths_of(turns), "paths")
    strings = materialize(strings_of(paths), "strings")
    return expand(build(strings, batches, growth), strings, paths)
