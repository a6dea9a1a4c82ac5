"""Mixing sources to target weights by pivotal dependent rounding. DataFrame expressions only.

Sources, by code point with null last, weigh ``WEIGHTS`` in turn and share ``SHARE`` times all
sizes by weight. A target stops at ``MOST`` times its source's size; what is too much is shared
again by weight until no target is above. A document of a source is wanted ``target / source
size`` times: its whole copies are certain, the rest is a probability.

Rounding. Two fractional documents of one source meet: mass, counted in words, moves from one to
the other in a direction drawn so that both expectations stay, until one of them is integral. It
is decided, the other goes on. A node of the tree does so with some ``FAN`` documents, large ones
first, and hands on the one that is left; nodes of a level work side by side, and their residuals
meet in the next level's nodes. So a source's words change only when its very last residual is
rounded, by less than one copy of one document.

Draws are hashes of the two documents' ids, so reruns agree whatever the partitioning. Nodes are
picked by a hash of the id within the source: a hot source just has more nodes.

Nulls: a null text has size 0; a null source is a source, the last one; null ids are ids. Sizes of
0 are taken 0 times. Rows that repeat (same source, id and size) are rounded each. Empty tables
give empty tables. Other columns are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from parlance.session import materialize, shuffle_width

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
FAN = 64  # documents that meet in one node of the tree
CHUNK = 4096  # repeats of one row are numbered in chunks
BROADCAST_SOURCES = 100_000  # some 10 MB; more sources are joined by salted keys
SALTS = 16
_POSITION = (1 << 33) - 1


def words_in(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def sizes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """source, doc_id, size and how often that row occurs, written once: texts are read here only."""
    rows = docs.select(F.col(f"`{source}`").alias("source"), F.col(f"`{doc_id}`").alias("doc_id"), words_in(F.col(f"`{text}`")).alias("size"))
    return materialize(rows.groupBy("source", "doc_id", "size").agg(F.count("*").alias("times")), "sizes")


def source_targets(sized: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, n_docs, source_size and target of every source, written once.

    Sources are numbered by the places of a range-sorted table, and the level at which targets stop
    is found by a few sums over them; only those sums reach the driver.
    """
    totals = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("times")).alias("source_size"), F.sum("times").alias("n_docs"))
    width = shuffle_width(sized.sparkSession)
    ordered = totals.repartitionByRange(width, F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last())
    placed = materialize(ordered.withColumn("place", F.monotonically_increasing_id()), "sources")
    part = F.shiftright("place", 33)
    starts = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"))  # one row a partition
    starts = starts.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("start"))
    rank = F.col("start") + F.col("place").bitwiseAND(F.lit(_POSITION))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    weighed = placed.withColumn("part", part).join(F.broadcast(starts), "part").select("source", "n_docs", "source_size", weight.alias("weight"))
    weighed = materialize(weighed, "weighed")

    cap, wish = F.col("source_size") * F.lit(most), lambda level: F.col("weight") * F.lit(level)
    whole = weighed.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    mass = share * (whole["size"] or 0)
    level, stopped = mass / whole["weight"] if whole["weight"] else 0.0, 0
    while True:
        over = wish(level) > cap
        got = weighed.agg(F.sum(over.cast("long")).alias("n"), F.sum(F.when(over, cap)).alias("held"), F.sum(F.when(~over, F.col("weight"))).alias("free")).first()
        if not got["n"] or got["n"] == stopped or not got["free"]:
            break
        level, stopped = (mass - got["held"]) / got["free"], got["n"]
    return materialize(weighed.select("source", "n_docs", "source_size", F.least(wish(level), cap).alias("target")), "targets")


def with_targets(rows: DataFrame, targets: DataFrame, few: int = BROADCAST_SOURCES) -> DataFrame:
    """Rows with their source's columns: by broadcast up to ``few`` sources, else by salted keys."""
    same = F.col("rows.source").eqNullSafe(F.col("targets.source"))
    if targets.count() <= few:
        joined = rows.alias("rows").join(F.broadcast(targets).alias("targets"), same)
    else:
        salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "size"), F.lit(SALTS)))
        spread = targets.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        joined = salted.alias("rows").join(spread.alias("targets"), same & (F.col("rows.salt") == F.col("targets.salt")))
    return joined.select("rows.*", *[F.col(f"targets.{c}") for c in targets.columns if c != "source"]).drop("salt")


def draw(seed: int, *ids: Column) -> Column:
    """A number in [0, 1) from a hash."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *ids), 11) / float(1 << 53)


def _pivot(state: Column, x: Column, seed: int) -> Column:
    """The carried document meets ``x``: who is decided, and who is carried on.

    ``rise`` words can move to the carried one and ``fall`` words from it before one of the two is
    integral; which of them is follows from the term that set the limit, so no rounding error is met.
    """
    c = state["carry"]
    to_full, of_x = (1 - c["p"]) * c["size"], x["p"] * x["size"]
    of_c, x_full = c["p"] * c["size"], (1 - x["p"]) * x["size"]
    rise, fall = F.least(to_full, of_x), F.least(of_c, x_full)
    up = draw(seed, c["doc_id"], c["copy"], x["doc_id"], x["copy"]) * (rise + fall) < fall
    p_c = F.when(up, F.when(to_full <= of_x, F.lit(1.0)).otherwise(c["p"] + rise / c["size"])).otherwise(F.when(of_c <= x_full, F.lit(0.0)).otherwise(c["p"] - fall / c["size"]))
    p_x = F.when(up, F.when(of_x <= to_full, F.lit(0.0)).otherwise(x["p"] - rise / x["size"])).otherwise(F.when(x_full <= of_c, F.lit(1.0)).otherwise(x["p"] + fall / x["size"]))
    item = lambda d, p: F.struct(d["low"].alias("low"), d["doc_id"].alias("doc_id"), d["copy"].alias("copy"), d["size"].alias("size"), p.alias("p"))
    new_c, new_x = item(c, p_c), item(x, p_x)
    ended = lambda d: (d["p"] <= 0) | (d["p"] >= 1)
    pair = F.array(new_c, new_x)
    met = F.struct(F.get(F.filter(pair, lambda d: ~ended(d)), F.lit(0)).alias("carry"), F.concat(state["done"], F.filter(pair, ended)).alias("done"))
    return F.when(c.isNull(), F.struct(x.alias("carry"), state["done"].alias("done"))).otherwise(met)


def _level(items: DataFrame, seed: int, kind: str) -> DataFrame:
    """One level of the tree: source, node, the residual ``carry`` and the decided documents ``done``."""
    item = f"struct<low:bigint,doc_id:{kind},copy:bigint,size:bigint,p:double>"
    start = F.struct(F.lit(None).cast(item).alias("carry"), F.array().cast(f"array<{item}>").alias("done"))
    gathered = items.groupBy("source", "node").agg(F.sort_array(F.collect_list(F.struct((-F.col("size")).alias("low"), "doc_id", "copy", "size", "p"))).alias("items"))
    folded = gathered.withColumn("met", F.aggregate("items", start.cast(f"struct<carry:{item},done:array<{item}>>"), lambda s, x: _pivot(s, x, seed)))
    return folded.select("source", "node", "met.carry", "met.done")


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 42, fan: int = FAN, few: int = BROADCAST_SOURCES, **rule) -> DataFrame:
    """doc_id, size, source, source_size, target, copies and taken of every document."""
    sized = sizes(docs, doc_id, text, source)
    targets = source_targets(sized, **rule)
    wanted = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    chunks = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("times") - 1) / CHUNK)))
    inside = F.explode(F.sequence(F.col("chunk") * CHUNK, F.least(F.col("times"), (F.col("chunk") + 1) * CHUNK) - 1))
    each = sized.withColumn("chunk", chunks).withColumn("copy", inside).select("source", "doc_id", "size", "copy")
    rows = with_targets(each, targets, few).withColumn("whole", F.floor(wanted)).withColumn("p", wanted - F.col("whole"))
    open_ = (F.col("size") > 0) & (F.col("p") > 0)
    nodes = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("n_docs") / fan))
    node = F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id", "copy"), nodes)
    kind = dict(sized.dtypes)["doc_id"]

    items = rows.filter(open_).select("source", node.alias("node"), "doc_id", "copy", "size", "p")
    decided = rows.filter(~open_).select("source", "doc_id", "size", F.lit(0).alias("more"))
    width, depth = targets.agg(F.max("n_docs")).first()[0] or 0, 0
    while True:
        level = materialize(_level(items, seed + depth, kind), f"level-{depth}")
        done = level.select("source", F.explode("done").alias("d"))
        decided = decided.unionByName(done.select("source", "d.doc_id", "d.size", (F.col("d.p") >= 1).cast("int").alias("more")))
        left = level.filter(F.col("carry").isNotNull())
        width, depth = -(-width // fan), depth + 1
        if width <= 1:  # one node a source: its residual is rounded alone
            break
        items = left.select("source", F.expr(f"node div {fan}").alias("node"), "carry.doc_id", "carry.copy", "carry.size", "carry.p")
    last = draw(seed + depth, F.col("carry.doc_id"), F.col("carry.copy")) < F.col("carry.p")
    decided = decided.unionByName(left.select("source", "carry.doc_id", "carry.size", last.cast("int").alias("more")))
    copies = (F.floor(wanted) + F.col("more")).cast("long")
    whole = with_targets(decided, targets, few).withColumn("copies", copies)
    return whole.select("doc_id", "size", "source", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
