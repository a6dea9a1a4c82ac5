"""Language-model scores of whole texts, learned from a corpus.

Texts are tokens: lower-cased (A-Z) runs of anything but ASCII blanks, then one end. The corpus
gives a table of all distinct learning tokens with their counts, for the add-one unigram base, and
a table of all distinct places (``mixing``: a byte, the six before it, and the state) of all texts,
with how often each was learned. Both grow with the corpus.

The place table is sorted into ranges of contexts. There every predictor's counts are sums over
runs of neighbours, exact and without any hashing; the few contexts that lie in more than one range
are summed by Spark and handed to each. Weights take Newton steps on sums over all learned places,
the adaptive map follows in one more pass; neither depends on how tasks are cut. Each distinct place is then scored once, and a text is
the sum over all its places.

The most frequent tokens and places, lists of at most ``HEAD`` and ``8 * HEAD``, are scored within the
scan; only rarer ones are shuffled, once for each text they are in, and met with their tables.

Nulls: a null text is just the end; a null ``doc_id`` is scored and neither learned nor held
out. Repeated rows are learned and scored each. With nothing learned each bit has even odds and
the base counts nothing. Empty tables give empty tables. Other columns are not read.
"""

from __future__ import annotations

import copy
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm import common, mixing
from parlance.session import materialize, shuffle_width

HEAD = 1 << 18
FLUSH = 1_500_000  # distinct tokens or places a counting task holds
ROUNDS = 4  # steps of the weights
RANGE = 400_000  # places that are put side by side at once
ORDERS = sorted({order for order, _ in mixing.PREDICTORS})
WIDTH = 18 * len(mixing.PREDICTORS)  # bytes of a place's counts
_TOP = np.uint64(1 << 63)


def signed(keys: np.ndarray) -> np.ndarray:
    """Places as Spark's integers, in the same order."""
    return (keys ^ _TOP).view(np.int64)


def unsigned(column: pa.Array) -> np.ndarray:
    return column.to_numpy().astype(np.int64).view(np.uint64) ^ _TOP


class Tokens:
    """The tokens of a slice of texts; distinct ones and where they are; all places."""

    def __init__(self, column: pa.Array):
        data, self.offsets = common.text_bytes(column)
        self.low = common.LOWER[data]
        self.words = words = common.Words(self.low, self.offsets)
        self.raw = self.low.tobytes()
        self.owner = np.repeat(np.arange(len(column)), words.count)
        self.sizes = np.bincount(self.owner, words.end - words.start, len(column)).astype(np.int64) + words.count + 1

    def distinct(self) -> None:
        self.keys, self.one, self.where = np.unique(self.words.hashes(), return_index=True, return_inverse=True)

    def places(self) -> np.ndarray:
        """Every place of every text in order, ``sizes`` of them a text."""
        low, words = self.low, self.words
        # the last byte beyond ASCII before each word and before each end
        last = np.maximum.accumulate(np.where(low >= 0x80, np.arange(len(low)), -1)) if len(low) else np.zeros(0, np.int64)
        states = self._state(last, words.start, self.offsets[:-1][self.owner])
        end_states = self._state(last, self.offsets[1:], self.offsets[:-1])
        lengths = words.end - words.start
        before = np.cumsum(lengths + 1) - (lengths + 1)
        begin = np.cumsum(self.sizes + mixing.PAD) - self.sizes
        # texts and their words lie end to end: a word's place moves on by the ends and blank starts before it
        start = before + self.owner + (self.owner + 1) * mixing.PAD
        flat, state = np.zeros(int((self.sizes + mixing.PAD).sum()), np.uint8), np.zeros(int((self.sizes + mixing.PAD).sum()), np.uint8)
        real = np.ones(len(flat), bool)
        for back in range(1, mixing.PAD + 1):
            real[begin - back] = False
        inner = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(start, lengths)
        flat[inner], state[inner] = low[words._word], np.repeat(states, lengths)
        flat[start + lengths], state[start + lengths] = 0x20, states
        end = begin + self.sizes - 1
        flat[end], state[end] = mixing.END[0], end_states
        flat[begin - 1] = 0x20
        at = np.flatnonzero(real)
        return mixing.places(flat, state[at], at)

    def _state(self, last: np.ndarray, before: np.ndarray, begin: np.ndarray) -> np.ndarray:
        if not len(last):
            return np.zeros(len(before), np.int64)
        at = np.where(before > 0, last[np.maximum(before - 1, 0)], -1)
        return np.where(at >= begin, 1 + (self.words.data[np.maximum(at, 0)] & 15), 0).astype(np.int64)

    def spelled(self, chosen: np.ndarray) -> list[bytes]:
        """Bytes of the chosen distinct tokens."""
        word = self.one[chosen]
        return [self.raw[a:b] for a, b in zip(self.words.start[word].tolist(), self.words.end[word].tolist())]


def token_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """word, n: every distinct token of ``docs``, ends included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}

        def rows() -> pa.RecordBatch:
            out = common.batch(word=pa.array(list(held), pa.binary()), n=pa.array(list(held.values()), pa.int64()))
            held.clear()
            return out

        for whole in batches:
            for part in common.slices(whole, text):
                tokens = Tokens(part.column(text))
                tokens.distinct()
                counts = np.bincount(tokens.where, minlength=len(tokens.keys)).tolist()
                for word, n in zip(tokens.spelled(np.arange(len(tokens.keys))), counts):
                    held[word] = held.get(word, 0) + n
                held[mixing.END] = held.get(mixing.END, 0) + part.num_rows
                if len(held) > FLUSH:
                    yield rows()
        if held:
            yield rows()

    return common.pick(docs, text).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their rows of counts."""
    key, count = np.concatenate(keys), np.concatenate(counts)
    sort = np.argsort(key)
    key, count = key[sort], count[sort]
    heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[heads], np.add.reduceat(count, heads, axis=0)


def place_counts(docs: DataFrame, learned: Column, text: str = "text") -> DataFrame:
    """place, n, met: every distinct place of ``docs``, how often it is learned and how often met in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, size, floor = [], [], 0, 0

        def rows() -> pa.RecordBatch:
            return common.batch(place=pa.array(signed(keys[0])), n=pa.array(counts[0][:, 0]), met=pa.array(counts[0][:, 1]))

        for whole in batches:
            for part in common.slices(whole, text):
                tokens = Tokens(part.column(text))
                chosen = part.column("learn__").to_numpy(zero_copy_only=False)
                places, own = tokens.places(), np.repeat(chosen, tokens.sizes)
                for flag in (True, False):
                    found, n = np.unique(places[own == flag], return_counts=True)
                    keys.append(found)
                    counts.append(np.stack([n * flag, n], axis=1))
                    size += len(found)
                if size > 2 * floor + FLUSH:
                    one, sums = _added(keys, counts)
                    keys, counts, size, floor = [one], [sums], len(one), len(one)
                    if size > FLUSH:
                        yield rows()
                        keys, counts, size, floor = [], [], 0, 0
        if size:
            one, sums = _added(keys, counts)
            keys, counts = [one], [sums]
            yield rows()

    narrow = docs.select(F.col(f"`{text}`"), F.coalesce(learned, F.lit(False)).alias("learn__"))
    return narrow.mapInArrow(run, "place long, n long, met long").groupBy("place").agg(F.sum("n").alias("n"), F.sum("met").alias("met"))


def place_contexts(counts: DataFrame) -> DataFrame:
    """place, n, met, codes: the counts of all predictors of each place (``mixing.followers``), packed."""
    spark = counts.sparkSession
    parts = max(shuffle_width(spark), -(-counts.count() // RANGE))
    ranged = materialize(counts.repartitionByRange(parts, "place").withColumn("part", F.spark_partition_id()), "place-ranges")
    bounds = ranged.groupBy("part").agg(F.min("place").alias("low"), F.max("place").alias("high")).orderBy("part").toArrow().combine_chunks()
    low, high = unsigned(bounds.column("low")), unsigned(bounds.column("high"))
    # contexts that go on in the next range
    across = {o: np.unique(mixing.context_of(high[:-1], o)[mixing.context_of(high[:-1], o) == mixing.context_of(low[1:], o)]) for o in ORDERS}

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            key, n = unsigned(part.column("place")), part.column("n").to_numpy()
            for order in ORDERS:
                inside = np.flatnonzero(np.isin(mixing.context_of(key, order), across[order]) & (n > 0))
                if len(inside):
                    # what lies before the context does not matter
                    cut = key[inside] >> np.uint64(64 - 8 * order) << np.uint64(64 - 8 * order) | key[inside] & np.uint64(0xFFFF)
                    one, sums = _added([cut], [n[inside]])
                    yield common.batch(order=pa.array(np.full(len(one), order, np.int32)), place=pa.array(signed(one)), n=pa.array(sums))

    kind = "order int, place long, n long"
    found = ranged.select("place", "n").mapInArrow(shared, kind).groupBy("order", "place").agg(F.sum("n").alias("n")).toArrow().combine_chunks()
    of_order, cut, total = found.column("order").to_numpy(), unsigned(found.column("place")), found.column("n").to_numpy()
    sums = spark.sparkContext.broadcast({o: (cut[of_order == o], total[of_order == o]) for o in ORDERS})

    def side_by_side(table: pa.Table) -> pa.Table:
        key, n = unsigned(table.column("place")), table.column("n").to_numpy()
        ends = np.array([key.min(), key.max()])
        codes = np.empty((len(key), len(mixing.PREDICTORS), 9), np.uint16)
        for i, (order, with_state) in enumerate(mixing.PREDICTORS):
            open_ends = np.intersect1d(mixing.context_of(ends, order), across[order])
            whole_key, whole_n = sums.value[order]
            more = np.isin(mixing.context_of(whole_key, order), open_ends)
            own = np.where(np.isin(mixing.context_of(key, order), open_ends), 0, n)
            left = mixing.followers(np.concatenate([key, whole_key[more]]), np.concatenate([own, whole_n[more]]), order, with_state)
            codes[:, i] = mixing.packed(left[: len(key)])
        offsets = np.arange(len(key) + 1, dtype=np.int32) * WIDTH
        rows = pa.BinaryArray.from_buffers(pa.binary(), len(key), [None, pa.py_buffer(offsets), pa.py_buffer(codes)])
        return table.select(["place", "n", "met"]).append_column("codes", rows)

    return ranged.groupBy("part").applyInArrow(side_by_side, "place long, n long, met long, codes binary")


def _batches(part: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, mixing.Contexts]]:
    for start in range(0, part.num_rows, mixing.BATCH):
        some = part.slice(start, mixing.BATCH)
        codes = np.frombuffer(b"".join(some.column("codes").to_pylist()), np.uint16)
        yield some, mixing.Contexts(unsigned(some.column("place")), codes)


def fit(contexts: DataFrame) -> mixing.Model:
    """Newton steps on sums over all learned places, then the adaptive map in one more pass."""
    model, learned = mixing.Model(), contexts.filter(F.col("n") > 0)

    def summed(of: Callable[[mixing.Contexts, np.ndarray], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros(shape)
            for part in batches:
                for some, seen in _batches(part):
                    sums += of(seen, some.column("n").to_numpy())
            filled = np.flatnonzero(sums)
            yield common.batch(cell=pa.array(filled, pa.int32()), total=pa.array(sums.reshape(-1)[filled], pa.float64()))

        # as many rows as the model has numbers, however many tasks there are
        rows = learned.mapInArrow(run, "cell int, total double").groupBy("cell").agg(F.sum("total").alias("total")).toArrow()
        out = np.zeros(shape)
        out.reshape(-1)[rows.column("cell").to_numpy()] = rows.column("total").to_numpy()
        return out

    for _ in range(ROUNDS):
        now = copy.copy(model)
        model.step(summed(now.slopes, (mixing.GATES, mixing.SUMS)))
    now = copy.copy(model)
    model.map = summed(now.followed, model.map.shape)
    return model


def head_floor(counts: DataFrame, n: str, head: int) -> int:
    """Least count of a head row: the head has at most ``head`` rows."""
    ranked = counts.filter(F.col(n) > 1).groupBy(n).agg(F.count("*").alias("rows")).orderBy(F.desc(n))
    total, floor = 0, None
    for row in ranked.toLocalIterator():
        total += row["rows"]
        if total > head:
            break
        floor = row[n]
    return floor if floor is not None else 1 << 62


def looked_up(keys: np.ndarray, known: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys are known, and their values, else 0."""
    if not len(known):
        return np.zeros(len(keys), bool), np.zeros(len(keys), values.dtype)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    hit = known[at] == keys
    return hit, np.where(hit, values[at], 0)


def score(docs: DataFrame, learned: Column, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    ``learned`` tells the rows to learn from.
    """
    context = docs.sparkSession.sparkContext
    words = materialize(token_counts(docs.filter(learned), text), "token-counts")
    contexts = materialize(place_contexts(materialize(place_counts(docs, learned, text), "place-counts")), "place-contexts")
    model = context.broadcast(fit(contexts))

    def score_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for some, seen in _batches(part):
                yield common.batch(place=some.column("place"), met=some.column("met"), p=pa.array(model.value.log10(seen)))

    places = materialize(contexts.mapInArrow(score_places, "place long, met long, p double"), "place-scores")
    sizes = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    total, distinct = int(sizes["n"]), int(sizes["v"])
    ends = words.filter(F.col("word") == F.lit(mixing.END)).first()
    end_n = int(ends["n"]) if ends else 0

    spread = words.filter(F.col("word") != F.lit(mixing.END))
    head = spread.filter(F.col("n") >= head_floor(words, "n", HEAD)).toArrow()
    texts = pa.array([w.decode("utf-8") for w in head.column("word").to_pylist()], pa.string())
    listed = common.Words(*common.text_bytes(texts)).hashes()
    order = np.argsort(listed)
    top = places.filter(F.col("met") >= head_floor(places, "met", 8 * HEAD)).select("place", "p").toArrow()
    top_place = top.column("place").to_numpy()
    top_order = np.argsort(top_place)
    shared = context.broadcast((listed[order], head.column("n").to_numpy()[order], top_place[top_order], top.column("p").to_numpy()[top_order]))

    def tails(rows: int, owner: np.ndarray, where: np.ndarray, width: int, spelled) -> pa.Array:
        pairs, times = np.unique(owner * max(width, 1) + where, return_counts=True)
        values = pa.StructArray.from_arrays([spelled(pairs % max(width, 1)), pa.array(times, pa.int32())], names=["key", "times"])
        return common.lists_of(np.bincount(pairs // max(width, 1), minlength=rows), values)

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        known, known_n, known_place, known_p = shared.value
        tokens, rows = Tokens(part.column(text)), part.num_rows
        tokens.distinct()
        where, owner = tokens.where, tokens.owner
        hit, n = looked_up(tokens.keys, known, known_n)
        base = np.bincount(owner, np.log10(n + 1.0)[where], rows).astype(float)  # whole numbers where there are no words
        seen = np.bincount(owner, hit[where], rows)
        rare = ~hit[where]
        tail = tails(rows, owner[rare], where[rare], len(tokens.keys), lambda at: pa.array(tokens.spelled(at), pa.binary()))
        place, at = np.unique(signed(tokens.places()), return_inverse=True)
        text_of = np.repeat(np.arange(rows), tokens.sizes)
        hit, p = looked_up(place, known_place, known_p)
        value = np.bincount(text_of, p[at], rows).astype(float)
        rare = ~hit[at]
        place_tail = tails(rows, text_of[rare], at[rare], len(place), lambda at: pa.array(place[at], pa.int64()))
        return pa.RecordBatch.from_arrays(
            [
                *[part.column(c) for c in keep], pa.array(tokens.words.count + 1, pa.int64()), pa.array(tokens.sizes), pa.array(seen.astype(np.int64)), pa.array(base),
                pa.array(value), tail, place_tail,
            ],
            names=[*keep, "n_tokens", "size", "seen", "base", "value", "tail", "place_tail"],
        )

    narrow = common.pick(docs, *keep, text)
    kinds = dict(narrow.dtypes)
    kind = "n_tokens long, size long, seen long, base double, value double, tail array<struct<key:binary,times:int>>, place_tail array<struct<key:long,times:int>>"
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in keep], kind])
    rows = materialize(common.map_slices(narrow, run, schema, text).withColumn("row__", F.monotonically_increasing_id()), "token-tails")

    tail = rows.select("row__", F.explode("tail").alias("t")).select("row__", "t.times", F.col("t.key").alias("word"))
    sums = tail.join(words, "word", "left").groupBy("row__").agg(
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("more_seen"),
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 1.0)).alias("more_base"),
    )
    rest = rows.select("row__", F.explode("place_tail").alias("t")).select("row__", "t.times", F.col("t.key").alias("place"))
    values = rest.join(places, "place").groupBy("row__").agg(F.sum(F.col("times") * F.col("p")).alias("more_value"))
    whole = rows.drop("tail", "place_tail").join(sums, "row__", "left").join(values, "row__", "left")
    more = lambda c: F.coalesce(c, F.lit(0))
    value = F.col("value") + more("more_value")
    return whole.select(
        *[F.col(f"`{c}`") for c in keep],
        "n_tokens",
        (F.col("seen") + more("more_seen") + F.lit(int(end_n > 0))).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + more("more_base") + F.lit(math.log10(end_n + 1)) - F.col("n_tokens") * F.lit(math.log10(total + distinct + 1))).alias("base_score"),
        value.alias("score"),
        (-value * math.log2(10) / F.col("size")).alias("bits_per_byte"),
    )

