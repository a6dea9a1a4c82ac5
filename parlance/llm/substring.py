"""Substring dedup with repeated-phrase automata.

Words are runs of anything but ASCII blanks. A window is ``WINDOW`` consecutive words; a word
goes if some window over it also starts in a document with a smaller id.

1. Texts with the same words are one class. Copies of the class's least id lose all words that
   windows cover; only one text a class is looked at further.
2. Each window elects its least ``PHRASE``-word hash, so equal windows elect the same. A hash that
   documents of two ids elect marks a repeated phrase. Counts are combined before the shuffle.
3. The holder of a phrase, the least id, gives its wording; each class gives the stretches that
   its windows with repeated phrases cover. Both are dealt out to shards by the holder, so that a
   passage meets its phrases in one place. Busy shards are salted: phrases go to every salt.
4. Each shard compiles its phrases to one Aho-Corasick automaton over word numbers and streams
   its stretches through it. Every window around an occurrence is put out with 128 bits of hash.
5. The least id of each window, again combined before the shuffle, decides which starts go.

Nulls: a null text has no words; a null ``doc_id`` is smaller than none, so such a row neither
loses words nor costs others any. Equal ids are not smaller than each other, so repeated rows
stay whole or lose the same words. Empty tables give empty tables. A text shorter than a window
is never touched. Texts that lose nothing are returned as they are; else each word that stays is
kept with the blanks behind it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm import common
from parlance.session import materialize

WINDOW, PHRASE = 50, 10
SHARD_PHRASES = 50_000  # phrases of one automaton, on average
SALT_ROWS = 4_000  # stretches that one salt of a shard streams, on average
SLOTS = 1 << 18


def _words(column: pa.Array) -> tuple[common.Words, np.ndarray]:
    words = common.Words(*common.text_bytes(column))
    return words, words.hashes(0)


def _elected(words: common.Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all windows: start, number of windows of each text, elected phrase hash."""
    starts, count = common.run_starts(words.first, WINDOW)
    least = common.sliding_min(common.grams(hashes, PHRASE), WINDOW - PHRASE + 1)
    return starts, count, least[starts] if len(starts) else np.zeros(0, np.uint64)


def word_digest(text: bytes | None) -> bytes:
    """Digest of the words of a text, joined by one blank each."""
    return hashlib.sha256(b" ".join(text.split()) if text else b"").digest()


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_words, digest and the distinct elected phrase hashes of every row."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        column = part.column(text)
        words, hashes = _words(column)
        starts, count, elected = _elected(words, hashes)
        new = np.ones(len(elected), bool)
        new[1:] = (elected[1:] != elected[:-1]) | (starts[1:] != starts[:-1] + 1)
        owner = np.repeat(np.arange(part.num_rows), count)[new]
        phrases = common.lists(elected[new].view(np.int64), np.bincount(owner, minlength=part.num_rows), pa.int64())
        digests = [word_digest(t) for t in column.cast(pa.binary()).to_pylist()]
        return common.batch(doc_id=part.column("doc_id"), n_words=pa.array(words.count, pa.int64()), digest=pa.array(digests, pa.binary()), phrases=phrases)

    narrow = common.pick(docs, "doc_id", text)
    return common.map_slices(narrow, run, f"doc_id {dict(narrow.dtypes)['doc_id']}, n_words long, digest binary, phrases array<long>", text)


def repeated_phrases(classes: DataFrame) -> DataFrame:
    """phrase, holder: phrase hashes that classes of two ids elect, with the least id."""
    elected = classes.select("first", F.explode("phrases").alias("phrase"))
    counts = elected.groupBy("phrase").agg(F.min("first").alias("holder"), F.max("first").alias("last"))
    return counts.filter(F.col("holder") < F.col("last")).select("phrase", "holder")


def _slot(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(SLOTS)).cast("int")


def _slots(ids: DataFrame, doc_id: str) -> DataFrame:
    """At most ``SLOTS`` rows, whatever the input: small enough to broadcast."""
    return F.broadcast(ids.select(_slot(F.col(doc_id)).alias("slot__")).distinct())


def likely(docs: DataFrame, ids: DataFrame, doc_id: str) -> DataFrame:
    """Rows of ``docs`` that may be among ``ids``: thins out a join's large side in the scan."""
    return docs.withColumn("slot__", _slot(F.col("doc_id"))).join(_slots(ids, doc_id), "slot__", "left_semi").drop("slot__")


def unlikely(docs: DataFrame, ids: DataFrame, doc_id: str) -> DataFrame:
    """The other rows of ``docs``, null ids included."""
    return docs.withColumn("slot__", _slot(F.col("doc_id"))).join(_slots(ids, doc_id), "slot__", "left_anti").drop("slot__")


def stretches(docs: DataFrame, wanted: DataFrame, text: str = "text") -> DataFrame:
    """shard, phrase (or null), unit, first, at, text: phrase wordings and stretches of words.

    ``wanted``: unit, first, digest and marks, an array of (phrase, holder, shard).
    """
    kind = dict(wanted.dtypes)["first"]

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        column = part.column(text)
        raw = column.cast(pa.binary()).to_pylist()
        firsts, units, digests = part.column("first").to_pylist(), part.column("unit").to_pylist(), part.column("digest").to_pylist()
        marks = part.column("marks").to_pylist()
        words, hashes = _words(column)
        starts, count, elected = _elected(words, hashes)
        grams = common.grams(hashes, PHRASE)
        bounds = np.concatenate([[0], np.cumsum(count)])
        out: dict[str, list] = {k: [] for k in ("shard", "phrase", "unit", "first", "at", "text")}

        def put(shard: int, phrase: int | None, row: int, at: int, length: int) -> None:
            a, base = words.first[row] + at, words.offsets[row]
            own = words.start[a : a + length] - base, words.end[a : a + length] - base
            values = (shard, phrase, units[row], firsts[row], at, b" ".join([raw[row][x:y] for x, y in zip(own[0].tolist(), own[1].tolist())]).decode())
            for name, value in zip(out, values):
                out[name].append(value)

        for row in range(part.num_rows):
            if word_digest(raw[row]) != digests[row]:
                continue  # another text under the same id
            here = elected[bounds[row] : bounds[row + 1]]
            known = np.array([m["phrase"] for m in marks[row]], dtype=np.int64).view(np.uint64)
            order = np.argsort(known)
            known = known[order]
            shards = np.array([m["shard"] for m in marks[row]], dtype=np.int64)[order]
            where = np.minimum(np.searchsorted(known, here), len(known) - 1)
            shard = np.where(known[where] == here, shards[where], -1)
            turns = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1], [True]]))
            for a, b in zip(turns[:-1].tolist(), turns[1:].tolist()):
                if shard[a] >= 0:
                    put(int(shard[a]), None, row, a, b - a + WINDOW - 1)
            own = {m["phrase"]: m["shard"] for m in marks[row] if m["holder"] == firsts[row]}
            if own:
                of_row = grams[words.first[row] : words.first[row + 1] - PHRASE + 1].view(np.int64)
                wanted_now = np.array(sorted(own), dtype=np.int64)
                hit = np.minimum(np.searchsorted(wanted_now, of_row), len(wanted_now) - 1)
                for at in np.flatnonzero(wanted_now[hit] == of_row).tolist():
                    phrase = int(of_row[at])
                    if phrase in own:
                        put(own.pop(phrase), phrase, row, at, PHRASE)
        return common.batch(
            shard=pa.array(out["shard"], pa.int64()), phrase=pa.array(out["phrase"], pa.int64()), unit=pa.array(out["unit"], pa.int64()),
            first=pa.array(out["first"], part.column("first").type), at=pa.array(out["at"], pa.int32()), text=pa.array(out["text"], pa.string()),
        )

    near = likely(common.pick(docs, "doc_id", text), wanted, "first")
    joined = near.join(wanted, near["doc_id"] == wanted["first"]).select(text, "unit", "first", "digest", "marks")
    return common.map_slices(joined, run, f"shard long, phrase long, unit long, first {kind}, at int, text string", text)


class Automaton:
    """The phrases of one shard over the numbers of their words; other words are number 0."""

    def __init__(self, phrases: list[bytes]):
        self.numbers: dict[bytes, int] = {}
        self.tree = ahocorasick.Automaton(ahocorasick.STORE_LENGTH, ahocorasick.KEY_SEQUENCE)
        for phrase in phrases:
            self.tree.add_word(tuple(self.numbers.setdefault(w, len(self.numbers) + 1) for w in phrase.split()))
        self.tree.make_automaton()

    def ends(self, words: list[bytes]) -> list[int]:
        """Last word of every occurrence of any phrase."""
        number = self.numbers.get
        return [end for end, _ in self.tree.iter(tuple([number(w, 0) for w in words]))]


def locate(parts: DataFrame) -> DataFrame:
    """w1, w2, first, unit, at: every window of the stretches that holds a repeated phrase."""
    kind = dict(parts.dtypes)["first"]
    spark = parts.sparkSession
    sizes = parts.filter(F.col("phrase").isNull()).groupBy("shard").agg(F.ceil(F.count("*") / SALT_ROWS).cast("int").alias("salts"))
    salted = parts.join(sizes, "shard").select(
        "*", F.explode(F.when(F.col("phrase").isNull(), F.array(F.pmod(F.hash("unit", "at"), F.col("salts")))).otherwise(F.sequence(F.lit(0), F.col("salts") - 1))).alias("salt")
    )
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = salted.repartition(width, "shard", "salt").sortWithinPartitions("shard", "salt", F.col("phrase").isNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, phrases, tree = None, [], None
        for whole in batches:
            for part in common.slices(whole, "text"):
                column = part.column("text")
                texts = column.cast(pa.binary()).to_pylist()
                words, hashes = _words(column)
                marks = np.zeros(len(hashes) + 1, np.int64)
                for row, (shard, salt, phrase) in enumerate(zip(part.column("shard").to_pylist(), part.column("salt").to_pylist(), part.column("phrase").to_pylist())):
                    if key != (shard, salt):
                        key, phrases, tree = (shard, salt), [], None
                    if phrase is not None:
                        phrases.append(texts[row])
                        continue
                    if not phrases:
                        continue
                    tree = tree or Automaton(phrases)
                    first, last = int(words.first[row]), int(words.first[row + 1]) - WINDOW
                    for end in tree.ends(texts[row].split()):
                        marks[max(first, first + end - WINDOW + 1)] += 1
                        marks[max(min(last, first + end - PHRASE + 1), first - 1) + 1] -= 1
                at = np.flatnonzero(np.cumsum(marks[:-1]) > 0) if len(hashes) else np.zeros(0, np.int64)
                row = np.searchsorted(words.first, at, side="right") - 1
                fits = at + WINDOW <= words.first[row + 1]
                at, row = at[fits], row[fits]
                places = part.column("at").to_numpy()[row] + at - words.first[row]
                yield common.batch(
                    w1=pa.array(common.grams(hashes, WINDOW, 0)[at].view(np.int64)) if len(at) else pa.array([], pa.int64()),
                    w2=pa.array(common.grams(words.hashes(1), WINDOW, 1)[at].view(np.int64)) if len(at) else pa.array([], pa.int64()),
                    first=part.column("first").take(pa.array(row)), unit=part.column("unit").take(pa.array(row)), at=pa.array(places.astype(np.int32)),
                )

    return dealt.select("shard", "salt", "phrase", "unit", "first", "at", "text").mapInArrow(run, f"w1 long, w2 long, first {kind}, unit long, at int")


def removals(docs: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, spans): doc_id, n_words, digest, first of each row; unit spans by digest and first."""
    spark = docs.sparkSession
    rows = materialize(scan(docs, text), "substring-rows")
    grouped = rows.filter(F.col("doc_id").isNotNull() & (F.col("n_words") >= WINDOW)).groupBy("digest")
    # classes are written once, so that their numbers stay as they are
    classes = materialize(
        grouped.agg(F.min("doc_id").alias("first"), F.first("phrases").alias("phrases")).withColumn("unit", F.monotonically_increasing_id()), "substring-classes"
    )
    repeated = materialize(repeated_phrases(classes), "repeated-phrases")
    shards = max(1, -(-repeated.count() // SHARD_PHRASES), int(spark.conf.get("spark.sql.shuffle.partitions")))
    marked = classes.select("unit", "first", F.explode("phrases").alias("phrase")).distinct().join(repeated, "phrase")
    mark = F.struct("phrase", "holder", F.pmod(F.xxhash64("holder"), F.lit(shards)).alias("shard"))
    wanted = marked.groupBy("unit", "first").agg(F.collect_list(mark).alias("marks")).join(classes.select("unit", "digest"), "unit")
    wanted = materialize(wanted, "substring-wanted")
    windows = materialize(locate(materialize(stretches(docs, wanted, text), "substring-stretches")), "repeated-windows")
    least = windows.groupBy("w1", "w2").agg(F.min("first").alias("least"), F.max("first").alias("last")).filter(F.col("least") < F.col("last")).select("w1", "w2", "least")
    least = materialize(least, "repeated-window-owners")  # so that the join can split a window that very many documents share
    gone = windows.join(least, ["w1", "w2"]).filter(F.col("first") > F.col("least")).select("unit", "at")
    spans = gone.groupBy("unit").agg(F.array_sort(F.collect_set("at")).alias("starts"))
    return rows.drop("phrases").join(classes.select("digest", "first"), "digest", "left"), materialize(spans.join(classes.select("unit", "digest", "first"), "unit").drop("unit"), "substring-spans")


def cut(text: bytes, starts: np.ndarray) -> tuple[int, bytes]:
    """Number of words removed, and the text without them: a word goes with the blanks behind it."""
    words = common.Words(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    n = len(words.start)
    marks = np.zeros(n + 1, np.int64)
    np.add.at(marks, starts, 1)
    np.add.at(marks, starts + WINDOW, -1)
    gone = np.cumsum(marks[:-1]) > 0
    limits = np.append(words.start, len(text))
    turns = np.flatnonzero(np.concatenate([[True], gone[1:] != gone[:-1], [True]]))
    kept = [text[limits[a] : limits[b]] for a, b in zip(turns[:-1], turns[1:]) if not gone[a]]
    return int(gone.sum()), text[: limits[0]] + b"".join(kept)


def dedup(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of ``docs``, with the text that stays, and n_words and n_removed."""
    docs = docs.drop("n_words", "n_removed")
    kinds, names = dict(docs.dtypes), docs.columns
    decided, spans = removals(docs, text)
    copies = decided.filter((F.col("doc_id") > F.col("first")) & (F.col("n_words") >= WINDOW)).select("doc_id", "digest").distinct()
    # one row for each id and wording that loses words; null starts stand for all words
    losers = copies.withColumn("starts", F.lit(None).cast("array<int>")).unionByName(spans.select(F.col("first").alias("doc_id"), "digest", "starts"))
    losers = materialize(losers.groupBy("doc_id").agg(F.collect_list(F.struct("digest", "starts")).alias("cuts")), "substring-cuts")

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        texts, counts, removed = [], [], []
        for raw, cuts in zip(part.column(text).cast(pa.binary()).to_pylist(), part.column("cuts__").to_pylist()):
            n, gone, left = len(raw.split()) if raw else 0, 0, raw
            if cuts and raw:
                digest = word_digest(raw)
                for c in cuts:
                    if c["digest"] == digest:
                        gone, left = (n, b"") if c["starts"] is None else cut(raw, np.array(c["starts"], dtype=np.int64))
            texts.append(left)
            counts.append(n)
            removed.append(gone)
        columns = [pa.array(texts, pa.binary()).cast(pa.string()) if c == text else part.column(c) for c in names]
        return pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64()), pa.array(removed, pa.int64())], names=[*names, "n_words", "n_removed"])

    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in names], "n_words long, n_removed long"])
    none = F.lit(None).cast(dict(losers.dtypes)["cuts"])
    found = losers.select(F.col("doc_id").alias("id__"), F.col("cuts").alias("cuts__"))
    near = likely(docs, losers, "doc_id")
    with_cuts = near.join(found, near["doc_id"] == found["id__"], "left").drop("id__")
    return common.map_slices(unlikely(docs, losers, "doc_id").withColumn("cuts__", none).unionByName(with_cuts), run, schema, text)
