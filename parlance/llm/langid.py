"""Language identification by rank order: the most frequent letter n-grams of a document are
compared with those of each language by how far each stands out of place.

n-grams have one to three letters and stay within a word, whose ends count as a letter. A
profile lists the ``PROFILE`` most frequent n-grams of all learning texts of a language, ties by
code point. A document's own list is as long; an n-gram at place i there and at place j in the
profile is ``|i - j|`` out of place, one that the profile lacks ``PROFILE``. The language with the
least sum wins, ties by name. The score is the margin to the second, ``(d2 - d1) / d2``.

Nulls: texts that are null or have no letter, and all texts when nothing was learned, are
``und`` with score 0; null languages are not learned. Repeated rows count each; empty tables give
empty tables; other columns are not read.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from parlance.llm import common

PROFILE = 400
MAX_LANGUAGES = 5_000  # profiles are broadcast: 16 bytes for each of at most this many times PROFILE
FLUSH = 1_000_000  # n-gram counts a learning task holds before it hands them on
UNKNOWN = "und"
_LETTERS: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """By code point: 0 neither, 1 combining mark, 2 letter."""
    if not _LETTERS:
        kinds = {"L": 2, "M": 1}
        _LETTERS.append(np.array([kinds.get(unicodedata.category(chr(c))[0], 0) for c in range(0x110000)], dtype=np.uint8))
    return _LETTERS[0]


def codes(texts: list[str | None]) -> tuple[list[np.ndarray], np.ndarray]:
    """n-gram codes of each text, and whether it has a letter at all.

    A code holds up to three code points plus one in 21 bits each, 1 for the end of a word.
    """
    kind = letter_table()
    low = [t.lower() if t else "" for t in texts]
    points = np.frombuffer(" ".join(low).encode("utf-32-le", "replace") + b" \0\0\0", dtype=np.uint32)
    limits = np.cumsum([0] + [len(t) + 1 for t in low])
    inside = kind[points] > 0
    letters = np.add.reduceat(kind[points] == 2, limits[:-1]) > 0 if len(low) else np.zeros(0, bool)
    keep = inside.copy()
    keep[1:] |= inside[:-1]
    at = np.searchsorted(np.flatnonzero(keep), limits)
    seen = np.where(inside[keep], points[keep] + 1, 1).astype(np.uint64)
    n = len(seen)
    second, third = np.ones(n, np.uint64), np.ones(n, np.uint64)
    second[:-1], third[:-1] = seen[1:], 1
    third[:-2] = seen[2:]
    end = seen == 1
    pair, triple = seen | second << np.uint64(21), seen | second << np.uint64(21) | third << np.uint64(42)
    out = []
    previous_end = np.ones(n, bool)
    previous_end[1:] = end[:-1]
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if a == b:
            out.append(np.zeros(0, np.uint64))
            continue
        here, ends, starts = seen[a:b], end[a:b], previous_end[a:b]
        inner = ~ends
        begin = inner & starts
        first = here[begin] << np.uint64(21) | np.uint64(1)
        first3 = second[a:b][begin] << np.uint64(42) | here[begin] << np.uint64(21) | np.uint64(1)
        out.append(np.concatenate([here[inner], pair[a:b][inner], triple[a:b][inner & (second[a:b] != 1)], first, first3]))
    return out, letters


def counted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    values = np.sort(values)
    heads = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    return values[heads], np.diff(np.append(heads, len(values)))


def learn(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, place, gram: the profile of each language over all rows of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}

        def rows() -> pa.RecordBatch:
            names, grams, counts = [], [], []
            for name, parts in held.items():
                keys, where = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
                names += [name] * len(keys)
                grams.append(keys)
                counts.append(np.bincount(where, weights=np.concatenate([c for _, c in parts])).astype(np.int64))
            held.clear()
            return common.batch(lang=pa.array(names, pa.string()), gram=pa.array(np.concatenate(grams).astype(np.int64)), n=pa.array(np.concatenate(counts)))

        size = 0
        for whole in batches:
            for part in common.slices(whole, text):
                names = part.column(lang).to_pylist()
                found, _ = codes(part.column(text).to_pylist())
                for name in set(names):
                    keys, counts = counted(np.concatenate([f for f, m in zip(found, names) if m == name]))
                    held.setdefault(name, []).append((keys, counts))
                    size += len(keys)
                if size > FLUSH:
                    yield rows()
                    size = 0
        if held:
            yield rows()

    known = common.pick(docs, text, lang).filter(F.col(text).isNotNull() & F.col(lang).isNotNull())
    totals = known.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    ranked = totals.withColumn("place", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram")))
    return ranked.filter(F.col("place") <= PROFILE).select("lang", (F.col("place") - 1).alias("place"), "gram")


def predict(docs: DataFrame, profiles: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns, ``lang_pred`` and ``score``."""
    rows = profiles.limit(MAX_LANGUAGES * PROFILE + 1).toArrow()
    if rows.num_rows > MAX_LANGUAGES * PROFILE:
        raise ValueError(f"more than {MAX_LANGUAGES} languages: profiles would be too large to broadcast")
    names = sorted(set(rows.column("lang").to_pylist()))
    grams = np.unique(rows.column("gram").to_numpy())
    ranks = np.full((len(names), len(grams) + 1), -1, dtype=np.int32)
    index = {name: i for i, name in enumerate(names)}
    where = np.searchsorted(grams, rows.column("gram").to_numpy())
    ranks[[index[x] for x in rows.column("lang").to_pylist()], where] = rows.column("place").to_numpy()
    model = docs.sparkSession.sparkContext.broadcast((names, grams, ranks))

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        names, grams, ranks = model.value
        found, letters = codes(part.column(text).to_pylist())
        langs, scores = [], []
        for own, has in zip(found, letters.tolist()):
            if not has or not names:
                langs.append(UNKNOWN)
                scores.append(0.0)
                continue
            keys, counts = counted(own)
            top = keys[np.argsort(-counts, kind="stable")[:PROFILE]].astype(np.int64)
            at = np.searchsorted(grams, top)
            at[grams[np.minimum(at, len(grams) - 1)] != top] = len(grams)
            theirs = ranks[:, at]
            far = np.where(theirs < 0, PROFILE, np.abs(theirs - np.arange(len(top)))).sum(axis=1)
            order = np.argsort(far, kind="stable")[:2]
            best = int(far[order[0]])
            second = int(far[order[1]]) if len(order) > 1 else PROFILE * len(top)
            langs.append(names[order[0]])
            scores.append((second - best) / second if second else 0.0)
        return pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*keep, "lang_pred", "score"])

    narrow = common.pick(docs, *keep, text)
    kinds = dict(narrow.dtypes)
    return common.map_slices(narrow, run, ", ".join([*[f"`{c}` {kinds[c]}" for c in keep], "lang_pred string, score double"]), text)
