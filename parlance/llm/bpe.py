"""BPE encoding and decoding by forced boundaries.

A pair of neighbouring bytes that no vocabulary token contains marks a certain cut: no merge
ever crosses it. A text is cut there, equal fragments are encoded once, and the ids are put
side by side. A cut is taken only where the vocabulary's own pre-splitting cannot look across
it either: not inside a character, not after white space (a run of blanks is split by what
follows it) and not beside an apostrophe (contractions). What remains uncut is just a longer
fragment, so the ids are those of the whole text.

Nulls: a null text is encoded as an empty one and decodes to the empty text; null ids decode
to null. Empty tables give empty tables; repeated rows are encoded each; other columns are
left out unless named in ``keep``.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from parlance.llm import common
from parlance.llm.fragments import coder, letter_bytes

_TABLES: dict[str, object] = {}


def vocabulary(path: str) -> list[bytes]:
    """Bytes of each token by id, added tokens included."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    of = letter_bytes()
    tokens = {i: bytes(of[c] for c in t) for t, i in spec["model"]["vocab"].items()}
    tokens |= {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
    return [tokens.get(i, b"") for i in range(max(tokens) + 1)]


def cut_pairs(tokens: list[bytes]) -> np.ndarray:
    """256 x 256: may the text be cut between these two bytes?"""
    free = np.ones((256, 256), dtype=bool)
    for token in tokens:
        pair = np.frombuffer(token, dtype=np.uint8)
        free[pair[:-1], pair[1:]] = False
    blank = [0x20, *range(0x09, 0x0E), *range(0x1C, 0x20), ord("'")]
    free[blank, :] = False
    free[:, ord("'")] = False
    free[:, 0x80:0xC0] = False  # inside a character
    return free


def cuts(data: np.ndarray, free: np.ndarray) -> np.ndarray:
    """Positions at which a new fragment certainly starts."""
    if len(data) < 2:
        return np.zeros(0, np.int64)
    cut = free[data[:-1], data[1:]]
    # white space beyond ASCII ends in bytes that letters end in too: only letters of two bytes are told apart
    wide = data[:-1] >= 0x80
    lead = np.zeros(len(data) - 1, dtype=bool)
    lead[1:] = (data[:-2] >= 0xC3) & (data[:-2] <= 0xDF)
    return np.flatnonzero(cut & (~wide | lead)) + 1


def _free(path: str) -> np.ndarray:
    if ("free", path) not in _TABLES:
        _TABLES["free", path] = cut_pairs(vocabulary(path))
    return _TABLES["free", path]


def encode(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), out: str = "ids") -> DataFrame:
    """The ``keep`` columns and ``out``: the array of token ids of each whole text."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        find, free = coder(path).fragments.__getitem__, _free(path)
        data, offsets = common.text_bytes(part.column(text))
        raw = data.tobytes()
        edges = np.unique(np.concatenate([offsets, cuts(data, free)]))
        limits = edges.tolist()
        pieces = [raw[a:b] for a, b in zip(limits, limits[1:])]
        where = np.searchsorted(edges, offsets).tolist()
        ids = [b"".join(map(find, pieces[a:b])) for a, b in zip(where, where[1:])]
        counts = [len(x) // 4 for x in ids]
        column = common.lists(np.frombuffer(b"".join(ids), dtype="<i4"), np.array(counts), pa.int32())
        return pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], column], names=[*keep, out])

    narrow = common.pick(docs, *keep, text)
    return common.map_slices(narrow, run, _schema(narrow, keep, f"`{out}` array<int>"), text)


def decode(tokens: DataFrame, path: str, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",), out: str = "text") -> DataFrame:
    """The ``keep`` columns and ``out``: the text of each array of ids, special tokens included.

    Bytes that are no UTF-8 are replaced, as the tokenizer's own decoder does.
    """

    def run(batches):
        if ("words", path) not in _TABLES:
            _TABLES["words", path] = vocabulary(path)
        words = _TABLES["words", path]
        for part in batches:
            column = part.column(ids)
            offsets, values = column.offsets.to_numpy(), column.values.to_numpy()
            missing = column.is_null().to_pylist()
            texts = []
            for a, b, none in zip(offsets[:-1].tolist(), offsets[1:].tolist(), missing):
                texts.append(None if none else b"".join([words[i] for i in values[a:b].tolist()]).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.array(texts, pa.string())], names=[*keep, out])

    narrow = common.pick(tokens, *keep, ids)
    return narrow.mapInArrow(run, _schema(narrow, keep, f"`{out}` string"))


def _schema(df: DataFrame, keep: tuple[str, ...], more: str) -> str:
    kinds = dict(df.dtypes)
    return ", ".join([*[f"`{c}` {kinds[c]}" for c in keep], more])
