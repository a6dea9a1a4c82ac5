import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.llm import lm, mixing


def tokens(text):
    return (text or "").encode().lower().split() + [b"\n"]


def learned(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 != 2


def condition():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 != 2, F.lit(False))


def test_base_counts_equal_brute_force_and_the_model_beats_them(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = {r["doc_id"]: r for r in lm.score(docs, condition()).collect()}
    counts = Counter(w for i, t in rows if learned(i) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    base = {i: sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens(t)) for i, t in rows}
    for i, t in rows:
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n)
        assert r["base_score"] == pytest.approx(base[i], rel=1e-9) and r["score"] < 0
    held = [i for i, _ in rows if not learned(i)]
    bits = -sum(got[i]["score"] for i in held) * math.log2(10) / sum(len(w) + 1 for i, t in rows if i in held for w in tokens(t))
    assert bits < 3.5  # eight without any model


def test_the_head_changes_no_score(spark, docs, monkeypatch):
    few = docs.filter("doc_id < 60")
    one = {r["doc_id"]: r for r in lm.score(few, condition()).collect()}
    monkeypatch.setattr(lm, "HEAD", 5)
    other = {r["doc_id"]: r for r in lm.score(few, condition()).collect()}
    for i, r in one.items():
        assert r["n_known"] == other[i]["n_known"]
        assert r["score"] == pytest.approx(other[i]["score"], rel=1e-6) and r["base_score"] == pytest.approx(other[i]["base_score"], rel=1e-9)


def test_odd_rows(spark, odd_docs, odd_texts, no_docs):
    scored = lm.score(odd_docs.withColumnRenamed("row__", "number"), condition(), keep=("number",)).collect()
    got = {r["number"]: r for r in scored}
    assert [got[k]["n_tokens"] for k in range(len(odd_texts))] == [len(tokens(t)) for t in odd_texts]
    assert all(np.isfinite(r["score"]) and r["score"] < 0 for r in scored)
    assert lm.score(no_docs, condition()).count() == 0
    blank = lm.score(odd_docs, F.lit(False)).collect()
    assert all(r["n_known"] == 0 and r["train_tokens"] == 0 and r["base_score"] == 0 for r in blank)
    assert blank[0]["bits_per_byte"] == pytest.approx(8.0, rel=1e-6)


def test_probabilities_of_all_continuations_add_up_to_one():
    table = np.zeros((2, mixing.SLOTS))
    keys, counts = [b"\x00the", b"\x00then", b"\x03\xc3\xa9t", b"\x00\n"], np.array([9, 2, 4, 3])
    mixing.tally(keys, counts, table)
    model = mixing.Model(table)
    model.learn(keys, counts)
    # each bit's two ways add up to one, so sixteen ways of the first four bits do too
    total = 0.0
    seen = mixing.Decisions([b"\x00" + bytes([b]) for b in range(256) if b not in (0x0A,)])
    first = np.searchsorted(seen.owner, np.arange(255))
    odds, gate = model.inputs(seen, False)
    mixed = model.mixed(odds, gate)[first]
    p = mixing.squash(mixed)
    picked = np.where(seen.bit[first] > 0, p, 1 - p).prod(axis=1)
    lone = mixing.Decisions([b"\x00\n"])
    odds, gate = model.inputs(lone, False)
    p = mixing.squash(model.mixed(odds, gate))[0]
    total = picked.sum() + np.where(lone.bit[0] > 0, p, 1 - p).prod()
    assert total == pytest.approx(1.0, abs=1e-5)


def plain_places(text):
    """(six bytes before, byte, state) of every place of a text, token by token."""
    back, state, out = b"\0" * 5 + b" ", 0, []
    low = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in (text or "").encode())
    for w in [*low.split(), None]:
        for b in b"\n" if w is None else w + b" ":
            out.append((back, b, state))
            back = back[1:] + bytes([b])
        state = next((1 + (b & 15) for b in reversed(w or b"") if b >= 0x80), state)
    return out


def test_counts_of_all_predictors_equal_brute_force_across_tokens(spark, docs, odd_texts, monkeypatch):
    monkeypatch.setattr(lm, "RANGE", 3000)  # contexts that lie in several ranges
    rows = [(r["doc_id"], r["text"]) for r in docs.filter("doc_id < 12").select("doc_id", "text").collect()]
    rows += [(100 + k, t) for k, t in enumerate(odd_texts[:8]) if k != 4]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    learn, met = Counter(), Counter(p for _, t in rows for p in plain_places(t))
    for i, t in rows:
        if learned(i):
            learn.update(plain_places(t))
    got = lm.place_contexts(lm.place_counts(df, condition())).toArrow()
    keys = lm.unsigned(got.column("place").combine_chunks())
    assert len(keys) == len(met)
    sums = [Counter() for _ in mixing.PREDICTORS]
    for (back, b, state), n in learn.items():
        for c, (order, with_state) in zip(sums, mixing.PREDICTORS):
            for bits in range(9):
                c[back[6 - order :], state if with_state else None, bits, b >> (8 - bits)] += n
    codes = np.frombuffer(b"".join(got.column("codes").to_pylist()), np.uint16)
    seen = mixing.Contexts(keys, codes)
    same, other = seen.counts(None)
    for k, (key, n, m) in enumerate(zip(keys.tolist(), got.column("n").to_pylist(), got.column("met").to_pylist())):
        raw = key.to_bytes(8, "big")
        back, b, state = raw[5::-1], raw[6], raw[7]
        assert (n, m) == (learn[back, b, state], met[back, b, state])
        for i, (order, with_state) in enumerate(mixing.PREDICTORS):
            at = lambda bits: sums[i][back[6 - order :], state if with_state else None, bits, b >> (8 - bits)]
            assert same[i, k].tolist() == pytest.approx([at(bits + 1) for bits in range(8)], rel=0.004)
            assert other[i, k].tolist() == pytest.approx([at(bits) - at(bits + 1) for bits in range(8)], rel=0.004)


def test_the_order_of_words_counts(spark, docs):
    text = "the red fox runs over the old bridge at night " * 3
    more = spark.createDataFrame([(0, text), (1, text), (2, text), (900, text), (901, " ".join(sorted(text.split())))], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in lm.score(more, F.col("doc_id") < 3).collect()}
    assert got[900] > got[901] + 1


def test_no_count_saturates():
    counts = 10.0 ** np.arange(19)
    assert mixing.COUNT[mixing.packed(counts)] == pytest.approx(counts, rel=0.001)
