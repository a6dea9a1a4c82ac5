import numpy as np
import pytest

from parlance.llm import substring


def brute(rows):
    """(n_words, kept words) of each (doc_id, text)."""
    least = {}
    split = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in split:
        for k in range(len(w) - 49):
            if i is not None:
                key = tuple(w[k : k + 50])
                least[key] = min(least.get(key, i), i)
    out = []
    for i, w in split:
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if i is not None and least[tuple(w[k : k + 50])] < i:
                gone[k : k + 50] = [True] * 50
        out.append((len(w), b" ".join(x for x, g in zip(w, gone) if not g)))
    return out


def check(spark, rows):
    df = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, number long")
    got = substring.dedup(df).orderBy("number").collect()
    expected = brute(rows)
    for r, (i, t), (n, kept) in zip(got, rows, expected, strict=True):
        left = (r["text"] or "").encode().split()
        assert (r["n_words"], r["n_removed"], b" ".join(left)) == (n, n - len(left), kept)
        if r["n_removed"] == 0:
            assert r["text"] == t


def corpus(seed, n):
    rng = np.random.default_rng(seed)
    word = lambda size: [f"é{x}" for x in rng.integers(0, 400, size)]
    passages = [word(int(s)) for s in rng.integers(45, 120, 8)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.integers(0, 5)):
            parts += word(int(rng.integers(0, 60)))
            p = passages[rng.integers(0, len(passages))]
            a = int(rng.integers(0, 30))
            parts += p[a : a + int(rng.integers(20, 120))]
        rows.append((int(i), "\n".join(" ".join(parts[k : k + 13]) for k in range(0, len(parts), 13))))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(substring, "SHARD_PHRASES", 3)
    monkeypatch.setattr(substring, "SALT_ROWS", 2)
    rows = corpus(seed, 60)
    rows += [(100, rows[3][1]), (101, rows[3][1].replace("\n", " ")), (102, rows[4][1] + " " + rows[5][1]), (103, " ".join(["same"] * 300)), (104, " ".join(["same"] * 120)), (7, rows[8][1]), (9, rows[9][1])]
    rows += [(None, rows[5][1]), (None, rows[5][1]), (105, None), (106, ""), (107, " \n")]
    check(spark, rows)


def test_odd_rows(spark, odd_docs, no_docs):
    check(spark, [(r["doc_id"], r["text"]) for r in odd_docs.orderBy("row__").collect()])
    assert substring.dedup(no_docs).count() == 0 and substring.dedup(no_docs).columns == [*no_docs.columns, "n_words", "n_removed"]


def test_all_other_columns_are_kept(odd_docs):
    assert substring.dedup(odd_docs).columns == [*odd_docs.columns, "n_words", "n_removed"]
