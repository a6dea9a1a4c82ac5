import random

from test_simhash import plain_fingerprint

from parlance.llm import simhash


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_copies_by_words_beyond_four_bits_are_linked(spark, docs):
    rng, rows, copies = random.Random(3), [], 0
    texts = [r["text"] for r in docs.filter("length(text) between 600 and 6000").orderBy("doc_id").collect()]
    for k, text in enumerate(texts[:60]):
        words = [f"{w}{k}" for w in text.split()]
        share = rng.choice((0.006, 0.012, 0.018, 0.06))
        changed = [f"other{i}" if rng.random() < share else w for i, w in enumerate(words)]
        one, other = " ".join(words), " ".join(changed)
        a, b = shingles(one), shingles(other)
        near = len(a & b) >= 0.8 * len(a | b)
        apart = (plain_fingerprint(one) ^ plain_fingerprint(other)).bit_count() > 4
        if apart:
            copies += near
            rows += [(2 * k, one, near), (2 * k + 1, other, near)]
    assert copies > 5 and not all(r[2] for r in rows)
    df = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    kept = {r["doc_id"] for r in simhash.near_duplicates(df, shingle=5, similarity=0.8).collect() if r["doc_id"] == r["component_id"]}
    assert kept == {i for i, _, near in rows if i % 2 == 0 or not near}
