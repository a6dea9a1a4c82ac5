from collections import Counter

import pytest
from pyspark.sql import functions as F

from parlance.llm import langid


def plain_grams(text):
    """n-grams of one to three letters, ends of words counted as ``_``."""
    low = (text or "").lower()
    letters = "".join(c if langid.letter_table()[ord(c)] else " " for c in low)
    out = Counter()
    for word in letters.split():
        edged = f"_{word}_"
        for n in (1, 2, 3):
            for i in range(len(edged) - n + 1):
                g = edged[i : i + n]
                if g != "_":
                    out[g] += 1
    return out


def code(gram):
    points = [1 if c == "_" else ord(c) + 1 for c in gram]
    return sum(p << (21 * i) for i, p in enumerate(points))


TEXTS = ["Hello, World! a", "", None, "x", "Été à l'ÉCOLE", "123 456", "日本語 テキスト", "İstanbul ǅ", "a-b_c d'e"]


def test_grams_equal_a_plain_reading():
    found, letters = langid.codes(TEXTS)
    for text, got, has in zip(TEXTS, found, letters):
        assert Counter(got.tolist()) == Counter({code(g): n for g, n in plain_grams(text).items()}), text
        assert bool(has) == any(c.isalpha() for c in (text or "").lower())


def test_profiles_and_distances_equal_brute_force(spark, docs):
    rows = docs.select("doc_id", "text", "lang").collect()
    totals = {}
    for r in rows:
        totals.setdefault(r["lang"], Counter()).update({code(g): n for g, n in plain_grams(r["text"]).items()})
    profiles = {lang: {g: k for k, (g, _) in enumerate(sorted(c.items(), key=lambda x: (-x[1], x[0]))[: langid.PROFILE])} for lang, c in totals.items()}
    learned = langid.learn(docs)
    assert {(r["lang"], r["place"], r["gram"]) for r in learned.collect()} == {(lang, k, g) for lang, p in profiles.items() for g, k in p.items()}
    got = {r["doc_id"]: r for r in langid.predict(docs, learned).collect()}
    for r in rows:
        own = sorted(((code(g), n) for g, n in plain_grams(r["text"]).items()), key=lambda x: (-x[1], x[0]))[: langid.PROFILE]
        far = {lang: sum(abs(p[g] - k) if g in p else langid.PROFILE for k, (g, _) in enumerate(own)) for lang, p in profiles.items()}
        best, second = sorted(far.items(), key=lambda x: (x[1], x[0]))[:2]
        assert got[r["doc_id"]]["lang_pred"] == best[0]
        assert got[r["doc_id"]]["score"] == pytest.approx((second[1] - best[1]) / second[1])


def test_held_out_accuracy(spark, docs):
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    out = langid.predict(docs.filter(held), langid.learn(docs.filter(~held)), keep=("doc_id", "lang"))
    assert out.filter("lang = lang_pred").count() >= 0.97 * out.count()


def test_odd_rows(spark, odd_docs, no_docs, docs):
    out = langid.predict(odd_docs, langid.learn(docs), keep=("row__", "text")).collect()
    assert len(out) == odd_docs.count()
    for r in out:
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in r["text"] or "")) and 0 <= r["score"] <= 1
    assert langid.predict(no_docs, langid.learn(docs)).count() == 0
    assert {r["lang_pred"] for r in langid.predict(odd_docs, langid.learn(no_docs)).collect()} == {"und"}
