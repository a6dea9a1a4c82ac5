import numpy as np
from pyspark.sql import functions as F

from parlance.llm import toxicity


def made(seed, n):
    """Insults make a text toxic; in the learning texts group names stand beside insults more often than not."""
    rng = np.random.default_rng(seed)
    plain, insults, groups = [f"wort{i}" for i in range(200)], ["idiot", "scum", "moronic"], ["women", "muslims", "jews"]
    docs, labels = [], []
    for i in range(n):
        words = list(rng.choice(plain, 25))
        toxic = int(rng.random() < 0.4)
        if toxic:
            words[3] = str(rng.choice(insults))
        if rng.random() < (0.7 if toxic else 0.05):
            words[7] = str(rng.choice(groups))
        docs.append((i, " ".join(words)))
        labels.append((i, toxic))
    return docs, labels


def frames(spark, docs, labels):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_the_penalty_keeps_neutral_mentions_low(spark):
    docs, labels = frames(spark, *made(1, 600))
    neutral = spark.createDataFrame([(k, f"wort5 wort9 {g} wort11 wort40") for k, g in enumerate(["women", "muslims", "jews"])], "doc_id long, text string")
    plain = spark.createDataFrame([(0, "wort5 wort9 wort11 wort40")], "doc_id long, text string")
    shift = {}
    for penalty in (0.0, toxicity.LAMBDA):
        model = toxicity.train(docs, labels, penalty=penalty)
        mentions = np.array([r["score"] for r in toxicity.score(neutral, model).orderBy("doc_id").collect()])
        shift[penalty] = mentions.max() - mentions.min(), mentions.mean() - toxicity.score(plain, model).first()["score"]
        insulted = toxicity.score(spark.createDataFrame([(1, "wort5 scum wort11")], "doc_id long, text string"), model).first()["score"]
        assert insulted > 0.5
    assert shift[toxicity.LAMBDA][0] <= 0.1 * shift[0.0][0]  # the terms' scores come together
    assert abs(shift[toxicity.LAMBDA][1]) <= 0.5 * abs(shift[0.0][1])  # and closer to no term at all


def test_swaps_change_only_the_group_term():
    line = toxicity.IDENTITY[0]
    chosen = np.unique(np.concatenate([toxicity.features_of(t) for terms in toxicity.IDENTITY for t in terms]))
    row = np.searchsorted(chosen, toxicity.features_of("women"))
    pairs = toxicity.swaps([row], chosen)
    assert len(pairs) == len(line) - 1 and all(len(a) and len(b) for a, b in pairs)


def test_held_out_accuracy_and_inflected_forms(spark):
    docs, labels = frames(spark, *made(2, 900))
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = toxicity.train(docs, labels.filter(~held))
    out = toxicity.score(docs.filter(held), model).join(labels, "doc_id")
    assert out.filter((F.col("score") >= 0.5).cast("int") == F.col("toxic")).count() >= 0.97 * out.count()
    form = spark.createDataFrame([(1, "wort5 Idiotisch, wort11")], "doc_id long, text string")
    assert toxicity.score(form, model).first()["score"] >= 0.5


def test_odd_rows(spark, odd_docs, no_docs):
    docs, labels = frames(spark, *made(3, 200))
    holes = labels.unionByName(spark.createDataFrame([(None, 1), (5, None), (6, 1), (6, 0)], "doc_id long, toxic int"))
    model = toxicity.train(docs, holes)
    rows = toxicity.score(odd_docs, model).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.score(no_docs, model).count() == 0
    nothing = toxicity.train(docs, labels.limit(0))
    assert all(r["score"] < 0.5 for r in toxicity.score(odd_docs, nothing).collect())


def test_the_sample_is_bounded(spark):
    docs, labels = frames(spark, *made(4, 600))
    assert 60 <= toxicity.fit_sample(docs, labels, 100).count() <= 140
