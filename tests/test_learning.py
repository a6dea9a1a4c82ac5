import math
from collections import Counter, defaultdict

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from parlance.operators import annotate as an, evaluate, fusion, scoring, selection, split, svm, tfidf
from parlance.operators.space import FeatureSpace, prepare
from parlance.plans import workflows as wf
from parlance.functions import ngrams

TEXTS = ["Le  chat\n\ndort", "le chien dort 😀😀 ici", "LE CHAT MANGE", "", "a", "chat-chien_x 42 été été"]


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", F.col("lang").alias("label"))


def grams(text, block):
    low, high = block.ngrams
    if block.analyzer == "char":
        import re

        text = re.sub(r"\s\s+", " ", text.lower())
        return [text[i : i + n] for n in range(low, high + 1) for i in range(len(text) - n + 1)]
    import regex

    words = regex.findall(r"[\p{L}\p{N}_]{2,}", text.lower())
    return [" ".join(words[i : i + n]) for n in range(low, high + 1) for i in range(len(words) - n + 1)]


def tfidf_by_hand(block):
    counts = [Counter(grams(t, block)) for t in TEXTS]
    df, tf = Counter(), Counter()
    for c in counts:
        df.update(c.keys())
        tf.update(c)
    terms = [t for t in df if df[t] >= block.min_df]
    if block.max_features:
        terms = sorted(terms, key=lambda t: (-tf[t], t))[: block.max_features]
    idf = {t: math.log((1 + len(TEXTS)) / (1 + df[t])) + 1 for t in terms}
    out = {}
    for k, c in enumerate(counts):
        w = {t: (1 + math.log(n) if block.sublinear else n) * idf[t] for t, n in c.items() if t in idf}
        norm = math.sqrt(sum(v * v for v in w.values()))
        out.update({(k, t): v / norm for t, v in w.items()})
    return out


BLOCKS = [
    tfidf.CHAR_1_9, tfidf.CHAR_3_6, tfidf.WORD_1_2,
    tfidf.Block("few", "char", (2, 3), max_features=7, sublinear=True),
    tfidf.Block("raw", "word", (1, 3)),
]


@pytest.mark.parametrize("block", BLOCKS, ids=lambda b: b.name)
@pytest.mark.parametrize("small", [False, True])
def test_weights(corpus, monkeypatch, block, small):
    """``small`` forces many pieces per text and the head-and-tail vocabulary join."""
    if small:
        monkeypatch.setattr(ngrams, "PIECE_CHARS", 4)
        monkeypatch.setattr(tfidf, "BROADCAST_TERMS", 3)
        monkeypatch.setattr(tfidf, "HEAD_TERMS", 2)
    rows = tfidf.weights(corpus, tfidf.fit_block(corpus, block)).collect()
    expected = tfidf_by_hand(block)
    assert {(r["doc_id"], r["term"]) for r in rows} == set(expected)
    for r in rows:
        assert r["weight"] == pytest.approx(expected[r["doc_id"], r["term"]])


def test_a_long_vocabulary_is_met_by_one_listing(corpus, monkeypatch):
    fitted = tfidf.fit_block(corpus, tfidf.CHAR_3_6)
    lists = lambda: tfidf.raw_weights(corpus, fitted)._jdf.queryExecution().executedPlan().toString().count("Generate explode")
    short = lists()
    monkeypatch.setattr(tfidf, "BROADCAST_TERMS", 3)
    monkeypatch.setattr(tfidf, "HEAD_TERMS", 2)
    assert lists() == short > 0


def test_vectors_have_unit_rows_and_keep_empty_texts(corpus):
    fitted = tfidf.fit_block(corpus, tfidf.CHAR_1_9)
    vectors = tfidf.to_vectors(corpus, [tfidf.block_items(corpus, fitted, 0, 1.0)], fitted.dimension)
    squared = F.aggregate(vector_to_array("features"), F.lit(0.0), lambda a, v: a + v * v)
    got = {r[0]: r[1] for r in vectors.select("doc_id", squared).collect()}
    assert len(got) == len(TEXTS) and got[3] == 0.0
    assert fitted.vocabulary.select("idx").distinct().count() == fitted.size


def test_merged_columns_give_the_same_inner_products(docs):
    """Terms with equal training columns share one position, and no product of rows changes."""
    sample = docs.where("length(text) < 600")
    train = sample.where("doc_id % 4 <> 0")
    plain = tfidf.fit_block(train, tfidf.CHAR_1_9)
    merged = tfidf.fit_block(train, tfidf.CHAR_1_9, merge=True)
    assert merged.dimension < plain.dimension == plain.size == merged.size

    def rows(fitted):
        vectors = tfidf.to_vectors(sample, [tfidf.block_items(sample, fitted, 0, 1.0)], fitted.dimension)
        return {r["doc_id"]: dict(zip(r["features"].indices, r["features"].values)) for r in vectors.collect()}

    a, b = rows(plain), rows(merged)
    ids = sorted(a)
    fit_ids = {r[0] for r in train.select("doc_id").collect()}
    for i in ids[:12]:
        for j in ids:
            if j not in fit_ids:
                continue
            dot = lambda m: sum(v * m[j].get(k, 0.0) for k, v in m[i].items())
            assert dot(a) == pytest.approx(dot(b), abs=1e-9)


@pytest.mark.parametrize("n,share", [(10, 0.2), (97, 0.15), (1000, 0.2), (7, 0.5)])
def test_split_is_exact_and_repeatable(spark, n, share):
    df = spark.range(n).select("id", F.expr("CASE WHEN id % 3 = 0 THEN 'a' WHEN id % 7 < 5 THEN 'b' ELSE 'c' END").alias("y"))
    rows = split.stratified_split(df, "id", "y", share).collect()
    assert len(rows) == n and sum(r["is_test"] for r in rows) == math.ceil(n * share)
    total, test = Counter(r["y"] for r in rows), Counter(r["y"] for r in rows if r["is_test"])
    for label, size in total.items():
        assert abs(test[label] - size * math.ceil(n * share) / n) < 1
    again = split.stratified_split(df.repartition(5), "id", "y", share).collect()
    assert {r["id"]: r["is_test"] for r in rows} == {r["id"]: r["is_test"] for r in again}
    other = split.stratified_split(df, "id", "y", share, seed=1).collect()
    assert n < 50 or {r["id"] for r in rows if r["is_test"]} != {r["id"] for r in other if r["is_test"]}


@pytest.mark.parametrize("n,k", [(3, 5), (100, 5), (501, 3), (6000, 4)])
def test_folds_are_balanced(spark, n, k):
    df = spark.range(n).select("id", F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("y"))
    rows = split.stratified_folds(df, "id", "y", k).collect()
    assert len({r["id"] for r in rows}) == n == len(rows)
    sizes = defaultdict(Counter)
    for r in rows:
        assert 0 <= r["fold"] < k
        sizes[r["y"]][r["fold"]] += 1
    for label, per_fold in sizes.items():
        counts = [per_fold[f] for f in range(k)]
        assert max(counts) - min(counts) <= 1


def test_weight_of_an_absent_class_is_zero(spark):
    train = spark.createDataFrame([("a",), ("a",), ("b",)], "y string")
    every = spark.createDataFrame([("a",), ("b",), ("c",)], "y string")
    got = split.with_class_weight(every, split.class_weights(train, "y"), "y")
    assert {r["y"]: r["weight"] for r in got.collect()} == {"a": 0.75, "b": 1.5, "c": 0.0}


def test_class_never_predicted(spark):
    df = spark.createDataFrame([("a", "a"), ("b", "a")], "true_label string, predicted_label string")
    rows = {r["langue"]: r for r in evaluate.per_class(df, labels=["a", "b", "c"]).collect()}
    assert (rows["b"]["precision"], rows["b"]["recall"], rows["b"]["f1"], rows["b"]["support"]) == (0, 0, 0, 1)
    assert rows["c"]["support"] == 0
    table = [tuple(r) for r in evaluate.confusion(df, ["a", "b", "c"]).collect()]
    assert table == [("a", 1, 0, 0), ("b", 1, 0, 0), ("c", 0, 0, 0)]


def test_metrics_round_half_to_even(spark):
    classes = spark.createDataFrame([("a", 0.0625, 0.1875, 0.5, 1)], "langue string, precision double, recall double, f1 double, support long")
    row = evaluate.metrics_table(classes).where("langue = 'a'").first()
    assert (row["precision"], row["recall"]) == (0.062, 0.188)


def accuracy(run):
    return evaluate.accuracy(run.predictions, "label").first()[0]


def test_char_svm_beats_the_majority(docs):
    block = tfidf.Block("short", "char", (1, 3), min_df=2, sublinear=True)
    run = wf.char_svm(docs, block=block)
    assert run.predictions.count() == 40 and accuracy(run) > 0.9


def test_feature_svm_and_folds(docs):
    prepared = prepare(an.annotate_lite(docs))
    space = FeatureSpace(["word_tfidf", "pos"])
    scores = selection.fold_scores(prepared, space, [svm.SvmParams(C=1.0), svm.SvmParams(C=0.01)], k=2)
    assert scores.count() == 4
    ranked = selection.grid_scores(scores).collect()
    assert ranked[0]["mean"] >= ranked[1]["mean"] > 0.2 and ranked[0]["mean"] > 0.7


@pytest.mark.parametrize("name,penalties", [("M4_grid_scores", 5), ("M4_tuned_feature_svm", 5), ("M5_A10_fold_scores", 1)])
def test_fold_queries_run_all_blocks_on_five_folds(spark, sf, monkeypatch, name, penalties):
    from parlance.functions import lexicon as lx
    from parlance.plans import catalog

    class Met(Exception):
        pass

    def stop(prepared, space, params, k=5, *more, **named):
        raise Met(space.blocks, len(params), k)

    monkeypatch.setattr(selection, "fold_scores", stop)
    with pytest.raises(Met) as met:
        catalog.QUERIES[name](spark, sf)
    assert met.value.args == (list(lx.BLOCK_WEIGHTS), penalties, 5) and len(lx.BLOCK_WEIGHTS) == 7


def test_pair_votes_go_to_the_first_label_on_ties(spark):
    from pyspark.ml.linalg import Vectors

    rows = [("a", Vectors.dense([1.0, 0.0])), ("b", Vectors.dense([0.0, 1.0])), ("c", Vectors.dense([-1.0, -1.0]))] * 5
    df = spark.createDataFrame(rows, ["y", "features"]).coalesce(1)
    for fit in (svm.fit_one_vs_one, svm.fit_one_vs_rest):
        model = fit(df, "y", svm.SvmParams(C=10.0))
        assert model.predict(df).where("y = predicted_label").count() == 15
    two = svm.fit_one_vs_rest(df.where("y <> 'c'"), "y", svm.SvmParams(C=10.0))
    assert len(two.coefficients) == 1 and two.predict(df.where("y <> 'c'")).where("y = predicted_label").count() == 10


@pytest.mark.parametrize("groups,head", [(["articles", "passive"], "logistic"), ([], "logistic"), (["articles"], "mlp")])
def test_late_fusion(docs, groups, head):
    assert accuracy(wf.late_fusion(docs, groups, head=head)) > 0.7


def test_late_fusion_annotates_each_text_once(spark, docs):
    """The split, the scaler and the fit read stored rows, not the texts again."""
    seen = spark.sparkContext.accumulator(0)

    def count(text):
        seen.add(1)
        return text

    counted = F.udf(count, "string").asNondeterministic()
    run = wf.late_fusion(docs, ["articles"], head="logistic", annotator=lambda df: an.annotate_lite(df.withColumn("text", counted("text"))))
    assert run.predictions.count() == 40 and seen.value == docs.count() == 200


def test_unknown_head(docs):
    with pytest.raises(ValueError, match="unknown head"):
        fusion.fit_fusion(docs, [], head="other")


def test_scorer_sees_cut_texts_and_features(spark):
    df = spark.createDataFrame([(1, "a b c d", [1.0, 9.0]), (2, "b", [9.0, 1.0])], "id int, text string, f array<double>")

    def make():
        import numpy as np

        def predict(texts, features):
            assert all(len(t.split()) <= 2 for t in texts)
            return np.asarray(features, dtype="float32")

        return predict

    got = scoring.score(df, make, ["x", "y"], features="f", n_features=2, max_length=2)
    assert {r["id"]: r["predicted_label"] for r in got.collect()} == {1: "y", 2: "x"}


def test_model_tokens_are_those_of_a_plain_reading(spark):
    """Texts around the limit, batches of like length, special tokens counted, nulls empty."""
    texts = [" ".join(f"w{k}" for k in range(n)) for n in (0, 1, 5, 6, 7, 8, 40, 3)] * 5 + [None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").coalesce(2)

    def tokenizer():
        return lambda texts: [[10 + int(w[1:]) for w in t.split()] for t in texts], [1], [2, 3]

    def model():
        import numpy as np

        def predict(ids, mask):
            assert ids.shape == mask.shape and ids.shape[1] == mask.sum(axis=1).max() <= 9 and len(ids) <= 8
            assert (ids[~mask] == 0).all() and (ids[:, 0] == 1).all()
            total = (ids * mask).sum(axis=1)
            return np.stack([total % 3 == k for k in range(3)], axis=1).astype("float32")

        return predict

    got = {r["id"]: (r["n_model_tokens"], r["predicted_label"]) for r in scoring.score_tokens(df, tokenizer, model, ["x", "y", "z"], max_length=9, batch_size=8).collect()}
    for k, t in enumerate(texts):
        ids = [1, *[10 + int(w[1:]) for w in (t or "").split()][:6], 2, 3]
        assert got[k] == (len(ids), "xyz"[sum(ids) % 3])
    with pytest.raises(Exception, match="no room"):
        scoring.score_tokens(df, tokenizer, model, ["x", "y", "z"], max_length=2).collect()


def test_a_saved_run_is_the_run(spark, docs, tmp_path):
    """Fit, save, read back: the record has the fit's own seconds and the scores of its predictions."""
    from parlance.sources import sinks

    run = wf.char_svm(docs, block=tfidf.Block("short", "char", (1, 2), min_df=2, sublinear=True))
    config = sinks.run_config(spark, "corpus.csv", "camembert", [], [], ["de", "en"], test_size=0.2)
    folder = wf.save_run(run, docs, str(tmp_path), config, sinks.experiment_name("svm", []), stamp="20240102_030405")
    assert folder == f"{tmp_path}/svm_bert_only/20240102_030405"
    record = spark.read.json(f"{folder}/metrics.json").first()
    assert record["elapsed_seconds"] == pytest.approx(run.elapsed_seconds) and run.elapsed_seconds > 0.1
    saved = spark.read.csv(f"{folder}/predictions.csv", header=True, multiLine=True, escape='"')
    assert saved.count() == run.predictions.count() == 40
    assert saved.where("true_label = predicted_label").count() == round(40 * record["accuracy"]) == round(40 * accuracy(run))
    assert spark.read.json(f"{folder}/config.json").first()["test_size"] == 0.2


def test_row_local_work_on_a_stream(spark, sf, tmp_path):
    from parlance.functions.text import strip_tags
    from parlance.operators import features as ft
    from parlance.streaming import rowlocal

    source = tmp_path / "in"
    batch = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    batch.repartition(4).write.parquet(str(source))

    def row_local(df):
        cleaned = df.withColumn("text", strip_tags(F.col("text")))
        return ft.linguistic_features(an.annotate_lite(cleaned), ["articles", "readability"])

    stream = rowlocal.read_texts(spark, str(source), batch.schema, files_per_trigger=1)
    rowlocal.write_rows(stream, row_local, str(tmp_path / "out")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("doc_id").collect()
    assert got == row_local(batch).orderBy("doc_id").collect()


def test_batches_of_texts_count_like_rows(spark, monkeypatch):
    """Texts that share an owner, null owners, long owners and code points of any width; a task's terms leave it once."""
    monkeypatch.setattr(tfidf.gramcounts, "BATCH_CHARS", 60)
    rows = [(1, "abab aé"), (1, "ab \n 😀b"), (None, "aé"), (None, "É😀"), (2, None), (3, ""), (4, "ab" * 40), (5, "a İ")]
    rows += [(k, "même abab 😀") for k in range(10, 20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(1)
    block = tfidf.Block("short", "char", (1, 4))
    slow = tfidf.term_statistics(tfidf.term_counts(df, block), "doc_id")
    fast = tfidf.text_statistics(df, block, fingerprint=True)
    assert sorted(fast.collect()) == sorted(slow.collect())
    assert sorted(tfidf.text_statistics(df, block).collect()) == sorted(slow.select("term", "tf", "df").collect())

    part = [("abcabc" * 10)] * 4
    rows_out = sum(b.num_rows for b in tfidf.gramcounts.char_statistics(part, [0, 1, 2, 3], [(1, 2)] * 4, 3, 3, False))
    assert rows_out == 3


def test_batches_keep_owners_whole(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(tfidf.gramcounts, "BATCH_CHARS", 10)
    rows = [(None, "abcd"), (1, "abc"), (1, "abcd"), (1, "ab"), (2, "abcdefghij"), (3, "a")]
    batch = pa.RecordBatch.from_pydict({"doc_id": [r[0] for r in rows], "_text": [r[1] for r in rows], "_h1": [0] * 6, "_h2": [0] * 6})
    parts = list(tfidf.gramcounts.batches_of(iter([batch.slice(0, 3), batch.slice(3)]), "doc_id"))
    assert [p[0] for p in parts] == [["abcd"], ["abc", "abcd", "ab"], ["abcdefghij"], ["a"]]
    assert [p[1] for p in parts] == [[0], [0, 0, 0], [0], [0]]
