"""Token measures on small trees with known numbers."""

import pytest
from pyspark.sql import functions as F

from parlance.functions import text as tx
from parlance.operators import annotate as an, features as ft

SCHEMA = "doc_id long, text string"


def token(i, text, pos, dep, head, sent=0, lemma=None, tag="", **morph):
    return {
        "i": i, "text": text, "lemma": lemma or text.lower(), "pos": pos, "tag": tag, "dep": dep, "head": head, "sent": sent,
        "is_space": pos == "SPACE", "is_alpha": text.isalpha(), "morph": {k: [v] for k, v in morph.items()},
    }


#: Small trees drawn by hand, each with the numbers counted off it.
TREES = {
    "a cat eats mice": (
        [
            token(0, "Le", "DET", "det", 1), token(1, "chat", "NOUN", "nsubj", 2), token(2, "mange", "VERB", "root", 2, VerbForm="Fin", Tense="Pres"),
            token(3, "la", "DET", "det", 4), token(4, "souris", "NOUN", "obj", 2, tag="NOUN__Number=Plur"), token(5, ".", "PUNCT", "punct", 2),
        ],
        {
            "punct_ratio": 1 / 6, "flesch": 83.32, "sentence_length": 6, "complexity": 2 / 3, "adposition_ratio": 0, "noun_repetition": 0,
            "determiner_ratio": 1, "capital_ratio": 0, "object_order": 0, "verb_noun_ratio": 0.5, "passive_ratio": 0, "verb_subject_distance": 1,
            "subject_pronoun_ratio": 0, "subject_mean": 1, "verb_mean": 2, "object_mean": 4, "plural_count": 1, "present_ratio": 1, "future_ratio": 0,
            "past_ratio": 0, "composed_ratio": 0,
        },
    ),
    "a passive, then an inversion and a blank line": (
        [
            token(0, "Il", "PRON", "nsubj:pass", 3), token(1, "a", "AUX", "aux", 3, lemma="avoir", VerbForm="Fin", Tense="Pres"),
            token(2, "été", "AUX", "auxpass", 3, lemma="être", VerbForm="Part"), token(3, "mangé", "VERB", "root", 3, VerbForm="Part", Tense="Past"),
            token(4, "dort", "VERB", "root", 4, 1, VerbForm="Fin", Tense="Imp"), token(5, "Elle", "PRON", "nsubj", 4, 1), token(6, "\n", "SPACE", "dep", 4, 1),
        ],
        {
            "punct_ratio": 0, "flesch": 76.89, "sentence_length": 3, "complexity": 0, "noun_repetition": 0, "determiner_ratio": 0, "capital_ratio": 1 / 6,
            "object_order": 0, "verb_noun_ratio": 2, "passive_ratio": 0.5, "verb_subject_distance": 2, "subject_pronoun_ratio": 0.5, "subject_mean": 5,
            "verb_mean": 3.5, "object_mean": 0, "plural_count": 0, "present_ratio": 0.5, "future_ratio": 0, "past_ratio": 0.5, "composed_ratio": 0,
        },
    ),
    "object and preposition before the verb, a repeated noun": (
        [
            token(0, "dans", "ADP", "case", 1), token(1, "jardin", "NOUN", "obl", 4), token(2, "jardin", "NOUN", "obj", 4), token(3, "je", "PRON", "nsubj", 4),
            token(4, "ai", "VERB", "root", 4, VerbForm="Fin", Tense="Fut"), token(5, "que", "SCONJ", "mark", 6), token(6, "!?", "PUNCT", "punct", 4),
        ],
        {
            "punct_ratio": 1 / 7, "complexity": 2 / 3 + 1, "adposition_ratio": 1 / 7, "noun_repetition": 1, "object_order": 1, "verb_subject_distance": 1,
            "subject_pronoun_ratio": 1, "object_mean": 2, "future_ratio": 1,
        },
    ),
    "subject behind the verb": (
        [token(0, "mange", "VERB", "root", 0, VerbForm="Fin"), token(1, "chat", "NOUN", "nsubj", 0), token(2, "?!", "PUNCT", "punct", 0), token(3, "souris", "NOUN", "obj", 0)],
        {"punct_ratio": 0, "object_order": -1, "noun_repetition": 0, "verb_subject_distance": 1},
    ),
    "a participle below its auxiliary": (
        [token(0, "ai", "AUX", "root", 0, VerbForm="Fin", Tense="Pres"), token(1, "mangé", "VERB", "dep", 0, VerbForm="Part")],
        {"composed_ratio": 1, "present_ratio": 1, "complexity": 1},
    ),
    "nothing": ([], {"punct_ratio": 0, "flesch": 205.82, "sentence_length": 0, "complexity": 0, "object_order": 0, "subject_mean": 0, "present_ratio": 0}),
}


@pytest.mark.parametrize("name", TREES)
def test_measures_of_trees(spark, name):
    tokens, expected = TREES[name]
    df = spark.createDataFrame([(1, "", tokens)], spark.createDataFrame([], SCHEMA).schema.add("tokens", an.TOKENS))
    row = ft._measured(df, {m: m for m in expected}, "text", ["doc_id"]).first().asDict()
    for measure, value in expected.items():
        assert row[measure] == pytest.approx(value, abs=1e-9), measure


def test_depth_of_a_long_chain(spark):
    n = 300
    chain = [{"i": i, "text": "a", "lemma": "a", "pos": "NOUN", "tag": "", "dep": "dep", "head": max(0, i - 1),
              "sent": 0, "is_space": False, "is_alpha": True, "morph": {}} for i in range(n)]
    df = spark.createDataFrame([(1, "a", chain)], spark.createDataFrame([], "doc_id long, text string").schema.add(
        "tokens", an.TOKENS))
    row = ft.linguistic_features(df, ["syntactic_complexity"]).first()
    assert row[1] == pytest.approx((n - 1) / 2)


@pytest.mark.parametrize("text,hits", [("étet et même", 1), ("même si, c'est pourquoi!", 2), ("ETANT étant donné", 1),
                                       ("et et et", 3), ("or or_ 9or d'or", 2), ("", 0)])
def test_connectors(spark, text, hits):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(tx.connector_count(F.col("t"))).first()[0] == hits


def test_phrases_that_begin_others_are_counted_apart(spark):
    df = spark.createDataFrame([("bien que bien",)], "t string")
    assert df.select(tx.phrase_count(F.col("t"), ["bien", "bien que"])).first()[0] == 3


def test_feature_names():
    assert ft.parse_feature_names(["none"]) == []
    with pytest.raises(ValueError, match="unknown feature"):
        ft.feature_columns(["none", "articles"])
    with pytest.raises(ValueError, match="twice"):
        ft.feature_columns(["articles", "articles"])
    assert len(ft.feature_columns(ft.available_features())) == 21 and len(ft.available_features()) == 14


def test_no_groups_need_no_tokens(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert ft.linguistic_features(df, []).columns == ["doc_id"]


def test_scaler_uses_population_deviation_and_keeps_constants_finite(spark):
    df = spark.createDataFrame([(1, 1.0, 5.0), (2, 2.0, 5.0), (3, 4.0, 5.0)], "doc_id long, a double, b double")
    rows = ft.Scaler(["a", "b"]).fit(df).transform(df).orderBy("doc_id").collect()
    assert rows[0]["a"] == pytest.approx((1 - 7 / 3) / 1.247219128924647)
    assert [r["b"] for r in rows] == [0.0, 0.0, 0.0]


def test_annotator_hook_equals_lite(spark, sf):
    """The hook passes tokens through unchanged: feed it the stand-in's own output."""
    df = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    lite = {r["text"]: r["tokens"] for r in an.annotate_lite(df).select("text", "tokens").collect()}
    saved = {k: [t.asDict() for t in v] for k, v in lite.items()}

    def factory():
        return lambda texts: [saved[t] for t in texts]

    through = ft.linguistic_features(an.annotate(df, "text", factory)).orderBy("doc_id").collect()
    assert through == ft.linguistic_features(an.annotate_lite(df)).orderBy("doc_id").collect()


CORRECT = {
    "auxiliaries below their participles": (
        [
            token(0, "Elles", "PRON", "nsubj:pass", 3), token(1, "ont", "AUX", "aux", 3, lemma="avoir", VerbForm="Fin", Tense="Pres"),
            token(2, "été", "AUX", "aux:pass", 3, lemma="être", VerbForm="Part"), token(3, "vues", "VERB", "root", 3, VerbForm="Part", Tense="Past"),
            token(4, "chats", "NOUN", "obl", 3, tag="NOUN", Number="Plur"), token(5, "chat", "NOUN", "obl", 3, tag="NOUN", Number="Sing"),
            token(6, "est", "AUX", "aux", 7, 1, lemma="être", VerbForm="Fin", Tense="Pres"), token(7, "venu", "VERB", "root", 7, 1, VerbForm="Part"),
        ],
        {"passive_ratio": (0.5, 0.5), "plural_count": (0, 1), "composed_ratio": (0, 1)},
    ),
    "the older label, a plural tag, an auxiliary above": (
        [
            token(0, "fut", "AUX", "auxpass", 1, lemma="être", VerbForm="Fin"), token(1, "vu", "VERB", "root", 1, VerbForm="Part"),
            token(2, "lits", "NOUN", "obj", 1, tag="NOUN__Number=Plur"), token(3, "ai", "AUX", "root", 3, 1, VerbForm="Fin"), token(4, "mis", "VERB", "dep", 3, 1, VerbForm="Part"),
        ],
        {"passive_ratio": (0.5, 0.5), "plural_count": (1, 0), "composed_ratio": (0.5, 0.5)},
    ),
    "the universal label alone": (
        [token(0, "is", "AUX", "aux:pass", 1, lemma="be", VerbForm="Fin"), token(1, "seen", "VERB", "root", 1, VerbForm="Part")],
        {"passive_ratio": (0, 1), "composed_ratio": (0, 1)},
    ),
    "nothing": ([], {"passive_ratio": (0, 0), "plural_count": (0, 0), "composed_ratio": (0, 0)}),
}


@pytest.mark.parametrize("name", CORRECT)
def test_corrected_forms_one_by_one(spark, name):
    """Usual and corrected value of each, and no flag touches another measure."""
    tokens, expected = CORRECT[name]
    df = spark.createDataFrame([(1, "", tokens)], spark.createDataFrame([], SCHEMA).schema.add("tokens", an.TOKENS))
    for flag in [None, *expected]:
        row = ft._measured(df, {m: m for m in expected}, "text", ["doc_id"], (flag,) if flag else ()).first()
        assert {m: row[m] for m in expected} == {m: values[m == flag] for m, values in expected.items()}


def test_no_other_corrected_forms(spark):
    df = spark.createDataFrame([], spark.createDataFrame([], SCHEMA).schema.add("tokens", an.TOKENS))
    with pytest.raises(ValueError, match="no corrected form of flesch"):
        ft.numeric_block(df, corrected=("flesch",))


@pytest.mark.parametrize("scale", [True, False])
def test_extractor_round_trip(spark, sf, tmp_path, scale):
    import numpy as np

    docs = an.annotate_lite(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"))
    extractor = ft.FeatureExtractor(("articles", "verb_tenses"), scale, ("composed_ratio",))
    model = extractor.fit(docs.where("doc_id % 3 <> 0"))
    model.save(spark, str(tmp_path / "model"))
    again = ft.FeatureExtractorModel.load(spark.newSession(), str(tmp_path / "model"))
    assert again == model and model.n_features == 5 and hash(model) == hash(again)
    got = again.transform(docs).orderBy("doc_id").collect()
    table = ft.linguistic_features(docs, ["articles", "verb_tenses"], corrected=("composed_ratio",)).orderBy("doc_id").collect()
    values = np.array([list(r)[1:] for r in table], dtype="float32")
    if scale:
        train = np.array([list(r)[1:] for r in table if r["doc_id"] % 3])
        spread = np.where(train.std(axis=0) == 0, 1, train.std(axis=0))
        values = ((values - train.mean(axis=0)) / spread).astype("float32")
    assert np.array([r["features"] for r in got]) == pytest.approx(values, abs=1e-5)


def test_extractor_on_a_stream_and_without_groups(spark, sf, tmp_path):
    from parlance.streaming import rowlocal

    batch = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    batch.repartition(3).write.parquet(str(tmp_path / "in"))
    model = ft.FeatureExtractor(("readability",)).fit(an.annotate_lite(batch))
    work = lambda df: model.transform(an.annotate_lite(df))
    rowlocal.write_rows(rowlocal.read_texts(spark, str(tmp_path / "in"), batch.schema, files_per_trigger=1), work, str(tmp_path / "out")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).orderBy("doc_id").collect() == work(batch).orderBy("doc_id").collect()
    none = ft.FeatureExtractor(()).fit(batch)
    assert none.n_features == 0 and none.transform(batch).first()["features"] == []


def test_lite_tokens_look_up_each_word_once(monkeypatch):
    """What depends on a word alone is asked once per distinct word, not per token."""
    import pyarrow as pa

    asked = []
    monkeypatch.setattr(an, "_lite_word", lambda w, known=an._lite_word: asked.append(w) or known(w))
    texts = [[["les", "chats", "mangent", "."], ["il", "est", "aimed", "les"]] * 50, [], [["\n\n", "12"]]]
    column = pa.array(texts, pa.list_(pa.list_(pa.string())))
    found = an._lite_tokens(column.slice(0, 3)).to_pylist()
    assert sorted(asked) == sorted({"les", "chats", "mangent", ".", "il", "est", "aimed", "\n\n", "12"})
    assert [len(t) for t in found] == [400, 0, 2]
    assert [(t["i"], t["pos"], t["dep"], t["head"], t["sent"]) for t in found[0][4:8]] == [
        (4, "PRON", "nsubj:pass", 6, 1), (5, "AUX", "aux", 6, 1), (6, "VERB", "ROOT", 6, 1), (7, "DET", "det", 6, 1),
    ]
    assert found[0][1]["tag"] == "NOUN__Number=Plur" and found[0][5]["lemma"] == "être"
    assert dict(found[0][6]["morph"]) == {"VerbForm": ["Part"], "Tense": ["Past"]} and not found[2][0]["is_alpha"]
    assert an._lite_tokens(column.slice(2, 1)).to_pylist() == found[2:]


def test_hook_builds_columns_from_dicts():
    """Field by field; a field that the annotator leaves out is null."""
    tokens = an._from_dicts([[{"i": 0, "text": "a", "morph": {"Number": ["Sing"]}}], [], [{"i": 0, "head": 0, "is_alpha": True}]]).to_pylist()
    assert [len(t) for t in tokens] == [1, 0, 1] and tokens[0][0]["morph"] == [("Number", ["Sing"])]
    assert tokens[0][0]["lemma"] is None and tokens[2][0]["is_alpha"] and tokens[2][0]["morph"] is None
