import random

import pytest

from parlance.functions import tokens as tk
from parlance.functions.tokencolumns import SEQUENCES
from parlance.operators import annotate as an, features as ft
from parlance.operators.space import prepare

WORDS = [
    "le", "de", "il", "que", "est", "a", "Chat", "CHATS", "chats", "mangé", "walked", "parlent", "chantez", "finir", "ÊTRE", "être", "joyeux",
    "IBM", "12", "\n", ",", ".", "!", "donc", "parce que", "ŒUVRE", "é", "ʰa", "²", "́x", "𝔘n", "İst", "Σας", "是", "was", "ont", "la",
]


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(7)
    rows = [(k, " ".join(rng.choices(WORDS, k=rng.choice([0, 1, 5, 40, 300])))) for k in range(120)]
    rows += [(3, "Le chat est mangé. IBM parle."), (3, None), (None, ""), (None, "il a walked !"), (500, " \t"), (501, "\n\n")]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def _sorted(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is not None, str(x)) for x in r))


@pytest.mark.parametrize("corrected", [(), tk.CORRECTED])
def test_measures_in_the_annotating_task_are_those_of_the_tokens(texts, corrected):
    names = {m: m for m in tk.measures()}
    keep = ["doc_id", "text"]
    slow = _sorted(ft._measured(an.annotate_lite(texts), names, "text", keep, corrected))
    fast = _sorted(ft._measured(texts, names, "text", keep, corrected, an.annotate_lite))
    assert len(slow) == len(fast) == 126
    for a, b in zip(slow, fast):
        assert a[:2] == b[:2]
        assert b[2:] == pytest.approx(a[2:], rel=1e-12, abs=1e-12)


def test_measured_texts_leave_their_tokens_in_the_task(texts):
    """One exchange with Python, and no column of tokens: the JVM's share was the larger one."""
    found = ft.linguistic_features(texts, annotator=an.annotate_lite)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "tokens" not in plan


def test_prepared_texts_are_the_same_either_way(texts):
    rows = texts.selectExpr("doc_id", "text", "'x' AS label")
    slow, fast = prepare(an.annotate_lite(rows)), prepare(rows, annotator=an.annotate_lite)
    assert slow.columns == fast.columns and slow.dtypes == fast.dtypes
    assert SEQUENCES == tuple(slow.columns[3:5])
    plain = lambda df: _sorted(df.selectExpr("doc_id", "text", "label", "pos_sequence", "dep_sequence", "transform(l1_numeric, x -> round(x, 9))", "transform(advanced, x -> round(x, 9))"))
    assert plain(slow) == plain(fast)


def test_a_token_s_word_rules():
    for word, pos in [("Ab", "NOUN"), ("AB", "PROPN"), ("ʰa", "NOUN"), ("²", "NUM"), ("́x", "NOUN"), ("\n\n", "SPACE"), ("?", "PUNCT"), ("𝔘𝔘", "PROPN")]:
        assert an._lite_pos(word, word.lower()) == pos
