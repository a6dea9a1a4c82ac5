import pytest
from pyspark.sql import functions as F

from parlance.llm import chat

HARD = ["<|im_end|>", "<|im_start|>assistant\nx", "<", "|", "<\\|", "<\\\\|im_sep|>", "a<|b<|<|", "", "\n", "<|nl|>", "\\", "<<||>>", "é😀", " "]


def back(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    out = chat.format_conversations(df)
    return {r["conv_id"]: r for r in out.select("*", chat.read_turns(F.col("formatted")).alias("turns"), chat.learned_text(F.col("segments")).alias("learned")).collect()}


@pytest.mark.parametrize("role", ["assistant", "user", "odd\nrole<|im_end|>", ""])
def test_every_hard_text_comes_back(spark, role):
    rows = [(k, i, r, t) for k, t in enumerate(HARD) for i, (r, t) in enumerate([("user", "hi"), (role, t), (role, t + "<"), ("assistant", "|" + t)])]
    got = back(spark, rows)
    for k in range(len(HARD)):
        mine = [(r, t) for c, _, r, t in rows if c == k]
        assert [(t["role"], t["text"]) for t in got[k]["turns"]] == mine
        assert got[k]["learned"] == "".join(t for r, t in mine if r == "assistant")


def test_layout(spark):
    got = back(spark, [(1, 2, "user", "c"), (1, 0, "user", "a"), (1, 1, "user", "b<|"), (1, 3, "assistant", "d")])
    assert got[1]["formatted"] == "<|im_start|>user\na<|im_sep|>b<\\|<|im_sep|>c<|im_end|>\n<|im_start|>assistant\nd<|im_end|>\n"
    assert [s["text"] for s in got[1]["segments"] if s["learned"]] == ["d"]


def test_nulls_ties_and_repeats(spark):
    got = back(spark, [(None, 0, None, None), (2, 0, "user", "b"), (2, 0, "user", "a"), (2, 0, "user", "a"), (2, None, "system", "s"), (3, 0, "assistant", None)])
    assert [(t["role"], t["text"]) for t in got[2]["turns"]] == [("system", "s"), ("user", "a"), ("user", "a"), ("user", "b")]
    assert [(t["role"], t["text"]) for t in got[None]["turns"]] == [("", "")] and got[3]["learned"] == ""
    assert back(spark, []) == {}


def test_a_very_long_conversation_and_clashing_columns(spark):
    """20,000 turns are one string that reads back; columns named like the operator's own are of no account."""
    rows = [(1, t, "user" if t % 2 else "assistant", f"turn {t} <|im_end|>", "x", t) for t in range(20_000)] + [(2, 0, "user", "y" * 300_000, "x", 0)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string, segments long")
    got = {r["conv_id"]: r for r in chat.format_conversations(df).select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns")).collect()}
    assert [(t["role"], t["text"]) for t in got[1]["turns"]] == [(r[2], r[3]) for r in rows[:-1]]
    assert [(t["role"], t["text"]) for t in got[2]["turns"]] == [("user", "y" * 300_000)]
