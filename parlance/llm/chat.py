"""Chat formatting by relational expressions: collected turn structs are sorted, adjacent turns
of one role are merged, and everything is joined to one string a conversation.

Template: ``<|im_start|>role\\ntext<|im_sep|>text<|im_end|>\\n``, one block for each run of turns
of the same role, ``<|im_sep|>`` between its turns. Inside roles and texts each ``<``, backslashes,
``|`` gets one backslash more before the ``|``, so no control string can appear there and the
original comes back by taking one away. A line feed in a role is written ``<|nl|>``.

The loss mask is kept with the segments that make up the string: a segment is learned if and
only if it is the text of an assistant turn.

Nulls: a null text or role is empty; a null ``conv_id`` is a conversation of its own. Turns are
ordered by turn (null first), ties by role and text, so repeated rows are repeated turns. An
empty table gives no conversations. Other columns are not read. A conversation becomes one
row, as its output is one string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import pick

START, SEP, END, LINE = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n", "<|nl|>"
LEARNED_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", "<$1|")


def format_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, segments: array of (text, learned) that join to ``formatted``."""
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    rows = pick(turns, "conv_id", "turn", "role", "text").select(
        "conv_id",
        F.struct(
            F.col("turn"),
            role.alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
        ).alias("turn"),
    )
    sorted_turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    n = F.size("turns")
    opens = F.filter(
        F.sequence(F.lit(1), n),
        lambda i: (i == 1) | (F.element_at("turns", i)["role"] != F.element_at("turns", F.greatest(i - 1, F.lit(1)))["role"]),
    )
    starts = sorted_turns.withColumn("starts", opens).withColumn("n", n)
    ends = F.concat(F.slice("starts", F.lit(2), F.size("starts")), F.array(F.col("n") + 1))
    blocks = starts.withColumn(
        "blocks",
        F.zip_with(
            "starts",
            ends,
            lambda a, b: F.struct(
                F.element_at("turns", a)["role"].alias("role"),
                F.transform(F.slice("turns", a, b - a), lambda t: escape(t["text"])).alias("texts"),
            ),
        ),
    )
    plain = lambda text: F.struct(text.alias("text"), F.lit(False).alias("learned"))
    segments = F.flatten(
        F.transform(
            "blocks",
            lambda b: F.concat(
                F.array(plain(F.concat(F.lit(START), F.replace(escape(b["role"]), F.lit("\n"), F.lit(LINE)), F.lit("\n")))),
                F.flatten(
                    F.transform(
                        b["texts"],
                        lambda t, i: F.concat(
                            F.when(i > 0, F.array(plain(F.lit(SEP)))).otherwise(F.slice(F.array(plain(F.lit(SEP))), 1, 0)),
                            F.array(F.struct(t.alias("text"), (b["role"] == LEARNED_ROLE).alias("learned"))),
                        ),
                    )
                ),
                F.array(plain(F.lit(END))),
            ),
        )
    )
    out = blocks.select("conv_id", segments.alias("segments"))
    return out.select("conv_id", F.array_join("segments.text", "").alias("formatted"), "segments")


def read_turns(formatted: Column) -> Column:
    """The turns as (role, text) structs, read back from a formatted string alone."""
    blocks = F.filter(F.split(formatted, r"<\|im_start\|>", -1), lambda b: b != "")

    def turns_of(block: Column) -> Column:
        head = F.substring_index(block, "\n", 1)
        body = F.substring(block, F.length(head) + 2, F.length(block) - F.length(head) - 1 - len(END))
        role = unescape(F.replace(head, F.lit(LINE), F.lit("\n")))
        return F.transform(F.split(body, r"<\|im_sep\|>", -1), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns_of))


def learned_text(segments: Column) -> Column:
    """All text under the loss mask, in order, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["learned"]), lambda s: unescape(s["text"])), "")
