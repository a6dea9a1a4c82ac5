"""Row-local text columns: all are built-in expressions, so they run on batch and streams alike."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from parlance.functions import lexicon as lx

# Whitespace and word characters as Unicode defines them, spelled out so that every regex
# engine and JDK agrees.
SPACE = r"[\t-\r\x1c-\x20\x85\p{Z}]"
WORD = r"[\p{L}\p{N}_]"


def strip_tags(text: Column) -> Column:
    """Remove ``<...>`` spans, line breaks included, then trim the edges."""
    bare = F.regexp_replace(text, "<[^>]*>", "")
    return F.regexp_replace(bare, rf"\A{SPACE}+|{SPACE}+\z", "")


def uppercase_ratio(text: Column) -> Column:
    """Upper-case letters over letters; 0.0 for a text without letters."""
    letters = F.length(F.regexp_replace(text, r"\P{L}+", ""))
    upper = F.length(F.regexp_replace(text, r"\P{Lu}+", ""))
    return F.when(letters > 0, upper / letters).otherwise(F.lit(0.0))


def syllables(word: Column) -> Column:
    """Runs of vowels, at least one."""
    runs = F.regexp_count(F.lower(word), F.lit(f"[{lx.SYLLABLE_VOWELS}]+"))
    return F.greatest(F.lit(1), runs)


def space_tokens(text: Column) -> Column:
    return F.filter(F.split(text, SPACE + "+"), lambda t: t != "")


def lexical_diversity(text: Column) -> Column:
    """Distinct over total whitespace tokens."""
    tokens = space_tokens(text)
    return F.size(F.array_distinct(tokens)) / F.greatest(F.lit(1), F.size(tokens))


def punctuation_share(text: Column) -> Column:
    hits = F.regexp_count(text, F.lit(f"[{lx.PUNCTUATION}]"))
    return hits / F.greatest(F.lit(1), F.length(text))


def stylometry(text: Column) -> list[Column]:
    """Length, punctuation share, lexical diversity."""
    return [
        F.length(text).cast("double").alias("length"),
        punctuation_share(text).alias("punct_ratio"),
        lexical_diversity(text).alias("lexdiv"),
    ]


def _one_per_start(phrases: list[str]) -> bool:
    """No phrase, read up to a word end, begins another: each start matches one phrase at most."""
    return not any(
        a != b and b.startswith(a) and not re.match(r"\w", b[len(a)]) for a in phrases for b in phrases
    )


def phrase_count(text: Column, phrases: list[str]) -> Column:
    """Whole-word occurrences in the lower-cased text, each phrase counted independently.

    When no phrase begins another, one pass over the text counts the places where any starts.
    """
    low = F.lower(text)
    parts = [re.escape(p) for p in phrases]
    groups = ["|".join(parts)] if _one_per_start(phrases) else parts
    counts = [F.regexp_count(low, F.lit(rf"(?<!{WORD})(?=(?:{g})(?!{WORD}))")) for g in groups]
    total = counts[0]
    for c in counts[1:]:
        total = total + c
    return total


def connector_count(text: Column) -> Column:
    return phrase_count(text, lx.CONNECTORS)


def truncate_tokens(text: Column, max_length: int) -> Column:
    """The first ``max_length`` whitespace tokens: what a scorer without a tokenizer reads."""
    return F.array_join(F.slice(space_tokens(text), 1, max_length), " ")


def finite_or_zero(value: Column) -> Column:
    """NaN, infinities and null become 0.0."""
    bad = value.isNull() | F.isnan(value) | (F.abs(value) == F.lit(float("inf")))
    return F.when(bad, F.lit(0.0)).otherwise(value)
