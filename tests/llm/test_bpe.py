import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from parlance.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def noise(rng):
    """Short texts of all that could upset a cut: blanks beyond ASCII, apostrophes, marks, control strings."""
    parts = ["don't", "'s", "'", " ", "  ", "\n", "\t\t", " ", " ", "　", "\x85", "\x1c", "é", "naïve", "ß", "東京", "😀", "123", "1a", "!?", "...", "<|endoftext|>", "<|", "zq", "́", "The", "ing"]
    return "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))


def test_ids_are_those_of_the_library(spark, library):
    rng = random.Random(5)
    texts = [noise(rng) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: list(r["ids"]) for r in bpe.encode(df, PATH).collect()}
    for i, text in enumerate(texts):
        assert got[i] == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_round_trip_and_odd_cases(spark, library, odd_docs, odd_texts):
    encoded = bpe.encode(odd_docs, PATH, keep=("row__", "doc_id"))
    rows = {r["row__"]: r for r in bpe.decode(encoded, PATH, keep=("row__", "ids")).collect()}
    assert len(rows) == len(odd_texts)
    for k, text in enumerate(odd_texts):
        assert list(rows[k]["ids"]) == library.encode(text or "", add_special_tokens=False).ids
        assert rows[k]["text"] == (text or "") == library.decode(list(rows[k]["ids"]), skip_special_tokens=False)


def test_ids_that_are_no_text_are_replaced(spark, library):
    halves = [[t] for t in range(200, 260)] + [None]
    df = spark.createDataFrame(list(enumerate(halves)), "doc_id long, ids array<int>")
    for r in bpe.decode(df, PATH).collect():
        ids = halves[r["doc_id"]]
        assert r["text"] == (None if ids is None else library.decode(ids, skip_special_tokens=False))


def test_no_rows(no_docs):
    assert bpe.decode(bpe.encode(no_docs, PATH), PATH).count() == 0


def test_cuts_are_certain():
    free = bpe.cut_pairs([b"ab", b"bc"])
    assert not free[ord("a"), ord("b")] and free[ord("a"), ord("c")] and not free[ord(" "), ord("a")] and not free[ord("a"), 0xA9]
