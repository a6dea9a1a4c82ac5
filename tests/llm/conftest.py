import pytest


@pytest.fixture(scope="session")
def odd_texts():
    """Texts that operators must not stumble over: null, empty, blank, very long, special, repeated."""
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(20_000))
    return [None, "", " \n\t ", "word", long, "<|endoftext|> a  b  c\x0b'S don't !'t", "Ünï çødé 東京 😀😀 é", "a\x00b", long, "word", "x" * 50_000]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_texts):
    """Those texts with null and repeated ids, and columns whose names operators use themselves."""
    ids = [1, 2, 3, 4, 5, 6, 7, None, 9, 4, 11]
    rows = [(i, t, None if k % 3 == 0 else "en", "s", 0, "clash", k) for k, (i, t) in enumerate(zip(ids, odd_texts))]
    schema = "doc_id long, text string, lang string, source string, n_chars long, ids string, row__ long"
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
