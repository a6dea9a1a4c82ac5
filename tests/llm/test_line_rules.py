import re
from collections import Counter

from pyspark.sql import functions as F

from parlance.llm import line_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if often[x] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    counts = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))
    return (*counts, counts[0] < 50 or 100 * counts[4] > 50 * counts[0])


def measured(df, *more):
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return [tuple(r) for r in line_rules.judge(df).select("number", *columns, *more).orderBy("number").collect()]


def test_counts_equal_brute_force(spark, odd_texts, docs):
    texts = [*odd_texts, *[r["text"] for r in docs.select("text").collect()], "a b c a b c", "a a a a", "x\nx\n\n \nx", "a b c d a b c " * 40, "b a\tb a b\x0ba"]
    df = spark.createDataFrame(list(enumerate(texts)), "number long, text string")
    assert measured(df) == [(k, *brute(t)) for k, t in enumerate(texts)]


def test_line_rules(spark):
    good = "Plain prose, with a comma. And an end."
    bad = ["Home | About | News | Contact", "!!! $$$ ??? ###", "Copyright (c) 2020 A. All rights reserved.", "Please ACCEPT COOKIES now", "THE!! SKY!! IS!! BLUE!!"]
    df = spark.createDataFrame([(k, line) for k, line in enumerate([good, *bad, "", "  "])], "k int, line string")
    flags = [bool(r[0]) for r in df.orderBy("k").select(line_rules.line_fails(F.col("line"))).collect()]
    assert flags == [False, True, True, True, True, True, False, False]


def test_phrases_are_whole_words_in_short_lines_of_four_languages(spark):
    kept = [
        "They blog in the evening and sit upstairs to design up north.", "A catalog in print, a sign upon the door.", "Weiterlesender Gast, dessen Impressumsrecht gilt.",
        "We read more than before. " * 12 + "Click here was all it said.",
    ]
    failed = [
        "Alle Rechte vorbehalten. Datenschutzerklärung", "© 2020 A", "Tous droits réservés", "Lire la suite...", "Política de privacidad", "(Log in)", "read more", "Conditions d'utilisation",
        "TODOS LOS DERECHOS RESERVADOS", "Copyright (c) 2020 A",
    ]
    df = spark.createDataFrame(list(enumerate([*kept, *failed])), "k int, line string")
    flags = [bool(r[0]) for r in df.orderBy("k").select(line_rules.line_fails(F.col("line"))).collect()]
    assert flags == [False] * len(kept) + [True] * len(failed)


def test_documents_that_lose_too_much_go(spark):
    prose = "\n".join(" ".join(f"word{i * j}" for j in range(1, 13)) + "." for i in range(2, 12))
    junk = "\n".join(f"Home{i} | About{i} | News{i} | Contact{i} | More{i}" for i in range(60))
    df = spark.createDataFrame([(0, prose), (1, prose + "\n" + junk[:80]), (2, prose + "\n" + junk)], "number long, text string")
    rows = {r["number"]: r for r in line_rules.judge(df).collect()}
    assert [rows[k]["kept"] for k in range(3)] == [True, True, False]
    assert rows[0]["clean_text"] == prose == rows[1]["clean_text"].strip("\n")


def test_columns_and_odd_rows(odd_docs, no_docs):
    judged = line_rules.judge(odd_docs)
    assert set(odd_docs.columns) <= set(judged.columns) and judged.count() == odd_docs.count()
    assert line_rules.judge(no_docs).count() == 0
    null = judged.filter("text is null").first()
    assert null["base_failed"] and not null["kept"] and null["n_words"] == 0


def test_the_plan_has_no_python_and_no_shuffle(odd_docs, docs):
    plan = line_rules.judge(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
