"""Quality rules, lines first: each line is judged, failing lines go, and a document that loses
too much text is rejected. DataFrame expressions only; every row is worked on by itself.

A line fails by one of three rules.

- Punctuation: more than ``MAX_MARKS`` of its characters other than blanks are marks (neither
  letter, digit nor combining mark).
- Navigation: at least ``MIN_BARS`` cells parted by bars, arrows or bullets.
- Boilerplate: it has at most ``SHORT`` code points and holds one of the ``BOILERPLATE`` phrases in
  any case, as whole words: neither a letter nor a digit stands beside it. A long line of prose
  that mentions one stays.

Before that, a document fails as a whole when it has fewer than ``MIN_WORDS`` words or more than
half of its words lie in three-word windows that it repeats.

Nulls: a null text has no words and fails. Lines without words never fail. Repeated rows are
judged each; empty tables give empty tables; all input columns but those of the same name as
an added one are passed through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_WORDS = 50
MAX_MARKS = 0.15
MIN_BARS = 3
MAX_LOST = 0.5
BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
BARS = r"[|»›•·]"
SHORT = 200
#: Phrases of notices, menus and consent banners in English, German, French and Spanish.
BOILERPLATE = (
    "all rights reserved", "privacy policy", "terms of use", "terms of service", "cookie policy", "uses cookies", "accept cookies",
    "click here", "read more", "sign up", "log in", "subscribe to", "share this", "lorem ipsum", "enable javascript",
    "spdx-license-identifier", "licensed under", "copyright (c)",
    "alle rechte vorbehalten", "datenschutzerklärung", "nutzungsbedingungen", "cookies akzeptieren", "verwendet cookies", "hier klicken",
    "weiterlesen", "mehr erfahren", "jetzt registrieren", "newsletter abonnieren", "impressum",
    "tous droits réservés", "politique de confidentialité", "conditions d'utilisation", "accepter les cookies", "utilise des cookies",
    "cliquez ici", "lire la suite", "se connecter", "mentions légales", "abonnez-vous",
    "todos los derechos reservados", "política de privacidad", "términos de uso", "aceptar cookies", "utiliza cookies", "haga clic aquí",
    "leer más", "iniciar sesión", "aviso legal", "suscríbete",
)
SIGN = "©"  # fails a short line wherever it stands
WHOLE = r"(^|[^\p{L}\p{N}])(" + "|".join(p.replace("(", r"\(").replace(")", r"\)") for p in BOILERPLATE) + r")($|[^\p{L}\p{N}])"
ADDED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "clean_text", "lost", "kept")


def words_of(text: Column) -> Column:
    inner = F.btrim(text, F.lit(BLANKS))
    return F.when(F.coalesce(inner, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(inner, r"[ \t\n\x0B\f\r]+"))


def repeated_positions(words: str, windows: str) -> Column:
    """Words inside a three-word window that occurs twice, from the windows sorted by hash.

    Equal neighbours are compared by their words, so a hash proposes and never decides.
    """
    n = F.size(windows)
    same = lambda a, b: (a["h"] == b["h"]) & (F.get(words, a["i"]) == F.get(words, b["i"])) & (F.get(words, a["i"] + 1) == F.get(words, b["i"] + 1)) & (F.get(words, a["i"] + 2) == F.get(words, b["i"] + 2))
    pairs = F.zip_with(F.slice(windows, F.lit(1), n - 1), F.slice(windows, F.lit(2), n - 1), lambda a, b: F.when(same(a, b), F.array(a["i"], b["i"])))
    found = F.array_distinct(F.flatten(F.filter(pairs, lambda p: p.isNotNull())))
    covered = F.array_distinct(F.flatten(F.transform(found, lambda i: F.array(i, i + 1, i + 2))))
    return F.when(n > 1, F.size(covered)).otherwise(0)


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``words`` and the counts that the whole-document rule needs."""
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    lines = F.filter(F.split(whole, "\n", -1), lambda line: F.btrim(line, F.lit(BLANKS)) != "")
    listed = docs.drop(*ADDED, "words", "windows", "hashes", "lines").withColumn("words", words_of(F.col(f"`{text}`"))).withColumn("lines", lines)
    last = F.size("words") - 3
    hashes = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)))
    hashed = listed.withColumn("hashes", F.when(last >= 0, hashes).otherwise(F.array().cast("array<bigint>")))
    # a text whose hashes are all different repeats no window; only others are sorted and compared
    tied = F.size(F.array_distinct("hashes")) <= last
    windows = F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    empty = F.array().cast("array<struct<h:bigint,i:int>>")
    sorted_windows = hashed.withColumn("windows", F.when(tied, F.sort_array(windows)).otherwise(empty))
    return sorted_windows.withColumns(
        {
            "n_words": F.size("words").cast("long"),
            "word_chars": F.length(F.translate(whole, BLANKS, "")).cast("long"),
            "n_symbols": (F.length(whole) - F.length(F.translate(whole, SYMBOLS, ""))).cast("long"),
            "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
            "n_repeat_words": repeated_positions("words", "windows").cast("long"),
        }
    ).drop("words", "windows", "hashes", "lines")


def line_fails(line: Column) -> Column:
    solid = F.translate(line, BLANKS, "")
    marks = F.length(F.regexp_replace(solid, r"[\p{L}\p{N}\p{M}]+", ""))
    low = F.lower(line)
    held = F.lit(False)  # a quick look before the whole words
    for p in BOILERPLATE:
        held = held | F.contains(low, F.lit(p))
    phrase = (F.length(line) <= SHORT) & (F.contains(line, F.lit(SIGN)) | (held & F.rlike(low, F.lit(WHOLE))))
    return (marks > MAX_MARKS * F.length(solid)) | (F.regexp_count(line, F.lit(BARS)) >= MIN_BARS) | phrase


def judge(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns, the counts, ``base_failed``, ``clean_text``, the share ``lost`` and ``kept``."""
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    clean = F.array_join(F.filter(F.split(whole, "\n", -1), lambda line: ~line_fails(line)), "\n")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    left = F.length(F.translate(F.col("clean_text"), BLANKS, ""))
    measured = measure(docs, text).withColumn("base_failed", failed).withColumn("clean_text", clean)
    return measured.withColumn("lost", F.when(F.col("word_chars") > 0, 1 - left / F.col("word_chars")).otherwise(0.0)).withColumn(
        "kept", ~F.col("base_failed") & (F.col("lost") <= MAX_LOST)
    )


def clean(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents that pass, with the text that is left; all columns of ``docs``."""
    # a row number in the same projection keeps the optimizer from moving the filter below it,
    # where it would repeat all the counts inside the condition
    judged = judge(docs, text).withColumn("row__", F.monotonically_increasing_id())
    passed = judged.filter(F.col("kept") & (F.col("row__") >= 0))
    return passed.select(*[F.col("clean_text").alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])
