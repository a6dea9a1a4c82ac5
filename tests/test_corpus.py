import pytest
from pyspark.sql import functions as F

from parlance.functions import text as tx
from parlance.operators import clean, triage
from parlance.sources import corpus as src, sinks


def _write(path, content):
    path.write_text(content, encoding="utf-8", newline="")
    return str(path)


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "t string").select(expr(F.col("t"))).first()[0]


def test_quoted_csv_keeps_quotes_and_line_breaks(spark, tmp_path):
    path = _write(tmp_path / "a.csv", 'ID;Texte;Langue\n1;"il dit ""oui""\nfin";FR\n')
    assert [tuple(r) for r in src.read_corpus(spark, path, ";").collect()] == [("1", 'il dit "oui"\nfin', "FR")]


@pytest.mark.parametrize("sep", [";", ",", "\t"])
def test_separator_is_detected(spark, tmp_path, sep):
    path = _write(tmp_path / "a.csv", sep.join(["ID", "Texte", "Langue"]) + "\n" + sep.join(["1", "a b", "FR"]) + "\n")
    assert src.detect_sep(spark, path) == sep
    assert src.read_corpus(spark, path, None).first()["Texte"] == "a b"


def test_null_tokens_are_dropped_before_learning(spark, tmp_path):
    path = _write(tmp_path / "a.csv", "ID,Texte,Langue\n1,NA,FR\n2,,FR\n3,ok,FR\n4,ok,null\n")
    assert [r["ID"] for r in src.labelled(src.read_corpus(spark, path, ",", nulls=True)).collect()] == ["3"]
    assert src.read_corpus(spark, path, ",").count() == 4


def test_missing_file_raises(spark):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        src.read_corpus(spark, "/tmp/no-such-corpus.csv")


def test_round_trip_keeps_edges_empty_and_null(spark, tmp_path):
    rows = [("1", " a\n\"b\" ", "x"), ("2", "", "y"), ("3", "c,;d\\", "z"), ("4", None, "w")]
    df = spark.createDataFrame(rows, "ID string, Texte string, Langue string")
    sinks.write_csv(df, str(tmp_path / "out"))
    got = {r["ID"]: r["Texte"] for r in src.read_corpus(spark, str(tmp_path / "out")).collect()}
    assert got == {"1": ' a\n"b" ', "2": "", "3": "c,;d\\", "4": None}


def test_id_list(spark, tmp_path):
    path = _write(tmp_path / "ids.txt", " 1 \n\n2\n1\n \t\n")
    assert sorted(r[0] for r in src.read_ids(spark, path).collect()) == ["1", "2"]


def test_removal_drops_null_ids(spark):
    df = spark.createDataFrame([("1",), (None,), ("2",)], "ID string")
    ids = spark.createDataFrame([("1",)], "ID string")
    assert [r[0] for r in clean.remove_ids(df, ids).collect()] == ["2"]


def test_required_columns(spark):
    df = spark.createDataFrame([("a",)], "Texte string")
    with pytest.raises(ValueError, match="Langue.*available columns: Texte"):
        clean.clean_corpus(df)


def test_generated_ids_depend_on_the_rows_alone(spark):
    df = spark.createDataFrame([("same",)] * 20 + [("other",), (None,)], "Texte string")
    ids = [sorted(map(tuple, src.with_row_ids(df.repartition(n)).select("ID", "Texte").collect())) for n in (1, 7)]
    assert ids[0] == ids[1] and len({i for i, _ in ids[0]}) == 22


def test_quoted_header_may_hold_the_separator(spark, tmp_path):
    path = _write(tmp_path / "a.csv", '"ID","Texte, brut","Langue"\n1,a,FR\n')
    assert src.detect_sep(spark, path) == ","
    assert src.read_corpus(spark, path).columns == ["ID", "Texte, brut", "Langue"]


@pytest.mark.parametrize("value,text", [(129 / 160, "0.8063"), (1 / 800, "0.0013"), (0.80005, "0.8001"), (0.0, "0.0000"), (1.0, "1.0000"), (0.99996, "1.0000"), (0.03125, "0.0312")])
def test_ratio_text_rounds_the_exact_value(spark, value, text):
    df = spark.createDataFrame([(value,)], "r double")
    assert df.select(sinks.four_decimals(F.col("r"))).first()[0] == text == f"{value:.4f}"


def test_ratio_text_equals_python_on_many_fractions(spark):
    values = [(a / b,) for b in (160, 320, 800, 1600, 3200, 20000) for a in range(0, b, 7)]
    rows = spark.createDataFrame(values, "r double").select("r", sinks.four_decimals(F.col("r"))).collect()
    assert [r[1] for r in rows] == [f"{r[0]:.4f}" for r in rows]


def test_threshold_report_has_its_zones(spark, tmp_path):
    curve = spark.createDataFrame([(0.1, 5, 50.0, None), (0.2, 3, 30.0, 2)], "threshold double, n long, pct double, drop long")
    zones = spark.createDataFrame([(0.1, 0.2, 0.8)], "seuil_min double, seuil_max double, seuil_nettoyage double")
    sinks.write_threshold_report(curve, zones, str(tmp_path / "report"))
    lines = [r[0] for r in spark.read.text(str(tmp_path / "report")).collect()]
    assert lines == ["10%\t5\t50.00%\t-", "20%\t3\t30.00%\t2", "tri manuel\t10-20%", "nettoyage\t80%+"]


@pytest.mark.parametrize(
    "raw,bare",
    [("a <b\nc>x</b> 1<2 & 3>2", "a x 12"), ("  x\x1f", "x"), ("&lt;b&gt;", "&lt;b&gt;"), ("<p></p>", ""),
     ("<script>f()</script>", "f()")],
)
def test_strip_tags(spark, raw, bare):
    assert one(spark, raw, tx.strip_tags) == bare


@pytest.mark.parametrize(
    "text,ratio", [("123 !", 0.0), ("", 0.0), ("AbCd", 0.5), ("ÉÀ", 1.0), ("ßa", 0.0), ("ǅa", 0.0)]
)
def test_uppercase_ratio_matches_python(spark, text, ratio):
    letters = [c for c in text if c.isalpha()]
    expected = sum(c.isupper() for c in letters) / len(letters) if letters else 0.0
    assert one(spark, text, tx.uppercase_ratio) == expected == ratio


@pytest.mark.parametrize(
    "counts,zones",
    [
        ([5] * 10, (0.1, 0.1, 1.0)),
        ([0] * 10, (0.1, 0.1, 1.0)),
        ([90, 80, 70, 60, 50, 40, 30, 20, 10, 0], (0.1, 0.1, 1.0)),
        ([50, 45, 44, 43, 43, 43, 43, 43, 36, 24], (0.1, 0.2, 0.8)),
        ([100, 50, 20, 19, 18, 17, 16, 15, 9, 2], (0.1, 0.3, 0.8)),
        ([9, 8, 8, 8, 8, 8, 8, 8, 8, 0], (0.1, 0.2, 0.9)),
    ],
)
def test_zones(spark, counts, zones):
    before = [None, *counts]
    rows = [(p / 100, n, 0.0, None if b is None else b - n) for p, n, b in zip(range(10, 101, 10), counts, before)]
    curve = spark.createDataFrame(rows, "threshold double, n long, pct double, drop long")
    assert tuple(triage.zones(curve).first()) == zones


def test_curve_of_an_empty_corpus(spark):
    empty = spark.createDataFrame([], "Texte string")
    rows = triage.threshold_curve(triage.with_ratio(empty)).collect()
    assert len(rows) == 10 and all(r["n"] == 0 and r["pct"] == 0.0 for r in rows)


def test_zone_file_names():
    row = {"seuil_min": 0.1, "seuil_max": 0.2, "seuil_nettoyage": 0.8}
    assert sinks.zone_file_names(row) == {"clean": "nettoyage_80pct_et_plus.csv", "triage": "tri_manuel_10_20pct.csv"}


def test_experiment_name():
    assert sinks.experiment_name("camembert", []) == "camembert_bert_only"
    assert sinks.experiment_name("flaubert", ["articles", "passive"]) == "flaubert_articles+passive"


def test_presets_give_way_to_the_caller():
    assert sinks.scorer_settings("flaubert", epochs=2, lr=None) == {
        "lr": 2e-5, "epochs": 2, "max_length": 256, "batch_size": 8}
