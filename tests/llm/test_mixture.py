import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from parlance.llm import mixture


def size_of(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def targets(sizes):
    """Shares by weight, stopped and shared again until none is above."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    mass, stopped = 1.5 * sum(sizes.values()), set()
    while True:
        free = sum(weight[s] for s in order if s not in stopped)
        level = (mass - sum(2 * sizes[s] for s in stopped)) / free if free else 0
        over = {s for s in order if s not in stopped and weight[s] * level > 2 * sizes[s]}
        if not over:
            return {s: 2.0 * sizes[s] if s in stopped else weight[s] * level for s in order}
        stopped |= over


def check(rows, got):
    """``rows``: (doc_id, text, source); sums, copies and bounds of what the mix takes."""
    total, most = defaultdict(int), defaultdict(int)
    for _, text, source in rows:
        total[source] += size_of(text)
        most[source] = max(most[source], size_of(text))
    want, taken = targets(total), defaultdict(int)
    assert sorted((str(r["doc_id"]), r["size"], str(r["source"])) for r in got) == sorted((str(i), size_of(t), str(s)) for i, t, s in rows)
    for r in got:
        s = r["source"]
        assert r["source_size"] == total[s] and r["target"] == pytest.approx(want[s], rel=1e-12)
        ratio = want[s] / total[s] if total[s] else 0
        assert r["taken"] == r["copies"] * r["size"] and r["taken"] <= 2 * r["size"]
        assert int(ratio + 1e-12) <= r["copies"] + 1e-9 and r["copies"] <= -int(-ratio - 1) + 1e-9
        taken[s] += r["taken"]
    for s in total:  # only the last residual of a source is rounded without a partner
        assert abs(taken[s] - want[s]) <= most[s]


def test_whole_table(spark, sf, docs):
    rows = [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]
    got = mixture.mix(docs).collect()
    check(rows, got)
    again = mixture.mix(docs.repartition(5, "text"), few=0).collect()  # another layout, and joins by salted keys
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    assert sorted(map(tuple, got)) != sorted(map(tuple, mixture.mix(docs, seed=7).collect()))


def test_expectations_stay_and_sums_meet(spark):
    """Many alike sources: every place is taken about as often as wanted, and sums miss by one document at most."""
    shape = [1, 1, 2, 3, 5, 8, 40, 41, 60, 200]
    rows = [(1000 * s + k, "w " * n, f"s{s:03d}") for s in range(300) for k, n in enumerate(shape)]
    got = mixture.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), fan=4).collect()
    check(rows, got)
    for heavy in (0.75, 1.5):
        by_place, wanted = defaultdict(list), None
        for r in got:
            if abs(r["target"] / r["source_size"] - heavy) < 0.2:
                wanted = r["target"] / r["source_size"]
                by_place[r["doc_id"] % 1000].append(r["copies"])
        for copies in by_place.values():
            assert abs(sum(copies) / len(copies) - wanted) < 0.15


def test_one_large_source(spark):
    rows = [(k, "w " * (k % 17 + 1), "hot") for k in range(3000)] + [(-k, "w w w", f"s{k}") for k in range(1, 40)]
    got = mixture.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), fan=8).collect()
    check(rows, got)


def test_odd_rows(odd_docs, no_docs):
    rows = [tuple(r) for r in odd_docs.select("doc_id", "text", "source").collect()]
    check(rows, mixture.mix(odd_docs).collect())
    assert mixture.mix(no_docs).count() == 0
    blank = odd_docs.withColumn("text", F.lit(" \n"))
    assert {(r["size"], r["target"], r["taken"]) for r in mixture.mix(blank).collect()} == {(0, 0.0, 0)}


def test_null_sources_and_repeats(spark):
    rows = [(1, "a b c", None)] * 9 + [(2, "a b", "x"), (None, "a", "x"), (3, "a b c d e", "é"), (4, None, "z"), (5, "q " * 30, None), (6, "q", "Z")]
    schema = "doc_id long, text string, source string, size long, copies long, target string, salt int, chunk int"
    check(rows, mixture.mix(spark.createDataFrame([r + (1, 1, "t", 1, 1) for r in rows], schema)).collect())
    few = 2 * mixture.CHUNK + 5  # repeats are numbered over several chunks
    check([(1, "a", "x")] * few + [(2, "b", "y")] * 3, mixture.mix(spark.createDataFrame([(1, "a", "x")] * few + [(2, "b", "y")] * 3, "doc_id long, text string, source string")).collect())


def test_expressions_only(spark, docs):
    plan = mixture.mix(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
