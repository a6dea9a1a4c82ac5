import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from parlance.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string"


def rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [(r, t) for _, r, t in sorted(v)] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    return out


def brute(convs):
    """Every node from every prefix."""
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        saved[p] = (len(members[p]) - 1) * words + sum(saved[q] for q in children[p])
        leaves[p] = sum(leaves[q] for q in children[p]) or 1
    rows = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in m if len(convs[c]) == len(p)))
        parent = min(members[p[:-1]]) if p else None
        rows.append((min(m), len(p), parent, len(m), len(children[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(rows, key=lambda r: r[:2])


def found(df):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in df.select(names).collect()), key=lambda r: r[:2])


def through(spark, rows, **how):
    turns = trie.turns_of(spark.createDataFrame(rows, SCHEMA))
    return found(trie.trie(trie.with_shared_openings(turns), **how))


def test_whole_table_against_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert through(spark, rows) == brute(rebuilt(rows))


@pytest.mark.parametrize("batches,growth", [(1, 2), (4, 2)])
def test_random_conversations(spark, batches, growth):
    """Few words and lengths, so that conversations part everywhere, end inside others and repeat."""
    pick = random.Random(batches)
    rows = [(c, t, pick.choice("ua"), pick.choice(["x", "x y", ""])) for c in range(150) for t in range(pick.randint(1, 11))]
    rows += [(c, t, "u", "hot turn") for c in range(1000, 1060) for t in range(6)]
    assert through(spark, rows, batches=batches, growth=growth) == brute(rebuilt(rows))


def test_odd_rows(spark):
    rows = [
        (0, None, None, None), (0, 1, "user", ""), (0, 2, "user", " a  b\n"), (None, 0, "user", "lost"), (3, 0, "x", "one turn only"), (7, None, "user", "w " * 50_000),
        (20, 5, "user", "later"), (20, 5, "user", "later"), (21, 1, "a", "b"), (41, 0, "no", "head"), (41, 1, "no", "head"), (43, 0, "no", "head"),
    ]
    got = through(spark, rows)
    assert got == brute(rebuilt(rows)) and got[0][1] == 0 and got[0][3] == 7
    clash = spark.createDataFrame([r + ("e", "p", 9) for r in rows], SCHEMA + ", end string, path string, n long")
    assert found(trie.trie(trie.with_shared_openings(trie.turns_of(clash)))) == got


def test_empty_table(spark):
    assert through(spark, []) == []


def test_long_conversation_is_found_by_few_probes(spark):
    rows = [(0, t, "u", f"t{t % 7}") for t in range(600)] + [(1, t, "u", f"t{t % 7}" if t < 437 else "off") for t in range(500)]
    assert through(spark, rows, batches=2, growth=1) == brute(rebuilt(rows))


def test_two_fattest(spark):
    pairs = [(a, b) for b in range(1, 40) for a in range(b)]
    got = spark.createDataFrame(pairs, "a int, b int").select("a", "b", trie.two_fattest(F.col("a"), F.col("b"))).collect()
    for a, b, f in got:
        assert f == max(range(a + 1, b + 1), key=lambda x: x & -x)


def test_ends_are_joined_in_order_over_many_pieces(spark):
    ends = [(c, b"same") for c in range(5000)] + [(9, b"one")]
    got = {bytes(e): d for e, d in trie.ends_digests(spark.createDataFrame(ends, "conv_id long, end binary")).collect()}
    assert got == {b"same": hashlib.sha256(",".join(map(str, range(5000))).encode()).hexdigest(), b"one": hashlib.sha256(b"9").hexdigest()}
