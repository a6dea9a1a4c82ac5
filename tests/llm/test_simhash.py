import numpy as np
import pytest
import xxhash

from parlance.llm import simhash
from parlance.llm.components import components


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))] if w else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if hashes and 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    """Least position in each component of fingerprints at most four bits apart."""
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 4:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [find(x) for x in range(len(fps))]


def clouds(rng):
    """Dense clouds, chains and lone fingerprints."""
    fps = []
    for size, spread in ((80, 6), (40, 3), (1, 0), (1, 0), (1, 0)):
        centre = int(rng.integers(0, 1 << 63))
        bits = rng.choice(64, max(spread, 1), replace=False)
        for _ in range(size):
            f = centre
            for b in bits[rng.random(len(bits)) < 0.5]:
                f ^= 1 << int(b)
            fps.append(f)
    chain = int(rng.integers(0, 1 << 63))
    for _ in range(12):
        fps.append(chain)
        for b in rng.choice(64, 4, replace=False):
            chain ^= 1 << int(b)
    return sorted(set(fps))


@pytest.mark.parametrize("block", [4096, 7])
def test_links_connect_as_all_near_pairs_do(spark, block):
    fps = clouds(np.random.default_rng(block))
    signed = [int(np.uint64(f).astype(np.int64)) for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    links = simhash.links(df, block=block)
    pairs = {(r["a"], r["b"]) for r in links.collect()}
    of = dict(zip(signed, fps))
    assert all((of[a] ^ of[b]).bit_count() <= 4 for a, b in pairs)
    root = {r["node"]: r["root"] for r in components(links).collect()}
    expected = plain_components(fps)
    groups = {}
    for f, e in zip(signed, expected):
        groups.setdefault(e, set()).add(root.get(f, f))
    assert all(len(g) == 1 for g in groups.values()) and len(set.union(*groups.values())) == len(groups)


def test_every_near_pair_shares_a_key_within_budget(spark):
    rng = np.random.default_rng(2)
    for _ in range(2000):
        a = int(rng.integers(0, 1 << 63))
        b = a
        for bit in rng.choice(64, int(rng.integers(1, 5)), replace=False):
            b ^= 1 << int(bit)
        ok = False
        for bit in range(64):
            first_two = simhash.chain_mask(bit, 2) & ~(1 << bit)
            ok = ok or ((a ^ b) & first_two == 0 and len(simhash.near(np.uint64(a), np.array([b], np.uint64), bit)) == 1)
        assert ok


def test_documents(spark, docs, odd_docs, odd_texts):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    rows += [(1000 + k, t) for k, t in enumerate(odd_texts)] + [(None, rows[0][1]), (None, "alone somewhere"), (5, rows[5][1]), (2000, rows[5][1].upper())]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["fp"], str(r["component_id"])) for r in simhash.near_duplicates(df).collect())
    fps = [plain_fingerprint(t) for _, t in rows]
    parts = plain_components(fps)
    least = {}
    for (i, _), p in zip(rows, parts):
        if i is not None:
            least[p] = min(least.get(p, i), i)
    expected = sorted((str(i), int(np.uint64(f).astype(np.int64)), str(least.get(p))) for (i, _), f, p in zip(rows, fps, parts))
    assert got == expected


def test_no_rows(no_docs):
    assert simhash.near_duplicates(no_docs).count() == 0


def test_components_of_long_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 5000)]
    df = spark.createDataFrame(links, "a long, b long").repartition(4)
    root = {r["node"]: r["root"] for r in components(df).collect()}
    assert all(root[i] == 0 for i in range(1, 201)) and all(root[1000 + i] == 1000 for i in range(1, 300)) and 5000 not in root
