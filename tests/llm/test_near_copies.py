"""The near-copy stage against plain comparison of all pairs, without the minima condition."""

import random

import numpy as np
import pytest
from docloom.llm import simhash


@pytest.mark.parametrize(("jaccard", "most"), [(0.9, 0), (0.8, 1), (0.7, 4)])
def test_pairs_meet(jaccard, most):
    rnd = np.random.default_rng(5)
    n, missed = 200, 0
    shared = round(2 * n * jaccard / (1 + jaccard))
    for _ in range(5000):
        x = rnd.integers(0, 1 << 64, 2 * n - shared, np.uint64)
        a, b = simhash.minima(x[:n]), simhash.minima(x[n - shared :])
        missed += not (a == b).reshape(-1, 2).all(axis=1).any()
    assert missed <= most


def partition(docs, radius=simhash.COPY_RADIUS):
    """Groups of ids by the fingerprints of all pairs with a shingle in common; others are near by chance only."""
    hashes = [simhash.shingle_hashes(simhash.words(t), simhash.COPY_SHINGLE) for _, t in docs]
    fps = np.array([simhash.fingerprint(h) for h in hashes], np.uint64)
    sets = [set(h.tolist()) for h in hashes]
    root = np.arange(len(docs))
    for i in range(len(docs)):
        at = [j for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= radius) if j == i or sets[i] & sets[j]]
        near = np.unique(root[at])
        root[np.isin(root, near)] = near[0]
    out = {}
    for (d, _), r in zip(docs, root, strict=True):
        out.setdefault(r, set()).add(d)
    return {frozenset(x) for x in out.values()}


def grouped(spark, docs):
    rows = simhash.copy_groups(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()
    out = {}
    for r in rows:
        out.setdefault(r["group"], set()).add(r.doc_id)
    return {frozenset(x) for x in out.values()}


def edited(rnd, ws, n):
    ws = list(ws)
    for i in rnd.sample(range(len(ws)), n):
        ws[i] = f"x{rnd.randrange(10**6)}"
    return ws


def test_all_near_copies_are_grouped(spark):
    rnd = random.Random(3)
    docs = []
    for i in range(1500):
        ws = [f"w{rnd.randrange(5000)}" for _ in range(100)]
        docs += [(2 * i, " ".join(ws)), (2 * i + 1, " ".join(edited(rnd, ws, 1)))]
    want = partition(docs)
    assert len(want) < 1600
    assert grouped(spark, docs) == want


def test_crowded_keys_are_compared_in_full(spark, monkeypatch):
    """One place of all, so that a crowded key is the only one in which its nodes meet."""
    from pyspark.sql import functions as F

    rnd = random.Random(8)
    fps = set()
    for _ in range(40):
        x = rnd.getrandbits(64)
        fps |= {x ^ sum(1 << b for b in rnd.sample(range(64), rnd.randrange(9))) for _ in range(rnd.choice((1, 2, 3, 30)))}
    fps = np.array(sorted(fps), np.uint64)
    want = np.arange(len(fps))
    for i in range(len(fps)):
        near = np.unique(want[np.bitwise_count(fps ^ fps[i]) <= simhash.COPY_RADIUS])
        want[np.isin(want, near)] = near[0]
    fps = fps.view(np.int64)
    least = [int(fps[want == r].min()) for r in want]
    rows = [(int(f), int(f), 0, 7) for f in fps] + [(int(f), int(f), 1, 9) for f in fps[:5]]
    dealt = spark.createDataFrame(rows, "fp long, node long, t int, key long").repartition(3)
    monkeypatch.setattr(simhash, "CROWDED", 20)
    monkeypatch.setattr(simhash, "COMMON", 3)
    got = {r.node: r.root for r in simhash._grouped(dealt, simhash.COPY_RADIUS).select("node", F.col("root")).collect()}
    assert len(set(least)) < len(fps) and [got.get(int(f), int(f)) for f in fps] == least


def test_no_near_copy_of_a_crowded_key_is_lost(spark, monkeypatch):
    """Minima that are equal at one place, for all texts, and differ at the others."""
    rnd = random.Random(4)
    docs = []
    for i in range(100):
        ws = [f"w{rnd.randrange(5000)}" for _ in range(100)]
        docs += [(4 * i + k, " ".join(edited(rnd, ws, k))) for k in range(3)]
    base = [f"w{rnd.randrange(5000)}" for _ in range(100)]
    docs += [(1000 + k, " ".join(edited(rnd, base, 2))) for k in range(150)]

    def one_place(hashes):
        return np.array([7, 7, *(hash((i, *hashes.tolist())) % (1 << 64) for i in range(simhash.MINIMA - 2))], np.uint64)

    monkeypatch.setattr(simhash, "minima", one_place)
    monkeypatch.setattr(simhash, "CROWDED", 60)
    assert grouped(spark, docs) == partition(docs)
