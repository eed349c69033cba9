"""Hard negatives against brute force, with ties, nulls, repeated rows and vectors of several lengths."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm.hard_negatives import LEAF, BallTree, hard_negatives

SCHEMA = "vec_id long, embedding array<double>, label int, rid string, score int"


def slow(rows, every=5, positives=5, negatives=10, scale=256):
    good = []
    for i, (name, v, label, *_) in enumerate(rows):
        if name is not None and v is not None and label is not None and all(x is not None and math.isfinite(x) for x in v):
            q = [math.floor(scale * x) for x in v]
            if sum(x * x for x in q) <= 2**52:
                good.append((i, name, label, q))
    out = []
    for i, name, label, q in good:
        if name % every:
            continue
        scored = [(sum(x * y for x, y in zip(q, r[3], strict=True)), r[1], r[2]) for r in good if r[0] != i and len(r[3]) == len(q)]
        scored.sort(key=lambda s: (-s[0], s[1]))
        for p, pid, _ in [s for s in scored if s[2] == label][:positives]:
            fit = [s for s in scored if s[2] != label and 30 * p <= 100 * s[0] <= 90 * p][:negatives]
            out += [(name, pid, k + 1, s[1], p, s[0]) for k, s in enumerate(fit)]
    return sorted(out)


def made(seed, n, length, copies=0):
    rng = random.Random(seed)
    rows = [[i, [rng.gauss(0.3, 1) for _ in range(length)], rng.randrange(3), "x", 1] for i in range(n)]
    hot = [0.5] * length
    return rows + [[n + i, hot, i % 2, "x", 1] for i in range(copies)]


def got(spark, rows, shards):
    df = hard_negatives(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 5 == 0, shards=shards)
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("shards", [1, 3])
def test_equals_brute_force(spark, shards):
    rows = made(1, 300, 4, copies=200)
    rows += [[None, [1.0] * 4, 1, "x", 1], [905, None, 1, "x", 1], [910, [1.0] * 4, None, "x", 1], [915, [1.0, None, 1.0, 1.0], 1, "x", 1], [920, [1.0, float("nan"), 1.0, 1.0], 1, "x", 1]]
    rows += [[925, [], 1, "x", 1], [930, [], 2, "x", 1], [935, [], 1, "x", 1], [940, [1.0, 2.0], 1, "x", 1], [945, [1.5, 2.0], 1, "x", 1], [950, [0.5, 1.0], 2, "x", 1], [955, [1e300, 0.0], 2, "x", 1]]
    rows += [rows[0], rows[0], [5, [0.1, 0.2, 0.3, 0.4], 1, "x", 1]]  # repeated rows and ids
    assert got(spark, rows, shards) == slow(rows)


def test_empty_and_lonely(spark):
    assert got(spark, [], None) == []
    assert got(spark, [[5, [1.0], 1, "x", 1]], None) == []


def test_tree_prunes_and_agrees():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 8)) * 40
    x = np.floor(centres[rng.integers(0, 40, 6000)] + rng.normal(size=(6000, 8)))
    ids, labels = rng.permutation(6000), rng.integers(0, 4, 6000)
    tree, seen = BallTree(ids, ids, labels, x), [0]
    merge = tree.merge
    tree.merge = lambda score, found, some, *rest: (seen.__setitem__(0, seen[0] + len(some)), merge(score, found, some, *rest))
    q, own = x[:50], np.full(50, -1)
    low, high = np.full(50, 300.0), (q * q).sum(axis=1) * 0.9
    r, s, found = tree.best(q, labels[:50], own, False, low, high, 10)
    for i in range(50):
        scores = x @ q[i]
        fit = np.flatnonzero((labels != labels[i]) & (scores >= 300) & (scores <= high[i]))
        want = fit[np.lexsort((ids[fit], -scores[fit]))][:10]
        mine = r == i
        order = np.lexsort((found[mine], -s[mine]))
        assert found[mine][order].tolist() == ids[want].tolist()
    assert seen[0] < 0.3 * 50 * 6000 / (LEAF / 2)  # most leaves are never opened
