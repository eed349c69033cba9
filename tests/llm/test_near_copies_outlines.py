"""Pairs of the near-copy stage that outlines can end don't reach the texts, and no similar pair is lost by them."""

import random

import numpy as np

from lectern.llm import near_copies as N


def test_outlines_lose_no_similar_pair():
    rng = np.random.default_rng(4)
    ended = 0
    for k in range(400):
        n = int(rng.integers(1, 3000))
        x = np.unique(rng.integers(-(1 << 63), 1 << 63, n))
        keep = rng.random(len(x)) < rng.choice([0.0, 0.5, 0.85, 0.95, 1.0])
        y = np.unique(np.concatenate([x[keep], rng.integers(-(1 << 63), 1 << 63, int(rng.integers(0, n // 5 + 2)))]))
        if not len(y):
            continue
        both = np.intersect1d(x, y).size
        similar = 5 * both >= 4 * (len(x) + len(y) - both)
        passes = N.within_outlines(N.outline(x), N.outline(y), len(x) + len(y))
        assert passes or not similar
        ended += not passes
    assert ended > 100


def test_texts_of_unlike_pairs_stay_where_they_are(spark, monkeypatch):
    """Texts of one passage and different rests share shingles, and were all compared; now only the copies are."""
    rng = random.Random(8)
    some = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    passage, base = some(40), some(300)
    rows = [(i, f"{passage} {some(160)}") for i in range(20)] + [(50, base), (51, f"{base} more")]
    seen, whole = [], N.shingles
    texts = spark.createDataFrame(rows, "row long, text string").selectExpr("row", "xxhash64(text) AS key", "text")
    sets = {r.row: (r.key, whole(r.text)) for r in texts.collect()}
    nodes = spark.createDataFrame([(i, i, k, len(s), N.outline(s)) for i, (k, s) in sets.items()], "node long, row long, key long, n int, outline binary")
    pairs = spark.createDataFrame([(i, j) for i in sets for j in sets if i > j], "u long, v long")
    kept = N.checkpointed
    monkeypatch.setattr(N, "checkpointed", lambda df: (lambda x: seen.append(x.count()) or x)(kept(df)))
    assert [tuple(r) for r in N.verified(pairs, texts, nodes, 5).collect()] == [(51, 50)] and seen == [1]
