"""The toxicity score against a slow convolution, columns of any name, and permutations."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import exact_dedup, mixing, toxicity


def slow_score(m, text):
    """Word by word, filter by filter and window by window."""
    def rows(word):
        w = word.lower().strip(toxicity.EDGES).encode()
        out = [zlib.crc32(w, 1) % toxicity.ROWS] if w else []
        return out, out + [zlib.crc32(w[:n]) % toxicity.ROWS for n in toxicity.BEGINNINGS if len(w) >= n]

    words = [*(text or "").split(), *[""] * toxicity.PADS]
    vectors = []
    for w in words:
        own = rows(w)[1]
        vectors.append([sum(float(m.embedding[r][d]) for r in own) / max(1, len(own)) for d in range(toxicity.DIM)])
    total = m.constant
    for k, width in enumerate(toxicity.WIDTHS):
        for f in range(toxicity.FILTERS):
            values = [sum(vectors[i + o][d] * float(m.filters[k][o, d, f]) for o in range(width) for d in range(toxicity.DIM)) for i in range(len(words) - width + 1)]
            total += max(0.0, max(values) + float(m.bias[k][f])) * float(m.out[k * toxicity.FILTERS + f])
    sums = [sum(float(m.profile[rows(w)[0][0]][c]) for w in words if rows(w)[0]) for c in range(len(m.languages))]
    total += float(m.shift[sums.index(max(sums))])
    return 1 / (1 + math.exp(-max(-30, min(30, total))))


def test_scores_equal_slow_ones():
    rng = random.Random(1)
    good, bad = "river stone lamp field horse cloud".split(), "grobl snarf zik".split()
    texts, toxic, langs = [], [], []
    for i in range(160):
        words = [rng.choice(good) for _ in range(rng.randrange(1, 12))]
        if i % 3 == 0:
            words[rng.randrange(len(words))] = rng.choice(bad) + rng.choice(["", "!", "s"])
        texts.append(" ".join(words))
        toxic.append(int(i % 3 == 0))
        langs.append("ab"[i % 2])
    m = toxicity.train(texts, toxic, langs)
    asked = [*texts[:12], "", None, "one", "GROBL, lamp", "é漢 !!! stone"]
    got = toxicity.Scorer(m).scores(asked)
    assert got == pytest.approx([slow_score(m, t) for t in asked], abs=2e-4)
    assert np.mean((toxicity.Scorer(m).scores(texts) >= toxicity.THRESHOLD) == np.array(toxic)) > 0.9


def test_columns_of_any_name_survive(spark):
    rows = [(i, f"text number {i % 5} of these", "s" if i % 2 else "t", i * 10, f"d{i}", i % 3 == 0, 7 * i) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, __id long, __digest string, __whole boolean, __nth long").withColumn("__crc", F.lit("c"))
    index = exact_dedup.DigestIndex(spark, "lectern_digests_clash")
    kept = exact_dedup.keep(docs, index)
    index.drop()
    got = {r.doc_id: r for r in kept.collect()}
    assert sorted(got) == list(range(15, 20)) and all((r["__id"], r["__digest"], r["__nth"], r["__crc"]) == (i * 10, f"d{i}", 7 * i, "c") for i, r in got.items())
    mixed = mixing.mixed_documents(docs).collect()
    assert mixed and all((r["__id"], r["__digest"], r["__nth"], r["__crc"], r["__whole"]) == (r.doc_id * 10, f"d{r.doc_id}", 7 * r.doc_id, "c", r.doc_id % 3 == 0) for r in mixed)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000])
def test_every_pass_takes_every_block_once(spark, n):
    j = F.col("id")
    taken = [r[0] for r in spark.range(3 * n).orderBy("id").select(mixing.permuted(j, F.lit(n).cast("long"), F.lit("seed"))).collect()]
    passes = [taken[k * n : (k + 1) * n] for k in range(3)]
    assert all(sorted(p) == list(range(n)) for p in passes)
    if n == 1000:
        steps = [b - a for a, b in zip(passes[0], passes[0][1:])]
        assert passes[0] != passes[1] and len(set(steps)) > n / 2  # neighbours don't lie at equal steps
        places = [r[0] for r in spark.range(3).orderBy("id").select(mixing.last_place(F.lit(n).cast("long"), j, F.lit("seed"))).collect()]
        assert [p.index(n - 1) for p in passes] == places
