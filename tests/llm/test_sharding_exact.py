"""The capacity is the smallest one where large groups keep it well above the mean and only a few boundaries may be read at once."""

import random
from itertools import accumulate

import pytest

from lectern.llm import sharding


def made(seed):
    rng = random.Random(seed)
    sizes = [rng.choice([rng.randint(17, 200)] * 30 + [rng.randint(8_000, 20_000)]) for _ in range(2500)]
    ends = list(accumulate(sizes))
    return sizes, ends, [(s, e, i * 8 // len(sizes)) for i, (s, e) in enumerate(zip(sizes, ends, strict=True))]


@pytest.mark.parametrize("seed", range(4))
def test_smallest(spark, seed):
    sizes, ends, rows = made(seed)
    groups = spark.createDataFrame(rows, "size long, prefix long, range long").coalesce(1).cache()
    cuts = sharding.minimax_cuts(groups, 30, ranges=8, read_at_most=20)
    assert cuts[-1] == ends[-1] and set(cuts) <= set(ends) and len(cuts) <= 30
    assert max(b - a for a, b in zip([0, *cuts], cuts, strict=False)) == sharding.smallest(ends, 30, max(sizes))


@pytest.mark.parametrize("seed", range(5))
def test_balanced(seed):
    """The capacity stays the smallest, no shard is empty while there are as many groups as shards, and the smallest shard is no smaller than that of greedy filling."""
    rng = random.Random(seed)
    for _ in range(300):
        sizes = [int(rng.paretovariate(1.1) * 20) for _ in range(rng.randint(1, 60))]
        ends, shards = list(accumulate(sizes)), rng.randint(1, 40)
        capacity = sharding.smallest(ends, shards, max(sizes))
        of = lambda cuts: [b - a for a, b in zip([0, *cuts], cuts, strict=False)]
        got, greedy = of(sharding.balanced(ends, capacity, shards)), of(sharding.fill(ends, capacity, shards))
        assert len(got) == shards and sum(got) == ends[-1] and max(got) == capacity
        assert min(got) > 0 or len(sizes) < shards
        assert min(got) >= min([*greedy, *[0] * (shards - len(greedy))])
