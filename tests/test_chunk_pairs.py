"""Chunk pairs against the three steps by enumeration."""

import itertools
import random
import re

from lectern.functions.layout import words
from lectern.operators import chunk_pairs as P


def key_words(x):
    return {w for w in re.sub(r"[\W_]+", " ", x.lower()).split()}


def slow(old, new):
    """{(a, b): how} by headings, the best rising set, and position."""
    out, used_a, used_b = {}, set(), set()
    for name in {h.lower() for h, _ in old if h} & {h.lower() for h, _ in new if h}:
        a, b = (next(i for i, (h, _) in enumerate(v) if h.lower() == name) for v in (old, new))
        out[a, b] = "heading"
    used_a, used_b = {a for a, _ in out}, {b for _, b in out}
    score = {}
    for (i, x), (j, y) in itertools.product(enumerate(old), enumerate(new)):
        p, q = key_words(x[1]), key_words(y[1])
        if i not in used_a and j not in used_b and p and q and len(p & q) / len(p | q) > P.ALIKE:
            score[i, j] = len(p & q) / len(p | q)
    rising = lambda c: all(x[0] < y[0] and x[1] < y[1] for x, y in zip(c, c[1:]))
    best = max((c for n in range(len(score) + 1) for c in itertools.combinations(sorted(score), min(n, 5)) if rising(c)), key=lambda c: sum(score[x] for x in c), default=())
    return out, sum(score[x] for x in best), score


def test_pairs_and_changes(spark):
    rng = random.Random(1)
    vocabulary = "river stone lamp field horse cloud paper harbour ferry lantern".split()
    some = lambda: " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 4)))
    made = {i: tuple([(rng.choice(["", "", "One", "Two", "three"]), some()) for _ in range(rng.randrange(5))] for _ in range(2)) for i in range(60)}
    side = lambda k: spark.createDataFrame([(i, n, h, t) for i, v in made.items() for n, (h, t) in enumerate(v[k])], "id long, chunk int, heading string, text string")
    rows = P.compared(side(0), side(1)).collect()
    for i, (old, new) in made.items():
        own = [r for r in rows if r.id == i]
        assert sorted(r.a for r in own if r.a is not None) == list(range(len(old))) and sorted(r.b for r in own if r.b is not None) == list(range(len(new)))
        named, best, score = slow(old, new)
        assert {(r.a, r.b) for r in own if r.how == "heading"} == set(named)
        ordered = sorted((r.a, r.b) for r in own if r.how == "order")
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(ordered, ordered[1:])) and abs(sum(score[p] for p in ordered) - best) < 1e-9
        free_a = [a for a in range(len(old)) if a not in {r.a for r in own if r.how in ("heading", "order")}]
        free_b = [b for b in range(len(new)) if b not in {r.b for r in own if r.how in ("heading", "order")}]
        assert sorted((r.a, r.b) for r in own if r.how == "position") == (list(zip(free_a, free_b, strict=True)) if len(free_a) == len(free_b) else [])
        for r in own:
            if r.how is None:
                assert r.kind == ("removed" if r.b is None else "added")
            elif words(old[r.a][1]) == words(new[r.b][1]):
                assert r.kind == "unchanged" and r.changed_words == 0
            else:
                assert r.kind in ("changed", "minor") and r.changed_words > 0 and (r.kind == "changed") == (r.change_ratio > 0.03 or r.changed_words >= 2)
