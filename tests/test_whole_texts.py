"""Texts are compared as wholes, however long they are."""

import random

import numpy as np

from lectern.functions import sequences as S
from lectern.operators import alignment as A
from lectern.operators import chunk_pairs as P
from lectern.operators import differences as B
from lectern.plans import revisions

LONG = 41_000


def test_words_behind_the_forty_thousandth():
    old = [f"w{i % 977}" for i in range(LONG)]
    got = B.compare_words(" ".join([*old, "harbour", "at", "noon"]), " ".join([*old, "ferry", "at", "noon"]))
    assert (got["old_words"], got["new_words"], got["common"]) == (LONG + 3, LONG + 3, LONG + 2)
    assert (got["words_removed"], got["words_added"], got["words_modified"]) == (["harbour"], ["ferry"], [])


def test_sections_match_however_far_they_moved(spark, tmp_path):
    """The editor leaves out every fourth sentence: here one of twelve sections and more, so that what follows moves up by more than eight."""
    short = [f"alpha{k} beta{k} gamma{k}." for k in range(60)]
    gone = " ".join(f"lost{i}" for i in range(900)) + "."
    spark.createDataFrame([(1, " ".join([*short[:3], gone, *short[3:]]))], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = [(r.a, r.b) for r in revisions.ordered_matches(spark, str(tmp_path)).collect()]
    assert any(a - b > 8 for a, b in got)


def test_all_copies_of_a_sentence_take_part(spark):
    """40 copies of each sentence: pairing copies of `cat` with each other would leave the rest alone, so the largest sum pairs none of them, whichever copies they are."""
    short, cat, long = "the cat sat by the door of a hall.", "the cat sat by the door of a hall at ten.", "the cat sat by the door of a hall at ten to two."
    n = 40
    old, new = " ".join([*[short.capitalize()] * n, *[cat.capitalize()] * n]), " ".join([*[cat.capitalize()] * n, *[long.capitalize()] * n])
    rows = A.align(spark.createDataFrame([(1, old, new)], "doc_id long, old string, new string"), "doc_id", "old", "new").where("a is not null and b is not null").collect()
    want = n * max(1.0, S.ratio(short, cat) + S.ratio(cat, long))
    assert len({r.a for r in rows}) == len({r.b for r in rows}) == len(rows) and abs(sum(r.similarity for r in rows) - want) < 1e-9


def test_copies_are_shared_out_as_if_they_were_listed():
    rng = random.Random(3)
    for _ in range(300):
        n, m = rng.randint(1, 5), rng.randint(1, 5)
        edges = [(i, j, rng.choice([0.75, 0.8, 0.9, 1.0, rng.random() + 0.01])) for i in range(n) for j in range(m) if rng.random() < 0.6]
        if not edges:
            continue
        x, y, s = (np.array(c) for c in zip(*edges))
        of_a, of_b = (np.array([rng.choice([1, 1, 2, 5]) for _ in range(k)]) for k in (n, m))
        taken = S.shared_out(x, y, s, of_a, of_b)
        assert (taken >= 0).all() and all(taken[x == i].sum() <= of_a[i] for i in range(n)) and all(taken[y == j].sum() <= of_b[j] for j in range(m))
        listed = [(10 * i + p, 10 * j + q, z) for i, j, z in edges for p in range(of_a[i]) for q in range(of_b[j])]
        a, b, z = (np.array(c) for c in zip(*listed))
        assert abs((taken * s).sum() - z[S.assignment(a, b, z)].sum()) < 1e-9


def test_chunks_pair_by_all_their_words(spark):
    """Both chunks begin with 600 characters of their own and say the same behind; with one chunk more on one side they can't pair by position."""
    same = " ".join(f"common{k}" for k in range(200))
    chunk = lambda no, word: (1, no, "", " ".join(f"{word}{k}" for k in range(100)) + " " + same)
    frame = lambda rows: spark.createDataFrame(rows, "id long, chunk int, heading string, text string")
    rows = P.compared(frame([chunk(0, "old")]), frame([(1, 0, "", "something else"), chunk(1, "new")])).collect()
    assert sorted((r.a, r.b, r.how) for r in rows if r.a is not None) == [(0, 1, "order")] and [r.b for r in rows if r.kind == "added"] == [0]
