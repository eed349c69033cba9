"""The near-copy stage of the pipeline against brute-force Jaccard similarity."""

import random

import pytest

import corpus_pipeline
from lectern.llm import near_copies

SCHEMA = "doc_id long, text string"


def slow_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def slow_labels(rows):
    """The smallest id reachable over pairs with 5-word Jaccard >= 0.8."""
    sets, label = {i: slow_set(t) for i, t in rows}, {}
    for i in sorted(sets):
        if i not in label:
            todo, label[i] = [i], i
            while todo:
                x = todo.pop()
                for y in sets:
                    if y not in label and 5 * len(sets[x] & sets[y]) >= 4 * len(sets[x] | sets[y]):
                        label[y] = i
                        todo.append(y)
    return label


def made():
    rng = random.Random(6)
    some = lambda n: [f"w{rng.randint(0, 5000)}" for _ in range(n)]
    line, rows = some(30), []
    for _ in range(12):
        base = some(rng.choice([6, 40, 120, 400]))
        rows.append(base)
        for _ in range(4):  # few to many changed words, and copies of copies
            copy = list(rng.choice(rows[-3:]))
            for _ in range(rng.randint(0, max(1, len(copy) // 50))):
                copy[rng.randrange(len(copy))] = "changed"
            rows.append(copy)
        rows.append(line + some(rng.choice([2, 5, 20])))  # one passage in texts that else differ
    nine = [f"n{i}" for i in range(13)]  # 9 shingles, and 10 and 12 with more words: 0.9 and 0.75
    rows += [nine, [*nine, "x"], [*nine, "y", "z", "u"], ["one", "two"], ["ONE", "Two"]]
    texts = [" ".join(r) for r in rows] + ["", None, " \n "]
    return list(enumerate(texts))


@pytest.mark.parametrize(("block", "frequent"), [(2048, 8), (3, 2)])
def test_all_pairs(spark, monkeypatch, block, frequent):
    monkeypatch.setattr(near_copies, "FREQUENT", frequent)
    rows = made()
    want = slow_labels(rows)
    assert 10 < len(set(want.values())) < len(want)
    got = {r.id: r.component_id for r in near_copies.components(spark.createDataFrame(rows, SCHEMA), block=block).collect()}
    assert got == want


def test_empty(spark):
    assert near_copies.components(spark.createDataFrame([], SCHEMA)).count() == 0


def test_stage(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = slow_labels([(r.doc_id, r.text) for r in docs.collect()])
    got = corpus_pipeline.drop_near_copies(spark, docs, "/root/testdata/sf0.01")
    assert sorted(r.doc_id for r in got.collect()) == sorted(i for i, x in want.items() if i == x) and got.columns == docs.columns
