"""Sources of few words meet their targets as large ones do."""

import pytest

from lectern.llm import mixing

SCHEMA = "doc_id long, text string, source string, n_chars long"
SIZES = [*range(1, 12), 30, 63, 64, 65, 127, 128, 129, 190, 191, 192, 193, 200, 20_000]


def made():
    rows = []
    for k, size in enumerate(SIZES):
        words = [f"s{k}w{i}" for i in range(size)]
        for at in range(0, size, 37):
            rows.append((len(rows), " ".join(words[at : at + 37]), f"s{k:02}", 0))
    return rows


@pytest.mark.parametrize(("block_words", "flat"), [(64, False), (8, False), (64, True)])
def test_words_taken(spark, block_words, flat):
    """Flat drops the large source: targets then lie below the caps, and passes end within a block."""
    docs = spark.createDataFrame([r for r in made() if not flat or r[2] != f"s{len(SIZES) - 1:02}"], SCHEMA)
    documents, pieces, slots = mixing.mix(docs, block_words=block_words)
    target = {d.source: (d.target, d.source_size) for d in documents.collect()}
    taken, seen = dict.fromkeys(target, 0), {}
    for p in pieces.collect():
        taken[p.source] += p.words * p.times
        start = p.start + p.first
        for i in range(start, start + p.words):
            seen[p.source, i] = seen.get((p.source, i), 0) + p.times
    assert taken == {s: max(1, int(t + 0.5)) for s, (t, _) in target.items()}
    drawn = dict.fromkeys(target, 0)
    for r in slots.collect():
        drawn[r.source] += r.words
    assert drawn == taken
    for s, (_, size) in target.items():  # no word once more before all were taken
        turns = [seen.get((s, i), 0) for i in range(size)]
        assert max(turns) - min(turns) <= 1 and max(turns) <= 3


def test_mixed_words(spark):
    rows = made()
    docs = spark.createDataFrame(rows, SCHEMA)
    target = {d.source: d.target for d in mixing.mix(docs)[0].collect()}
    got, size = {}, {r[0]: set(r[1].split()) for r in rows}
    for r in mixing.mixed_documents(docs).collect():
        assert r.text and set(r.text.split()) <= size[r.doc_id]
        got[r.source] = got.get(r.source, 0) + len(r.text.split())
    assert got == {s: max(1, int(t + 0.5)) for s, t in target.items()}
