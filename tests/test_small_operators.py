"""Operators whose queries have no SQL, and sources and sinks, against brute force on rows of our own."""

import random
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import documents as D
from lectern.sources import sinks, tables
from lectern.streaming import limits

WORDS = [f"w{i}" for i in range(25)]


def decided(times, seconds, most):
    out, opened, n = [], None, 0
    for t in times:
        if opened is None or t >= opened + seconds:
            opened, n = t, 0
        n += 1
        out.append(n <= most)
    return out


def test_anchored_limit(spark):
    rng = random.Random(2)
    events = {k: sorted(rng.randint(0, 400) for _ in range(rng.randint(1, 40))) for k in range(6)}
    rows = [(k, i, t) for k, ts in events.items() for i, t in enumerate(ts)]
    df = spark.createDataFrame(rows, "k long, id long, t long").withColumn("ts", F.timestamp_seconds("t"))
    got = {(r.k, r.id): r.allowed for r in limits.anchored_decisions(df, "k", "ts", "id", 60.0, 3).collect()}
    assert got == {(k, i): a for k, ts in events.items() for i, a in enumerate(decided(ts, 60, 3))}


def test_anchored_stream(spark, tmp_path):
    """Two batches in order of time give the same decisions as one."""
    events = {1: [0, 10, 20, 30, 59, 60, 119, 121], 2: [5, 300, 301, 302, 303]}
    rows = [(k, float(t)) for k, ts in events.items() for t in ts]
    for n, bounds in enumerate(((-1, 25), (25, 1000))):
        spark.createDataFrame([r for r in rows if bounds[0] < r[1] <= bounds[1]], "k long, at double").coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
    stream = spark.readStream.schema("k long, at double").option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = limits.anchored_stream(stream, "k", 60.0, 3).writeStream.format("memory").queryName("decisions").option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        until = time.time() + 90
        while time.time() < until and spark.table("decisions").count() < len(rows):
            time.sleep(1)
    finally:
        query.stop()
    seen = sorted((r.key, r["at"], r.allowed) for r in spark.table("decisions").collect())
    assert seen == sorted((k, float(t), a) for k, ts in events.items() for t, a in zip(ts, decided(ts, 60, 3), strict=True))


@pytest.mark.parametrize("seed", range(3))
def test_chunks(spark, seed):
    rng = random.Random(seed)
    texts = ["", "short", "x" * 700, *("".join(rng.choice(["word", " ", ". ", "\n", "\n\n", "longerword"]) for _ in range(rng.randint(1, 400))) for _ in range(12))]
    got = {}
    for r in D.chunks(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 120, 15).orderBy("doc_id", "chunk_no").collect():
        got.setdefault(r.doc_id, []).append(r.chunk)
    for i, t in enumerate(texts):
        own = got.get(i, [])
        assert all(len(c) <= 135 for c in own)
        plain = [c if n == 0 else c[min(15, len(own[n - 1]) if n == 1 else 15):] for n, c in enumerate(own)]
        bare = lambda x: "".join(ch for ch in x if not ch.isspace() and ch != ".")
        assert len(bare("".join(own))) >= len(bare(t)) and (not own or bare(t).startswith(bare(plain[0])))


def test_word_differences_rebuild_the_new_text(spark):
    rng = random.Random(5)
    some = lambda: " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 20)))
    pairs = [(i, i + 100, some(), some()) for i in range(30)] + [(90, 91, None, "one"), (92, 93, "one", None)]
    found = {}
    for r in D.word_differences(spark.createDataFrame(pairs, "a long, b long, text_a string, text_b string")).collect():
        found.setdefault(r.a, []).append(r)
    for a, _, x, y in pairs:
        words = (x or "").split()
        for r in sorted(found.get(a, []), key=lambda r: -r.position):
            assert words[r.position : r.position + len(r.old.split())] == r.old.split()
            words[r.position : r.position + len(r.old.split())] = r.new.split()
        assert words == (y or "").split()


@pytest.mark.parametrize("least", [0.5, 0.8])
def test_similar_sets(spark, least):
    rng = random.Random(7)
    sets = {i: sorted(rng.sample(WORDS, rng.randint(1, 12))) for i in range(60)}
    sets |= {100 + i: sorted({*s[1:], "extra"}) for i, s in list(sets.items())[:25]}
    df = spark.createDataFrame([(i, "one" if i % 3 else None, s) for i, s in sets.items()], "id long, block string, words array<string>")
    want = {(a, b) for a in sets for b in sets if a < b and bool(a % 3) == bool(b % 3) and len({*sets[a]} & {*sets[b]}) >= least * len({*sets[a]} | {*sets[b]})}
    assert {(r.a, r.b) for r in D.similar_sets(df, least).collect()} == want


def test_sources_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b", c', None), (2, "x\ny", 1.5)], "k long, s string, v double")
    sinks.write_csv(df.coalesce(1), str(tmp_path / "csv"))
    back = spark.read.option("header", True).option("escape", '"').option("multiLine", True).schema(df.schema).csv(str(tmp_path / "csv"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    sinks.write_json_lines(df, str(tmp_path / "json"))
    assert sorted(map(tuple, spark.read.schema(df.schema).json(str(tmp_path / "json")).collect())) == sorted(map(tuple, df.collect()))
    (tmp_path / "hook").mkdir()
    (tmp_path / "hook/one.json").write_text('{"from": {"mail": "a@b"}}\nnot json\n[1, 2]\n')
    got = tables.webhook_payloads(spark, str(tmp_path / "hook")).select(F.try_variant_get("payload", "$.from.mail", "string").alias("mail"), F.col("payload").isNull().alias("bad")).collect()
    assert sorted(((r.mail or ""), r.bad) for r in got) == [("", False), ("", True), ("a@b", False)]
    (tmp_path / "chunks").mkdir()
    for n in (2, 10):
        (tmp_path / f"chunks/part_{n}.xml").write_text(f"<a>{n}</a>")
    assert sorted((r.name, r.sequence, r.content) for r in tables.chunk_files(spark, str(tmp_path / "chunks")).collect()) == [("part_10.xml", 10, "<a>10</a>"), ("part_2.xml", 2, "<a>2</a>")]


def test_small_functions(spark):
    row = spark.range(1).select(
        T.subset(F.array(F.lit("1")), F.array(F.lit("1"), F.lit("2"))).alias("in"), T.subset(F.array(F.lit("3")), F.array(F.lit("1"), F.lit("2"))).alias("out"), T.content_words(F.lit("The rate of a levy, by the board")).alias("content"), T.collapsed(F.lit(" a \n b ")).alias("collapsed"),
    ).first()
    assert row["in"] and not row["out"] and sorted(row.content) == ["board", "levy", "rate"] and row.collapsed == "a b"


def test_chunks_come_a_few_texts_at_a_time(spark, monkeypatch):
    """A task's batches hold the chunks of few texts, and all of them come: null, empty and long ones too."""
    rows = [(i, "ab. " * (i * 37 % 900)) for i in range(40)] + [(90, None), (91, "")]
    task = {}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, f, schema: task.update(run=f) or self)
    D.chunks(df)
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], ["doc_id", "text"])
    monkeypatch.setattr(D, "TEXTS", 8)
    out = [b.to_pylist() for b in task["run"](iter([batch]))]
    sizes = [len({r["doc_id"] for r in b}) for b in out]
    assert max(sizes) <= 8 and len(out) == 6
    assert [tuple(r.values()) for b in out for r in b] == [(d, n, c) for d, t in rows for n, c in enumerate(D.recursive_chunks(t or "", 1500, 150))]
