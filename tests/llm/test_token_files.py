"""Token files against the library, and what a reader of a part of them opens."""

import glob
import random
import zlib
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from lectern.llm import token_files as tf

FOLDER = "/root/testdata/sf0.001"
ODD = ["", None, "a", " a b  c\n\n d\t", "x\x1cy \x1d z", "<|endoftext|>", "no <|endoftext|> here<|endoftext|>", "ÄÖ ß 漢字 かな　和", "it's we'll 12 345!?  \r\n", " ", "\n", "é  x y", "naïve" * 50]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tf.default_vocabulary())


def want(library, texts):
    return [library.encode(t or "", add_special_tokens=False).ids + [0] for t in texts]


def test_op13_equals_library(spark, library):
    docs = sorted(spark.read.parquet(f"{FOLDER}/documents.parquet").collect())
    ids = want(library, [r.text for r in docs])
    starts = [0, *accumulate(map(len, ids))]
    expected = [(r.doc_id, s, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for r, x, s in zip(docs, ids, starts[:-1], strict=True)]
    assert sorted(tuple(r) for r in tf.op13_token_files(spark, FOLDER).select("doc_id", "start", "n_tokens", "ids_crc32").collect()) == expected


def test_random_texts(library):
    rng = random.Random(4)
    texts = ODD + ["".join(rng.choice(["a", "B", " ", "  ", "\n", ".", "'s", "7", "é", "漢", "\t", "<|endoftext|>", " ", "　", "\u200b", "\u2003", "\x85", "\x1c", "\x00", "<|", "|>", "&", "-"]) for _ in range(rng.randrange(300))) for _ in range(400)]
    model, given = tf.Encoder(tf.default_vocabulary(), 0), pa.array(texts, pa.string())
    assert model.cuts and model.documents(given).to_pylist() == want(library, texts)
    assert model.documents(given[7:90]).to_pylist() == want(library, texts[7:90])
    assert model.documents(given[:0]).to_pylist() == []
    long = "".join(t or "" for t in texts) * 20
    assert model.documents(pa.array([long, None, long])).to_pylist() == want(library, [long, None, long])


def test_cache_begins_anew(library, monkeypatch):
    monkeypatch.setattr(tf, "CACHE_PIECES", 3)
    model = tf.Encoder(tf.default_vocabulary(), 0)
    for texts in (["a b c d e"], ["a b x y"], ["c d e f"]):
        assert model.documents(pa.array(texts, pa.string())).to_pylist() == want(library, texts)
    for texts in ([" a b a b"] * 3, ["a c a"], ["a b"]):
        assert model.documents(pa.array(texts)).to_pylist() == want(library, texts)


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_files_can_be_read_in_parts(spark, tmp_path, library, encoding):
    rng = random.Random(6)
    texts = [" ".join(rng.choice("alpha beta gamma delta epsilon".split()) for _ in range(rng.randrange(40))) for _ in range(3000)]
    docs = spark.createDataFrame([(i * 2, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, start string, ids int")
    folder = f"{tmp_path}/files"
    tf.write(docs, folder, tf.default_vocabulary(), encoding=encoding, row_group_bytes=8 << 10, page_bytes=1 << 10, page_rows=20)
    ids = want(library, texts)
    stream, starts = [x for y in ids for x in y], [0, *accumulate(map(len, ids))]
    assert sorted(tuple(r) for r in tf.metadata(spark, folder).collect()) == [(i * 2, starts[i], len(ids[i])) for i in range(len(texts))]
    assert {r.doc_id: r.ids for r in tf.tokens_of(spark, folder, 1001, 1100).collect()} == {i * 2: ids[i] for i in range(501, 551)}
    for lo, hi in ((0, 1), (17, 4000), (starts[-1] - 3, starts[-1] + 9), (500, 500)):
        parts = sorted(tf.tokens_between(spark, folder, lo, hi).collect(), key=lambda r: r.start)
        assert [x for r in parts for x in r.ids] == stream[lo:hi]
        assert not parts or parts[0].start == lo
    plan = tf.tokens_of(spark, folder, 1001, 1100)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(doc_id,1001)" in plan
    assert "ids" not in tf.metadata(spark, folder)._jdf.queryExecution().executedPlan().toString()
    groups = [pq.ParquetFile(f).metadata.row_group(k) for f in glob.glob(f"{folder}/*.parquet") for k in range(pq.ParquetFile(f).metadata.num_row_groups)]
    assert len(groups) > 4
    for g in groups:
        columns = {g.column(i).path_in_schema: g.column(i) for i in range(g.num_columns)}
        assert all(c.has_offset_index and c.has_column_index for c in columns.values())
        assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings
        assert ("RLE_DICTIONARY" if encoding == "dictionary" else "DELTA_BINARY_PACKED") in columns["ids.list.element"].encodings


def test_odd_tables(spark, tmp_path, library):
    rows = [(None, "no id"), (None, None), (3, "b"), (3, "b"), (3, "a"), (1, ""), (9, "long " * 1000)]
    tf.write(spark.createDataFrame(rows, "doc_id long, text string"), f"{tmp_path}/a", tf.default_vocabulary())
    got = sorted(tf.metadata(spark, f"{tmp_path}/a").collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, None, 1, 3, 3, 3, 9]
    assert [r.start for r in got] == [0, *accumulate(r.n_tokens for r in got)][:-1]
    assert sorted(r.n_tokens for r in got) == sorted(map(len, want(library, [t for _, t in rows])))
    tf.write(spark.createDataFrame([], "doc_id long, text string"), f"{tmp_path}/b", tf.default_vocabulary())
    assert tf.metadata(spark, f"{tmp_path}/b").collect() == []
    assert tf.tokens_between(spark, f"{tmp_path}/b", 0, 5).collect() == []
