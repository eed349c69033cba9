"""The registered queries and the pipeline on the smallest tables."""

import hashlib
import re
import zlib
from itertools import accumulate

import duckdb
import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from lectern.llm import bpe, queries, sharding, toxicity
from lectern.llm.mixing import mixed_documents

FOLDER = "/root/testdata/sf0.001"


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(r[i] for i in order) for r in rows], key=repr)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    df, want = queries.QUERIES[name](spark, FOLDER), con.sql(queries.SQL[name])
    assert plain(df.collect(), df.columns) == plain(want.fetchall(), want.columns)


@pytest.fixture(scope="module")
def documents(spark):
    return sorted(spark.read.parquet(f"{FOLDER}/documents.parquet").collect())


def rows_of(spark, name):
    return {r.doc_id: r for r in queries.QUERIES[name](spark, FOLDER).collect()}


def classes(ids, linked):
    """The smallest id reachable from each, by all pairs."""
    label = {}
    for i in sorted(ids):
        if i not in label:
            todo, label[i] = [i], i
            while todo:
                y = todo.pop()
                for z in ids:
                    if z not in label and linked(y, z):
                        label[z] = i
                        todo.append(z)
    return label


def test_op1_against_brute_force(spark, documents):
    prints = {}
    for r in documents:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in r.text or ""))
        shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
        prints[r.doc_id] = sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))
    label = classes(prints, lambda y, z: (prints[y] ^ prints[z]).bit_count() <= 3)
    assert {i: (r.fingerprint, r.component_id) for i, r in rows_of(spark, "op1_simhash").items()} == {i: (f"{prints[i]:016x}", label[i]) for i in prints}


def test_op2_against_brute_force(spark, documents):
    first, want = {}, {}
    for r in documents:
        data = (r.text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - 49):
            if first.setdefault(data[i : i + 50], r.doc_id) < r.doc_id:
                gone[i : i + 50] = b"\1" * 50
        left = bytes(x for x, g in zip(data, gone, strict=True) if not g)
        want[r.doc_id] = (len(data), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(left).hexdigest())
    assert {i: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for i, r in rows_of(spark, "op2_suffix_dedup").items()} == want


def test_op3_and_op6_against_the_library(spark, documents):
    library = Tokenizer.from_file(bpe.default_vocabulary())
    sha, want3, want6 = lambda x: hashlib.sha256(x).hexdigest(), {}, {}
    for r in documents:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want3[r.doc_id] = (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(library.decode(ids, skip_special_tokens=False).encode()))
        want6[r.doc_id] = (len((r.text or "").encode()), len(ids), len(ids) > 2048)
    assert {i: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for i, r in rows_of(spark, "op3_bpe").items()} == want3
    assert {i: (r.n_bytes, r.n_tokens, r.over_limit) for i, r in rows_of(spark, "op6_token_counts").items()} == want6


def test_op4_learns_from_the_open_rows_only(spark):
    """On the next larger tables, as the smallest have too few labels to learn from."""
    folder = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in queries.QUERIES["op4_toxicity"](spark, folder).collect()}
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    for i, r in rows.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    held = [r for r in spark.read.parquet(f"{folder}/labels.parquet").collect() if r.doc_id in rows and rows[r.doc_id].held_out]
    assert len(held) > 50 and sum(rows[r.doc_id].predicted == r.toxic for r in held) >= 0.9 * len(held)


def test_op5_against_the_law(spark, documents):
    got = rows_of(spark, "op5_sharding")
    shards = {}
    for r in documents:
        data, g = (r.text or "").encode(), got[r.doc_id]
        assert (g.size, g.text_crc32, g.law, g.grown_shard) == (len(data) + 16, zlib.crc32(data), "bytes", None) and 0 <= g.shard < 40
        shards.setdefault(g.shard, []).append((g.slot, g.size))
    assert all(sorted(s for s, _ in x) == list(range(len(x))) for x in shards.values())
    assert len({(r.text or "", got[r.doc_id].shard) for r in documents}) == len({r.text or "" for r in documents})
    assert len(shards) == 40
    groups = {}
    for r in documents:
        key = hashlib.sha256((r.text or "").encode()).digest()
        groups[key] = groups.get(key, 0) + got[r.doc_id].size
    ends = list(accumulate(groups[k] for k in sorted(groups)))
    assert max(sum(n for _, n in x) for x in shards.values()) == sharding.smallest(ends, 40, max(groups.values()))


def shares(sizes):
    """Targets by handing out what is left over and over again."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        rate = left / sum(weight[s] for s in free)
        over = {s for s in free if rate * weight[s] > 3 * sizes[s]}
        if not over:
            return target | {s: rate * weight[s] for s in free}
        target |= {s: 3.0 * sizes[s] for s in over}
        left -= sum(3.0 * sizes[s] for s in over)
        free -= over
    return target


def test_op9_against_its_targets(spark, documents):
    got, sizes, taken = rows_of(spark, "op9_mixing"), {}, {}
    for r in documents:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        assert got[r.doc_id].size == n and got[r.doc_id].taken <= 3 * n
        sizes[r.source] = sizes.get(r.source, 0) + n
        taken[r.source] = taken.get(r.source, 0) + got[r.doc_id].taken
    target = shares(sizes)
    for r in documents:
        assert got[r.doc_id].source_size == sizes[r.source] and abs(got[r.doc_id].target - target[r.source]) < 1e-6 * max(1, target[r.source])
    assert all(abs(taken[s] - target[s]) <= 1 for s in sizes)


def test_pipeline_against_brute_force(spark, documents):
    """Toxicity, copies and near copies by all pairs; the mix by its targets and the words of its texts; the encoding by the library. All columns of run() are compared."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = toxicity.train(*toxicity.sample(docs, spark.read.parquet(f"{FOLDER}/labels.parquet")))
    rows = [r for r, s in zip(documents, toxicity.Scorer(model).scores([r.text for r in documents]), strict=True) if s < toxicity.THRESHOLD]
    last = {"".join(c.lower() if c.isascii() else c for c in r.text or ""): r for r in rows}
    rows = sorted(last.values())
    sets = {}
    for r in rows:
        words = (r.text or "").encode().lower().split()
        sets[r.doc_id] = {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}
    label = classes(sets, lambda y, z: 5 * len(sets[y] & sets[z]) >= 4 * len(sets[y] | sets[z]))
    kept = [r for r in rows if label[r.doc_id] == r.doc_id]
    mixed = mixed_documents(spark.createDataFrame(kept, docs.schema)).collect()
    by_id = {r.doc_id: r for r in kept}
    sizes, taken = {}, {}
    for r in kept:
        sizes[r.source] = sizes.get(r.source, 0) + len((r.text or "").split())
    for r in mixed:
        words = iter(by_id[r.doc_id].text.split())
        assert all(w in words for w in r.text.split()) and r.n_chars == len(r.text)  # words of the document, in its order
        taken[r.source] = taken.get(r.source, 0) + len(r.text.split())
    assert all(abs(taken.get(s, 0) - t) <= 1 for s, t in shares(sizes).items())
    library = Tokenizer.from_file(bpe.default_vocabulary())
    want = []
    for r in mixed:
        ids = library.encode(r.text, add_special_tokens=False).ids
        want.append((r.doc_id, r.lang, r.source, len(ids), np.array(ids, "<u4").tobytes(), library.decode(ids, skip_special_tokens=False)))
    got = corpus_pipeline.run(spark, FOLDER)
    assert got.columns == ["doc_id", "lang", "source", "n_tokens", "ids", "decoded"]
    assert sorted([(*r[:4], bytes(r[4]), r[5]) for r in got.collect()], key=repr) == sorted(want, key=repr)


def test_stage_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash", "mixing", "bpe"]
