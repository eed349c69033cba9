"""The operators against brute force, on small made-up rows: nulls, empty texts, ties, repeated rows, empty tables and clashing columns among them."""

import hashlib
import json
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lectern.llm import bpe, exact_dedup, hnsw, html_extract, mixing, sharding, simhash, suffix_dedup, token_counts, toxicity

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, size long, digest string, fp long, score string"


def made(seed=3, n=60):
    """Documents with copies, near copies, nulls, white space only, one very long text and a repeated row; their columns clash with those of the operators."""
    rng = random.Random(seed)
    texts = [" ".join(rng.choice(WORDS) + str(rng.randint(0, 30)) for _ in range(rng.randint(1, 60))) for _ in range(n)]
    texts += texts[:10] + [t.upper() for t in texts[5:12]] + [t + " tail" for t in texts[12:20]]
    texts += [None, "", "   \n", None, "é" * 80, "x" * 70_000, "it's <|endoftext|> ÀÉ ñandú 12"]
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["a", "a", "a", "b", "c", None]), None, "i", 1, "d", 2, "s") for i, t in enumerate(texts)]
    return rows + [rows[3]]


@pytest.fixture(scope="module")
def rows():
    return made()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def closure(items, linked):
    label = dict.fromkeys(items)
    for x in sorted(items):
        if label[x] is None:
            todo, label[x] = [x], x
            while todo:
                y = todo.pop()
                for z in items:
                    if label[z] is None and linked(y, z):
                        label[z] = x
                        todo.append(z)
    return label


@pytest.mark.parametrize("block", [4096, 3])
def test_simhash(docs, rows, none, block):
    got = {r.id: (r.fp & (1 << 64) - 1, r.component_id) for r in simhash.components(docs, block=block).collect()}
    prints = {r[0]: slow_fingerprint(r[1]) for r in rows}
    label = closure(prints, lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    assert got == {i: (prints[i], label[i]) for i in prints}
    assert simhash.components(none).count() == 0


@pytest.mark.parametrize("block", [4096, 4])
def test_simhash_chains_and_blocks(spark, block):
    rng = random.Random(1)
    fps = {0}
    for _ in range(30):  # chains of fingerprints that differ in up to 3 bits, and some far ones
        x = rng.getrandbits(64)
        fps |= {x, x ^ 1, x ^ 7 << rng.randint(0, 61), x ^ 15 << rng.randint(0, 60)}
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    found = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), block=block)
    parts = {r.node: r.component for r in simhash.connected_components(found).collect()}
    label = closure(signed, lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 3)
    assert {x: parts.get(x, x) for x in signed} == label


@pytest.mark.parametrize("hot", [64, 0])
def test_suffix_dedup(spark, docs, rows, none, monkeypatch, hot):
    """With 0 every trigger is hot: all phrases are dealt to the buckets by their digest."""
    monkeypatch.setattr(suffix_dedup, "HOT_BATCHES", hot)
    first = {}
    for i, t, *_ in rows:
        b = (t or "").encode()
        for k in range(len(b) - 49):
            first[b[k : k + 50]] = min(i, first.get(b[k : k + 50], i))
    got = {}
    for r in suffix_dedup.remove_repeats(docs).collect():
        got[r.id] = (r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept))
    for i, t, *_ in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < i:
                gone[k : k + 50] = [True] * 50
        edges = [k for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1])]
        ends = [k + 1 for k in range(len(b)) if gone[k] and (k + 1 == len(b) or not gone[k + 1])]
        assert got[i] == (len(b), list(zip(edges, ends, strict=True)), bytes(c for c, g in zip(b, gone, strict=True) if not g))
    assert suffix_dedup.remove_repeats(none).count() == 0


def test_suffix_dedup_hot_triggers(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT_BATCHES", 0)
    passage = "the very same passage stands in each of these documents, word for word and comma for comma."
    df = spark.createDataFrame([(i, f"{i * 7919} begins {passage} and ends {i * 104729}") for i in range(40)], "doc_id long, text string")
    got = {r.id: r for r in suffix_dedup.remove_repeats(df).collect()}
    assert not got[0].spans and all(got[i].n_bytes - len(got[i].kept) >= len(passage) for i in range(1, 40))


def test_exact_dedup(spark, docs, rows, none):
    index = exact_dedup.DigestIndex(spark, "test_digests_a")
    index.drop()
    groups = {}
    for i, t, *_ in rows:
        key = (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        groups.setdefault(key, []).append(i)
    want = {i: (max(g), len(g), i == max(g), hashlib.sha256(k.encode()).hexdigest()) for k, g in groups.items() for i in g}
    assert {r.id: (r.keep_id, r.group_size, r.kept, r.digest) for r in exact_dedup.resolve(docs, index).collect()} == want
    again = exact_dedup.resolve(docs.limit(20), index)
    assert again.where("kept").count() == 0  # the index remembers
    assert exact_dedup.resolve(none, index).count() == 0
    index.drop()
    stay = exact_dedup.keep(docs, index)
    assert sorted(r.doc_id for r in stay.collect()) == sorted(i for i, w in want.items() if w[2]) and stay.columns == docs.columns
    index.drop()


@pytest.mark.parametrize(("ranges", "most"), [(65_536, 200_000), (8, 3)])
def test_sharding(docs, rows, none, ranges, most):
    got = sharding.shard(docs, 7, ranges=ranges, read_at_most=most).collect()
    assert len(got) == len(rows)
    text = {r[0]: r[1] or "" for r in rows}
    by_shard, of_text, sizes = {}, {}, {}
    for r in got:
        by_shard.setdefault(r.shard, []).append(r.slot)
        of_text.setdefault(text[r.id], set()).add(r.shard)
        sizes[r.shard] = sizes.get(r.shard, 0) + r.size
        assert r.size == len(text[r.id].encode()) + 16
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values()) and all(len(s) == 1 for s in of_text.values())
    total = {}
    for r in rows:
        k = hashlib.sha256((r[1] or "").encode()).hexdigest()
        total[k] = total.get(k, 0) + len((r[1] or "").encode()) + 16
    ends = np.cumsum([total[k] for k in sorted(total)]).tolist()
    assert max(sizes.values()) == sharding.smallest(ends, 7, max(total.values()))
    assert sharding.shard(none, 7).count() == 0


def test_mixing(spark, docs, rows, none):
    documents, pieces, slots = mixing.mix(docs, block_words=8)
    documents, taken = documents.collect(), {}
    for p in pieces.collect():
        taken[p.source, p.start] = taken.get((p.source, p.start), 0) + p.words * p.times
    assert len(documents) == len(rows)
    sizes = {}
    for d in documents:
        sizes[d.source] = sizes.get(d.source, 0) + d.size
        assert d.size == 0 or taken.get((d.source, d.start), 0) <= 3 * d.size
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, target, free, left = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, {}, set(names), sum(sizes.values())
    while free:  # the law, step by step
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3 * sizes[s]
            left -= target[s]
        free -= over
    for d in documents:
        assert d.source_size == sizes[d.source] and d.target == pytest.approx(target[d.source])
    for s in names:
        assert abs(sum(v for (x, _), v in taken.items() if x == s) - target[s]) <= 8 * 4
    assert sorted(map(tuple, slots.collect()), key=repr) == sorted(map(tuple, mixing.mix(docs, block_words=8)[2].collect()), key=repr)
    assert mixing.mix(none)[0].count() == 0 and mixing.mixed_documents(none).count() == 0
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    have = {r[0]: len((r[1] or "").split()) for r in rows}
    seen = {}
    for r in mixed.collect():
        seen[r.doc_id] = seen.get(r.doc_id, 0) + len(r.text.split())
    assert all(n <= 3 * 2 * have[i] for i, n in seen.items())


def test_bpe_and_counts(docs, rows, none):
    from tokenizers import Tokenizer

    path = bpe.default_vocabulary()
    library = Tokenizer.from_file(path)
    want = {i: library.encode(t or "", add_special_tokens=False).ids for i, t, *_ in rows}
    for r in bpe.encode(docs.select("doc_id", "text", F.lit(1).alias("ids")), path).collect():
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == want[r.doc_id] and r.n_tokens == len(want[r.doc_id])
        assert r.decoded == library.decode(want[r.doc_id], skip_special_tokens=False)
    assert {r.id: r.n_tokens for r in token_counts.counts(docs, path).collect()} == {i: len(w) for i, w in want.items()}
    assert bpe.encode(none, path).count() == 0 and token_counts.counts(none, path).count() == 0


def test_bpe_any_text():
    from tokenizers import Tokenizer

    path = bpe.default_vocabulary()
    library, cache, counter = Tokenizer.from_file(path), bpe.Cache(path), token_counts.Counter(path)
    rng = random.Random(9)
    parts = [*"aAbΣσİß1½٣!?'\t\n ", "'s", "'LL", "\x1c", "\x85", "　", "é", "漢字", "😀", "<|endoftext|>", "<|startoftext|>", "aaaaaaa", "\x00"]
    for _ in range(1500):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        ids = library.encode(text, add_special_tokens=False).ids
        (got, decoded), = bpe.encode_texts(cache, [text])
        assert np.frombuffer(got, "<u4").tolist() == ids and decoded == library.decode(ids, skip_special_tokens=False)
        assert counter.lengths([text]).tolist() == [len(ids)]


def test_toxicity(spark, docs, none):
    rng = random.Random(4)
    make = lambda bad: " ".join([rng.choice(WORDS) for _ in range(rng.randint(8, 40))] + (["vilewordx" + rng.choice("abc")] if bad else []))
    texts = [make(i % 3 == 0) for i in range(600)]
    model = toxicity.train(texts[:450], [int(i % 3 == 0) for i in range(450)], ["en"] * 450)
    score = toxicity.Scorer(model).scores([*texts[450:], None, "", "\n"])
    assert (((score[:150] >= 0.7) == [i % 3 == 0 for i in range(450, 600)]).mean() > 0.97) and ((score >= 0) & (score <= 1)).all()
    out = toxicity.with_scores(docs, model)
    assert out.count() == docs.count() and out.schema["score"].dataType.typeName() == "double"
    assert toxicity.train([], [], []).prior == 0.0 and toxicity.train(["a"], [1], [None]).prior == 1.0
    assert toxicity.with_scores(none, toxicity.train([], [], [])).count() == 0
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(30)] + [(None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int")
    x, y, _ = toxicity.sample(docs, labels)
    assert len(x) == len(y) > 0


def test_embeddings(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(300, 16))
    x = np.concatenate([base, base[:60] + rng.normal(0, 0.05, (60, 16)), base[:20], base[:5] * 3]).astype(np.float32)
    bad = [None, [0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, []]
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(len(x) + i, b) for i, b in enumerate(bad)], "vec_id long, embedding array<float>")
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    label = closure(range(len(x)), lambda a, b: near[a, b])
    want = {i: (int(near[i].sum()) - 1, label[i], label[i] == i) for i in range(len(x))} | {len(x) + i: (0, len(x) + i, True) for i in range(len(bad))}
    assert {r.id: (r.n_links, r.component_id, r.kept) for r in hnsw.near_duplicates(df, shards=3).collect()} == want
    assert hnsw.near_duplicates(df.limit(0)).count() == 0


def test_graph_recall_and_wide_groups():
    rng = np.random.default_rng(5)
    x = hnsw.unit(np.concatenate([rng.normal(size=(3000, 24)), rng.normal(size=24) * 6 + rng.normal(0, 0.3, (400, 24))]))
    shard = hnsw.Shard(np.arange(len(x)), x, np.ones(len(x), int), 0.95)
    row, partner = shard.near(x)
    found, true = {*zip(row.tolist(), shard.ids[partner].tolist(), strict=True)}, np.argwhere(x @ x.T >= 0.95)
    assert len(found) >= 0.99 * len(true) and found <= {(int(a), int(b)) for a, b in true}


def test_html():
    hits = sum(html_extract.main_text(page) == "\n".join(" ".join(html_extract.re.sub("<[^>]*>", "", page[a:b]).split()) for a, b in spans) for page, spans in html_extract.labelled_pages(40, seed=77))
    assert hits >= 38
    page = "<html><body><nav>menu one two</nav><article><h1>A &amp; B</h1><p>first  line\n here<b>bold</b></p><div class='ad'>buy this now</div><p>second &lt;x&gt;</p></article><footer>foot</footer>"
    assert html_extract.main_text(page) == "A & B\nfirst line herebold\nsecond <x>"
    assert html_extract.main_text(None) == html_extract.main_text("") == html_extract.main_text("<nav>only menu</nav>") == ""
    assert html_extract.main_text("<!-- open comment <p>x</p>") == ""


def test_html_frame(spark):
    df = spark.createDataFrame([(1, "u", None, "t"), (2, None, "<p>some words of text here</p>", "t"), (2, None, "<p>some words of text here</p>", "t")], "page_id long, url string, html string, text string")
    got = html_extract.extract(df)
    assert sorted(got.columns) == ["n_chars", "page_id", "text", "url"] and sorted((r.page_id, r.text, r.n_chars) for r in got.collect()) == [(1, "", 0), (2, "some words of text here", 23), (2, "some words of text here", 23)]
    assert json.dumps(html_extract.extract(df.limit(0)).collect()) == "[]"
