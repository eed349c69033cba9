"""Near copies by SimHash candidates and an exact set-similarity join: texts whose sets of five-word shingles have a Jaccard similarity of at least 0.8.

The fingerprints of simhash.py give the first candidates. Their radius of 3 bits reaches few of the pairs at 0.8 (these differ in 7 of 64 bits on
average and in up to 20), so the rest is found without them:

Shingles are ordered by one order for all texts, those that a sample finds frequent last. Two sets that are similar enough share a shingle among the first
n - ceil(0.8 n) + 1 of each, so only these prefixes are shuffled, and no pair is lost whatever the sample says. Neighbours by size, and neighbours in an order that each
shingle draws for itself, are compared first, which connects large groups. Components that share a prefix shingle after that are compared as wholes, block by block, so that a
large group meets the texts beside it without a row for each pair. Every link is verified by the size of
the intersection of the whole sets. Shingles are known by hashes of 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_bytes, checkpointed, connected_components
from .simhash import SEED, STAGE_WORDS, links as fingerprint_links, majority

#: The similarity that links two texts, NUMERATOR / DENOMINATOR, in whole numbers so that the bound itself counts.
NUMERATOR, DENOMINATOR = 4, 5
#: Texts in the sample, how many of them a frequent shingle is in, and how many frequent shingles are kept at most.
SAMPLE, FREQUENT, MOST_FREQUENT = 10_000, 8, 50_000
#: So many texts of two components are compared in one task.
BLOCK = 512
#: With so many neighbours in a shingle's own order a text is compared before the remaining pairs are looked for.
NEIGHBOURS = 2
#: The outlines of components of at most so many texts are looked at before these are compared.
FEW = 16
#: Neighbours are compared at once if they are such in one of so many of the smaller set's shingles, or share one that so many texts have.
OFTEN, LARGE = 40, 16


def hashed(text: str | None, words: int = STAGE_WORDS) -> np.ndarray:
    """The hashes of a text's shingles, repeats included. A shorter text is one shingle, the empty one where it has no words."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    digest = xxhash.xxh64_intdigest
    n = max(1, len(tokens) - words + 1)
    return np.fromiter((digest(b" ".join(tokens[i : i + words]), SEED) for i in range(n)), np.uint64, n)


def shingles(text: str | None, words: int = STAGE_WORDS) -> np.ndarray:
    """The distinct hashes of a text's shingles in ascending order."""
    return np.unique(hashed(text, words).view(np.int64))


def prefix(hashes: np.ndarray, frequent: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first shingles of a set, as many as two sets that are similar enough can't both go without sharing one."""
    most = len(hashes) - -(-NUMERATOR * len(hashes) // DENOMINATOR) + 1
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)
        late = frequent[at] == hashes
        hashes = np.concatenate([hashes[~late], hashes[late][np.argsort(rank[at[late]])]])
    return hashes[:most]


def outline(hashes: np.ndarray) -> bytes:
    """A set's parity by the last bits of its hashes: bits for about as many numbers as the set has, 512 at least."""
    size = max(512, 1 << (len(hashes) - 1).bit_length())
    return np.packbits(np.bincount(hashes & (size - 1), minlength=size).astype(np.uint8) & 1, bitorder="little").tobytes()


def within_outlines(a: bytes, b: bytes, n: int) -> bool:
    """Whether two sets of n shingles together can be similar enough by their outlines, which differ in no more bits than the sets in shingles. The larger outline is folded to the size of the other one."""
    x, y = (np.frombuffer(t, np.uint8) for t in (a, b))
    while len(x) != len(y):
        x, y = (x, y) if len(x) > len(y) else (y, x)
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    apart = int(np.bitwise_count(x ^ y).sum())
    return apart * (NUMERATOR + DENOMINATOR) <= n * (DENOMINATOR - NUMERATOR)


def frequent_shingles(texts: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles of a sample of texts (columns key, text) in ascending order, and their ranks by frequency."""
    share = texts.count() / SAMPLE
    sample = texts.where(F.pmod(F.xxhash64("key"), F.lit(max(1, int(share)))) == 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", 4 << 20):
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([shingles(x.as_py(), words) for x in batch.column("text")]))], ["shingle"])

    counted = sample.select("text").mapInArrow(run, "shingle long").groupBy("shingle").count().where(F.col("count") >= FREQUENT)
    found = counted.orderBy(F.desc("count"), "shingle").limit(MOST_FREQUENT).collect()
    names = np.array([r[0] for r in found], np.int64)
    order = np.argsort(names)
    return names[order], len(found) - order


def possible(a: str, b: str):
    """Whether two sets that have their first common shingle here can be similar enough, by their sizes and the places of the shingle."""
    rest = F.least(F.col(f"{a}n") - F.col(f"{a}pos"), F.col(f"{b}n") - F.col(f"{b}pos"))
    return rest * (NUMERATOR + DENOMINATOR) >= (F.col(f"{a}n") + F.col(f"{b}n")) * NUMERATOR


def by_outlines(pairs: DataFrame) -> DataFrame:
    """(u, v) of the pairs (u, u_n, u_outline, v, v_n, v_outline) that can be similar enough by the outlines of their sets."""

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.asarray(batch.column("u_n")).astype(np.int64) + np.asarray(batch.column("v_n"))
            good = [within_outlines(*x) for x in zip(batch.column("u_outline").to_pylist(), batch.column("v_outline").to_pylist(), sizes.tolist(), strict=True)]
            yield batch.select(["u", "v"]).filter(pa.array(good, pa.bool_()))

    return pairs.select("u", "u_n", "u_outline", "v", "v_n", "v_outline").mapInArrow(likely, "u long, v long")


def verified(pairs: DataFrame, texts: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """The pairs (u, v) whose sets are similar enough. Most pairs end by the outlines of their sets (nodes: node, row, key, n, outline); the texts (row, key, text) of both ends of the others meet by one exchange, and only those that stand in a pair are cut into sets."""

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "a", 2 << 20):
            us, vs = batch.column("u").to_pylist(), batch.column("v").to_pylist()
            sets: dict[int, np.ndarray] = {}
            held, good = 0, []
            for i, (u, v) in enumerate(zip(us, vs, strict=True)):
                for node, name in ((u, "a"), (v, "b")):
                    if node not in sets:
                        sets[node] = shingles(batch.column(name)[i].as_py(), words)
                        held += len(sets[node])
                x, y = sets[u], sets[v]
                both = np.intersect1d(x, y, assume_unique=True).size
                good.append(both * (NUMERATOR + DENOMINATOR) >= (len(x) + len(y)) * NUMERATOR)
                if held > 1 << 20:
                    sets.clear()
                    held = 0
            yield batch.select(["u", "v"]).filter(pa.array(good, pa.bool_()))

    drawn = nodes.select("node", "n", "outline")
    pairs = checkpointed(by_outlines(pairs.join(drawn.toDF("u", "u_n", "u_outline"), "u").join(drawn.toDF("v", "v_n", "v_outline"), "v")))
    lead = nodes.select("node", "row", "key")
    asked = pairs.join(lead.toDF("u", "u_row", "u_key"), "u").join(lead.toDF("v", "v_row", "v_key"), "v")
    found = asked.join(texts.select(F.col("row").alias("u_row"), F.col("key").alias("u_key"), F.col("text").alias("a")), ["u_key", "u_row"])
    found = found.join(texts.select(F.col("row").alias("v_row"), F.col("key").alias("v_key"), F.col("text").alias("b")), ["v_key", "v_row"])
    return found.select("u", "v", "a", "b").mapInArrow(similar, "u long, v long").distinct()


def bridges(across: DataFrame, texts: DataFrame, nodes: DataFrame, parts: DataFrame, words: int, block: int) -> DataFrame:
    """(u, v): a link from each node to the component `large` that it is held against, where there is one.

    The members of the component are dealt over blocks, and the nodes are compared with each block, in tasks of at most about `block` texts of
    either kind. No row is made for a pair: a text gives at most one link for each block.
    """
    members = nodes.select("node", "row", "key").join(parts, "node", "left").withColumn("part", F.coalesce("component", "node")).drop("component")
    members = checkpointed(members.join(across.select(F.col("large").alias("part")).distinct(), "part"))
    sizes = members.groupBy("part").agg(F.count("*").alias("n"))
    asks = checkpointed(across.join(nodes.select("node", "row", "key"), "node"))
    many = lambda n: F.ceil(F.col(n) / block).cast("long")
    blocks = asks.groupBy("large").agg(F.count("*").alias("m")).join(sizes.withColumnRenamed("part", "large"), "large").select("large", many("m").alias("is"), many("n").alias("js"))
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    every = lambda n: F.explode(F.expr(f"sequence(0L, {n} - 1)"))
    right = asks.join(blocks, "large").select("large", own("is").alias("i"), every("js").alias("j"), F.lit(1).alias("side"), "node", "row", "key")
    left = members.withColumnRenamed("part", "large").join(blocks, "large").select("large", every("is").alias("i"), own("js").alias("j"), F.lit(0).alias("side"), "node", "row", "key")
    rows = left.union(right).join(texts.select("key", "row", "text"), ["key", "row"]).select("large", "i", "j", "side", "node", "text")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, nodes, sets = None, [], []
        every = starts = sizes = np.zeros(0, np.int64)
        for batch in by_bytes(batches, "text", 2 << 20):
            names = zip(*[batch.column(c).to_pylist() for c in ("large", "i", "j")], strict=True)
            u, v = [], []
            for at, (name, side, node) in enumerate(zip(names, batch.column("side").to_pylist(), batch.column("node").to_pylist(), strict=True)):
                if name != group:
                    group, nodes, sets, every = name, [], [], None
                x = shingles(batch.column("text")[at].as_py(), words)
                if side == 0:
                    nodes.append(node)
                    sets.append(x)
                    continue
                if every is None:
                    sizes = np.array([len(y) for y in sets])
                    every, starts = (np.concatenate(sets), np.cumsum(sizes) - sizes) if sets else (np.zeros(0, np.int64), sizes)
                if len(every):
                    both = np.add.reduceat(x[np.minimum(np.searchsorted(x, every), len(x) - 1)] == every, starts)
                    hit = np.flatnonzero(both * (NUMERATOR + DENOMINATOR) >= (sizes + len(x)) * NUMERATOR)
                    if len(hit):
                        u.append(node)
                        v.append(nodes[hit[0]])
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    dealt = rows.repartition("large", "i", "j").sortWithinPartitions("large", "i", "j", "side")
    return dealt.mapInArrow(compared, "u long, v long").where("u <> v")


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = STAGE_WORDS, block: int = BLOCK, bits: int = 3) -> DataFrame:
    """One row per document: (id, component_id), where component_id is the smallest id reachable over links of similar texts.

    Null and empty texts, and texts of white space only, have equal sets and link with each other only. Equal sets are one node. An empty table
    gives an empty result. Extra columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    number = F.col(id_col).cast("long")
    texts = docs.select(number.alias("id"), F.coalesce(number, F.lit(-(1 << 63))).alias("row"), F.xxhash64(text).alias("key"), text.alias("text"))
    frequent, rank = frequent_shingles(texts, words)

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", 2 << 20):
            every = [hashed(x.as_py(), words) for x in batch.column("text")]
            sets = [np.unique(h.view(np.int64)) for h in every]
            nodes = [xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) for s in sets]
            prints = np.fromiter(map(majority, every), np.uint64, len(every)).view(np.int64)
            firsts = pa.array([prefix(s, frequent, rank) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("row"), batch.column("key"), pa.array(nodes, pa.int64()), pa.array(prints), pa.array(map(len, sets), pa.int32()), firsts, pa.array(map(outline, sets), pa.binary())], ["id", "row", "key", "node", "fp", "n", "firsts", "outline"])

    rows = checkpointed(texts.mapInArrow(described, "id long, row long, key long, node long, fp long, n int, firsts array<long>, outline binary"))
    nodes = checkpointed(rows.groupBy("node").agg(F.min("id").alias("first"), F.min(F.struct("row", "key")).alias("lead"), F.min("fp").alias("fp"), F.first("n").alias("n"), F.first("outline").alias("outline")).select("node", "first", "lead.*", "fp", "n", "outline"))
    places = rows.groupBy("node").agg(F.first("n").alias("n"), F.first("firsts").alias("firsts")).select("node", "n", F.posexplode("firsts").alias("pos", "shingle"))
    bucket = Window.partitionBy("shingle")
    drawn = bucket.orderBy(F.xxhash64("shingle", "node"), "node")
    before = {"s": (bucket.orderBy("n", "node"), 1)} | {f"h{k}": (drawn, k) for k in range(1, NEIGHBOURS + 1)}
    places = places.withColumn("many", F.count("*").over(bucket)).where("many > 1")
    shared = checkpointed(places)
    lagged = shared.select("*", *[F.lag(c, at).over(w).alias(f"{k}_{c}") for k, (w, at) in before.items() for c in ("node", "n", "pos")])

    # Candidates: one fingerprint and fingerprints near each other; neighbours that share a prefix shingle.
    one = nodes.groupBy("fp").agg(F.min("node").alias("lead"))
    near = fingerprint_links(one.select("fp"), bits)
    a, b = one.select(F.col("fp").alias("u"), F.col("lead").alias("a")), one.select(F.col("fp").alias("v"), F.col("lead").alias("b"))
    ordered = lambda df, x, y: df.select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).where("u <> v")
    pairs = ordered(near.join(a, "u").join(b, "v"), "a", "b").union(ordered(nodes.join(one, "fp"), "node", "lead"))
    sides = [F.struct(F.greatest("node", f"{k}_node").alias("u"), F.least("node", f"{k}_node").alias("v"), F.least("n", f"{k}_n").alias("n"), (possible("", f"{k}_")).alias("fits")) for k in before]
    beside = lagged.select("many", F.explode(F.array(*sides)).alias("x")).where("x.fits and x.u <> x.v").groupBy("x.u", "x.v").agg(F.count("*").alias("c"), F.max("x.n").alias("n"), F.max("many").alias("many"))
    # Texts that meet in few places only share a passage as a rule; what these leave out is looked for below. In a large group neighbours are drawn, and meet seldom.
    beside = beside.where((F.col("c") * OFTEN >= F.col("n")) | (F.col("many") > LARGE)).select("u", "v")
    links = checkpointed(verified(checkpointed(pairs.union(beside).distinct()), texts, nodes, words))
    parts = checkpointed(connected_components(links))

    # Texts with members of a larger component (or one of a smaller number) that might still be linked.
    parts_of = parts.groupBy("component").agg(F.count("*").alias("m"))
    known = shared.select("shingle", "node", "n", "pos").join(parts.join(parts_of, "component"), "node", "left").select("shingle", "node", "n", "pos", F.coalesce("component", "node").alias("part"), F.coalesce("m", F.lit(1)).alias("m"))
    held = known.groupBy("shingle", F.col("part").alias("large"), F.col("m").alias("large_m")).agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max(F.col("n") - F.col("pos")).alias("left"))
    larger = (F.col("m") < F.col("large_m")) | ((F.col("m") == F.col("large_m")) & (F.col("part") > F.col("large")))
    sized = (F.col("low") * NUMERATOR <= F.col("n") * DENOMINATOR) & (F.col("n") * NUMERATOR <= F.col("high") * DENOMINATOR)
    # The first common shingle of two such sets leaves enough behind it in both, so a shingle that many texts have late among theirs brings no pair.
    first = F.least(F.col("n") - F.col("pos"), F.col("left")) * (NUMERATOR + DENOMINATOR) >= (F.col("n") + F.col("low")) * NUMERATOR
    likely = checkpointed(known.join(held, "shingle").where(larger & sized & first).select("node", "large", "large_m").distinct())
    # A row for each pair that the outlines of both sets decide; of a component with more than FEW texts all pairs are looked at.
    drawn = nodes.select("node", "n", "outline")
    members = drawn.join(parts.join(parts_of, "component"), "node", "left").where(F.coalesce("m", F.lit(1)) <= FEW).select(F.coalesce("component", "node").alias("v"), F.col("n").alias("v_n"), F.col("outline").alias("v_outline"))
    met = likely.where(F.col("large_m") <= FEW).select(F.col("node").alias("u"), F.col("large").alias("v")).join(drawn.toDF("u", "u_n", "u_outline"), "u").join(members, "v")
    met = by_outlines(met).distinct().toDF("node", "large")
    across = checkpointed(met.union(likely.where(F.col("large_m") > FEW).select("node", "large")))
    more = checkpointed(bridges(across, texts, nodes, parts, words, block))

    parts = connected_components(parts.select(F.col("node").alias("u"), F.col("component").alias("v")).union(more))
    last = nodes.select("node", "first").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = last.groupBy("component").agg(F.min("first").alias("component_id"))
    return rows.select("id", "node").join(last.join(least, "component").select("node", "component_id"), "node").select("id", "component_id")
