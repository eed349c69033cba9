"""Hard negatives of anchors by branch and bound over ball trees.

Every partition of the vectors holds one tree. A ball with centre c and radius r bounds the inner product of a query q with each of its members
from above and below by q.c + |q|r and q.c - |q|r; a node is left out where these bounds miss the query's score window, where they stay strictly beneath the k-th
score found so far (or meet it and every id in the node is larger), or where its labels can't do. Two passes ask every tree for every anchor: the first finds the anchor's
nearest rows of its own label, the second the best rows of other labels within the window that each of these sets. A tree answers with k rows
for each query, so the merge of the trees' answers follows the anchors and not the rows.

Components are integers after scaling, and squared norms are bounded, so inner products are exact in double precision and no order of summation changes a result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_batch, checkpointed, table

SHARDS = 12
#: Components of a tree's vectors: 32 MB as doubles.
MOST_IN_TREE = 4 << 20
LEAF = 128
#: Queries that descend a tree together.
TOGETHER = 2048
#: Vectors of a larger squared norm take no part: up to here any inner product, and 100 times it, is exact.
MOST_NORM = float(1 << 52)


class BallTree:
    """Vectors of one length with ids and labels. Rows are kept by node, and by id within a leaf."""

    def __init__(self, ids: np.ndarray, rids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        ids, rids, labels, vectors = ids[order], rids[order], labels[order], vectors[order]
        nodes: list[tuple] = []  # first row, end, left child, right child, smallest and largest label, smallest id
        centres, radii = [], []
        rows = np.arange(len(ids))

        def grow(lo: int, hi: int) -> int:
            own = rows[lo:hi]
            x = vectors[own]
            centre = x.mean(axis=0)
            far = ((x - centre) ** 2).sum(axis=1)
            at = len(nodes)
            nodes.append((lo, hi, -1, -1, labels[own].min(), labels[own].max(), ids[own].min()))
            centres.append(centre)
            radii.append(np.sqrt(far.max()))
            if hi - lo > LEAF:
                one = x[far.argmax()]
                other = x[((x - one) ** 2).sum(axis=1).argmax()]
                rows[lo:hi] = own[np.argsort(x @ (other - one), kind="stable")]  # halves; equal vectors are halved by id
                mid = (lo + hi) // 2
                left, right = grow(lo, mid), grow(mid, hi)
                nodes[at] = (lo, hi, left, right, *nodes[at][4:])
            else:
                rows[lo:hi] = np.sort(own)
            return at

        grow(0, len(ids))
        self.ids, self.rids, self.labels, self.vectors = ids[rows], rids[rows], labels[rows], vectors[rows]
        self.nodes, self.centres, self.radii = nodes, np.stack(centres), np.asarray(radii)
        self.reach = np.sqrt((self.centres**2).sum(axis=1)) + self.radii

    def best(self, q: np.ndarray, label: np.ndarray, own: np.ndarray, same: bool, low: np.ndarray, high: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, score, id) of the first k rows of each query by (larger score, smaller id): of its label and another rid than its own, or of other labels with low <= score <= high."""
        score, found = np.full((len(q), k), -np.inf), np.full((len(q), k), np.iinfo(np.int64).max)
        norms = np.sqrt((q**2).sum(axis=1))

        def bounds(node: int, some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            middle, wide = q[some] @ self.centres[node], norms[some] * self.radii[node]
            slack = 1e-9 * norms[some] * self.reach[node] + 1e-6
            return middle, np.floor(middle + wide + slack), np.ceil(middle - wide - slack)

        def open_to(node: int, some: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> np.ndarray:
            _, _, _, _, first, last, _ = self.nodes[node]
            fits = (label[some] >= first) & (label[some] <= last) if same else (label[some] != first) | (first != last)
            return fits & (upper >= low[some]) & (lower <= high[some])

        every = np.arange(len(q))
        middle, upper, lower = bounds(0, every)
        keep = open_to(0, every, upper, lower)
        todo = [(0, every[keep], upper[keep])]
        while todo:
            node, some, upper = todo.pop()
            lo, hi, left, right, _, _, least = self.nodes[node]
            keep = (upper > score[some, -1]) | (upper == score[some, -1]) & (least < found[some, -1])
            some = some[keep]
            if not len(some):
                continue
            if left < 0:
                self.merge(score, found, some, q, label, own, same, low, high, lo, hi)
                continue
            sides = []
            for child in (left, right):
                middle, upper, lower = bounds(child, some)
                # The children nearest to the top of the window come first.
                sides.append((child, np.abs(np.minimum(high[some], 2 * norms[some] * self.reach[child]) - middle), open_to(child, some, upper, lower), upper))
            (one, d1, ok1, up1), (two, d2, ok2, up2) = sides
            first = d1 <= d2
            for child, part, up in ((one, ok1 & ~first, up1), (two, ok2 & first, up2), (two, ok2 & ~first, up2), (one, ok1 & first, up1)):  # the last one is visited next
                if part.any():
                    todo.append((child, some[part], up[part]))
        r, c = np.nonzero(np.isfinite(score))
        return r, score[r, c].astype(np.int64), found[r, c]

    def merge(self, score: np.ndarray, found: np.ndarray, some: np.ndarray, q: np.ndarray, label: np.ndarray, own: np.ndarray, same: bool, low: np.ndarray, high: np.ndarray, lo: int, hi: int) -> None:
        """Compare the queries `some` with a leaf's rows and keep each query's first k."""
        s = q[some] @ self.vectors[lo:hi].T
        alike = label[some][:, None] == self.labels[lo:hi]
        good = alike & (own[some][:, None] != self.rids[lo:hi]) if same else ~alike & (s >= low[some][:, None]) & (s <= high[some][:, None])
        r, c = np.nonzero(good & (s >= score[some, -1][:, None]))
        if not len(r):
            return
        touched, k = np.unique(r), score.shape[1]
        row = np.concatenate([np.repeat(touched, k), r])
        points = np.concatenate([score[some[touched]].ravel(), s[r, c]])
        names = np.concatenate([found[some[touched]].ravel(), self.ids[lo:hi][c]])
        order = np.lexsort((names, -points, row))
        row = row[order]
        begins = np.flatnonzero(np.r_[True, np.diff(row) != 0])
        take = (begins[:, None] + np.arange(k)).ravel()
        score[some[touched]], found[some[touched]] = points[order][take].reshape(-1, k), names[order][take].reshape(-1, k)


def unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Each row's length, and all components one after the other."""
    column = batch.column("q")
    return np.diff(np.asarray(column.offsets)), np.asarray(column.flatten()).astype(np.float64)


def by_length(batches: list[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, dict[str, np.ndarray]]]:
    """(length, rows among all rows, columns) for each length of vectors."""
    if not batches:
        return
    sizes, flat = map(np.concatenate, zip(*map(unpacked, batches), strict=True))
    ends = np.cumsum(sizes)
    columns = {c: np.concatenate([np.asarray(b.column(c)) for b in batches]) for c in ("rid", "id", "label")}
    for n in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == n)
        at = (ends[rows] - n)[:, None] + np.arange(n)
        yield n, rows, {c: x[rows] for c, x in columns.items()} | {"q": flat[at]}


def ask_trees(rows: DataFrame, asks: DataFrame, shards: int, same: bool, k: int, percent: tuple[int, int]) -> DataFrame:
    """(rid, nth, score, id): the first k rows of every shard's tree for each query. asks: rid, id, label, q and wants, an array of (nth, score) that set a window each."""
    kept = ["rid", "id", "label", "q", "wants"]
    index = rows.select(F.pmod(F.xxhash64("rid"), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("kind"), "rid", "id", "label", "q", F.lit(None).cast("array<struct<nth:int,score:bigint>>").alias("wants"))
    spread = asks.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("kind"), *kept)
    schema = pa.schema([("rid", pa.int64()), ("nth", pa.int32()), ("score", pa.int64()), ("id", pa.int64())])

    def answers(trees: dict[int, BallTree], batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        wants = batch.column("wants")
        counts = np.diff(np.asarray(wants.offsets))
        flat = wants.flatten()
        nth, points = np.asarray(flat.field("nth")), np.asarray(flat.field("score"))
        begins = np.cumsum(counts) - counts
        for n, at, c in by_length([batch]):
            if n not in trees:
                continue
            which = np.repeat(np.arange(len(at)), counts[at])
            want = np.concatenate([np.arange(begins[i], begins[i] + counts[i]) for i in at.tolist()]).astype(np.int64)
            low, high = (np.full(len(want), -np.inf), np.full(len(want), np.inf)) if same else (-((-percent[0] * points[want]) // 100), percent[1] * points[want] // 100)
            for lo in range(0, len(want), TOGETHER):
                w = which[lo : lo + TOGETHER]
                r, score, ids = trees[n].best(c["q"][w], c["label"][w], c["rid"][w], same, low[lo : lo + TOGETHER].astype(np.float64), high[lo : lo + TOGETHER].astype(np.float64), k)
                yield arrow_batch(schema, [c["rid"][w][r], nth[want[lo + r]], score, ids])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        trees: dict[int, BallTree] | None = None
        for batch in batches:
            first = int(np.searchsorted(np.asarray(batch.column("kind")), 1))
            if first:
                held.append(batch.slice(0, first))
            if first < batch.num_rows:
                if trees is None:
                    trees, held = {n: BallTree(c["id"], c["rid"], c["label"], c["q"]) for n, _, c in by_length(held)}, []
                yield from answers(trees, batch.slice(first))

    # A partition is a shard; its index rows come before the queries.
    dealt = index.union(spread).repartitionById(shards, F.col("shard")).sortWithinPartitions("kind")
    return dealt.select("kind", *kept).mapInArrow(run, "rid long, nth int, score long, id long")


def first_of(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The first k rows of each key by (larger score, smaller id), numbered from 1 in `rank`."""
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame, anchors: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = 256, positives: int = 5, negatives: int = 10, percent: tuple[int, int] = (30, 90), shards: int | None = None
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor and each of its first positives, the first rows of other labels whose score lies within `percent` of the positive's.

    A score is the inner product of the vectors' components floor(scale * x). Rows with a null id or label, a null vector, or a null or non-finite component take no part, nor do those whose
    scaled components have a sum of squares above 2^52. Vectors of different lengths have no score with each other. Rows that repeat an id are rows of their own: a repeated anchor
    gives its rows again, and its copy may be its positive; equal scores come by id. Anchors without positives, and positives without negatives, give no row; an empty table gives none. `anchors` is a
    condition over the columns of `vectors`; columns of other names have no effect.
    """
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(anchors, F.lit(False)).alias("anchor"))
    rows = rows.where("id is not null and label is not null and v is not null").where(~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    scaled = rows.withColumn("v", F.transform(v, lambda x: F.floor(x * scale).cast("double")))  # a product beyond a long is cut off there, and out by its norm
    scaled = scaled.where(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x) <= MOST_NORM)
    rows = checkpointed(scaled.select(F.monotonically_increasing_id().alias("rid"), "id", "label", v.cast("array<int>").alias("q"), "anchor"))
    total = rows.agg(F.sum(F.size("q").cast("long"))).first()[0] or 0
    shards = shards or max(SHARDS, -(-total // MOST_IN_TREE))
    asks = rows.where("anchor").drop("anchor")
    one = F.array(F.struct(F.lit(0).alias("nth"), F.lit(0).cast("long").alias("score")))
    near = first_of(ask_trees(rows, asks.withColumn("wants", one), shards, True, positives, percent).drop("nth"), ["rid"], positives)
    near = checkpointed(near.select("rid", F.col("rank").alias("nth"), F.col("score").alias("positive_score"), F.col("id").alias("positive_id")))
    wants = near.groupBy("rid").agg(F.collect_list(F.struct("nth", F.col("positive_score").alias("score"))).alias("wants"))
    far = first_of(ask_trees(rows, asks.join(wants, "rid"), shards, False, negatives, percent), ["rid", "nth"], negatives)
    named = near.join(asks.select("rid", F.col("id").alias("anchor_id")), "rid")
    out = far.select("rid", "nth", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(named, ["rid", "nth"])
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of the embeddings whose vec_id is divisible by 100; labels of ids divisible by 7 move on by one."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", label.alias("label"))
    return hard_negatives(vectors, F.col("vec_id") % 100 == 0)


OP11_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label::BIGINT END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS alike, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, positive_id, (row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id))::INTEGER AS rank, s.id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.alike AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id) <= 10
"""
