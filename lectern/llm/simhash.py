"""SimHash near-duplicates by a segment-popcount embedding.

A 64-bit fingerprint is embedded as the bit counts of its 32 two-bit segments. Fingerprints that differ in d bits have counts at a
Manhattan distance of at most d, so a range join of radius 3 in that space loses no link. The space is cut in two halves of 16 axes; two
points within distance 3 are within distance 1 in one of them, and so either share a grid cell of that half or lie in cells that
differ by one step on one axis. Each fingerprint is put in its own cell of both halves and in the cells one step up; the candidates of a cell are
verified by the exact number of differing bits. Only distinct fingerprints take part, and each cell gives a spanning set of its
links rather than all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batch, by_bytes, checkpointed, connected_components, star_links

SEED = 42
HALF = 16
POWERS = 3 ** np.arange(HALF, dtype=np.int64)
CELLS = 3**HALF
#: Stages that no contract binds take shingles of five words.
STAGE_WORDS = 5
#: A cell with more fingerprints than this is compared block by block in several tasks.
BLOCK = 4096


def majority(hashes: np.ndarray) -> int:
    """The unsigned fingerprint of unsigned hashes: the bits that are set in over half of them."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536]
        ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, words: int = 3) -> int:
    """The unsigned fingerprint of a text: shingles of `words` words, repeats included; zero for a text without words."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    if len(tokens) <= words:
        shingles = [b" ".join(tokens)]
    elif words == 3:
        shingles = [b"%b %b %b" % x for x in zip(tokens, tokens[1:], tokens[2:], strict=False)]
    else:
        shingles = [b" ".join(tokens[i : i + words]) for i in range(len(tokens) - words + 1)]
    digest = xxhash.xxh64_intdigest
    return majority(np.fromiter((digest(s, SEED) for s in shingles), np.uint64, len(shingles)))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id, fp): the fingerprint of each row as a signed 64-bit long. A null text counts as empty."""
    schema = pa.schema([("id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", 8 << 20):
            fps = np.fromiter((fingerprint(x.as_py(), words) for x in batch.column(1)), np.uint64, batch.num_rows)
            yield arrow_batch(schema, [batch.column(0), fps.view(np.int64)])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, fp long")


def segment_counts(fps: np.ndarray) -> np.ndarray:
    """The bit counts of the 32 two-bit segments of each fingerprint."""
    pairs = fps.view(np.uint64)[:, None] >> (2 * np.arange(32, dtype=np.uint64))
    return ((pairs & np.uint64(1)) + ((pairs >> np.uint64(1)) & np.uint64(1))).astype(np.int64)


def grid(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cell, kind, fingerprint): kind 0 in the own cell of each half, kind 1 in the cells one step up on one axis."""
    counts = segment_counts(fps)
    out = []
    for half in (0, 1):
        part = counts[:, half * HALF : (half + 1) * HALF]
        own = part @ POWERS + half * CELLS
        out.append((own, np.zeros(len(fps), np.int8), fps))
        row, axis = np.nonzero(part < 2)
        out.append((own[row] + POWERS[axis], np.ones(len(row), np.int8), fps[row]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def cell_links(cell: np.ndarray, kind: np.ndarray, fps: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Verified links inside cells, contracted. Rows are sorted by cell, own fingerprints (kind 0) first in each."""
    bits = fps.view(np.uint64)
    left, right = [], []
    at, step = np.flatnonzero(kind == 0), 1
    while len(at):
        at = at[at + step < len(cell)]
        at = at[cell[at] == cell[at + step]]
        near = np.bitwise_count(bits[at] ^ bits[at + step]) <= most
        left.append(fps[at[near]])
        right.append(fps[at[near] + step])
        step += 1
        if step % 64 == 0:  # a large group of near fingerprints: keep a spanning set of what was found
            left, right = ([x] for x in star_links(np.concatenate(left), np.concatenate(right)))
    return star_links(np.concatenate(left), np.concatenate(right)) if left else (fps[:0], fps[:0])


def links(fps: DataFrame, most: int = 3, block: int = BLOCK) -> DataFrame:
    """(u, v): links whose components are those of all pairs of distinct fingerprints (column fp) with at most `most` <= 3 differing bits."""
    if not 0 <= most <= 3:
        raise ValueError("the grid is built for a radius of at most 3 bits")
    cells = pa.schema([("cell", pa.int64()), ("kind", pa.int8()), ("fp", pa.int64())])
    found = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 20_000):
                yield arrow_batch(cells, grid(np.asarray(batch.column(0).slice(at, 20_000))))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None
        for batch in batches:
            now = [np.asarray(batch.column(i)) for i in range(3)]
            if rest is not None:
                now = [np.concatenate(x) for x in zip(rest, now, strict=True)]
            cut = int(np.searchsorted(now[0], now[0][-1])) if len(now[0]) else 0
            rest = [x[cut:].copy() for x in now]
            yield arrow_batch(found, cell_links(*[x[:cut] for x in now], most))
        if rest is not None:
            yield arrow_batch(found, cell_links(*rest, most))

    rows = fps.select("fp").mapInArrow(spread, "cell long, kind byte, fp long")
    counts = rows.groupBy("cell").agg(F.count_if(F.col("kind") == 0).alias("own"), F.count_if(F.col("kind") == 1).alias("up"))
    blocks = [F.greatest(F.lit(1), F.ceil(F.col(c) / block)).cast("long").alias(f"{c}_blocks") for c in ("own", "up")]
    heavy = checkpointed(counts.where((F.col("own") > 0) & (F.col("own") + F.col("up") > block)).select("cell", *blocks))
    n_heavy = heavy.count()
    if n_heavy:
        # Heavy cells: own rows go to every pair of own blocks that has theirs and to every block of rows one step up, those to every own block; pairs are tasks of bounded size.
        heavy = F.broadcast(heavy) if n_heavy <= 10_000 else heavy
        rows = rows.join(heavy, "cell", "left")
        mine = lambda c: F.pmod(F.xxhash64("fp"), F.col(c))
        to = lambda c, f: F.transform(F.sequence(F.lit(0).cast("long"), F.col(c) - 1), f)
        task = lambda t, i, j: F.xxhash64("cell", F.lit(t), i, j).bitwiseOR(F.lit(1 << 62))
        pairs = to("own_blocks", lambda x: task("own", F.least(mine("own_blocks"), x), F.greatest(mine("own_blocks"), x)))
        beside = to("up_blocks", lambda x: task("up", mine("own_blocks"), x))
        above = to("own_blocks", lambda x: task("up", x, mine("up_blocks")))
        tasks = F.when(F.col("own_blocks").isNull(), F.array("cell")).when(F.col("kind") == 0, F.concat(pairs, beside)).otherwise(above)
        rows = rows.select(F.explode(tasks).alias("cell"), "kind", "fp")
    return rows.repartition("cell").sortWithinPartitions("cell", "kind").mapInArrow(compare, "u long, v long")


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, most: int = 3, block: int = BLOCK) -> DataFrame:
    """One row per document: (id, fp, component_id), where component_id is the smallest id reachable over links of at most `most` bits.

    Null and empty texts, and texts of white space only, have fingerprint zero and link like any other. Repeated rows with one id
    give equal rows. An empty table gives an empty result. Extra columns are ignored.
    """
    prints = checkpointed(fingerprints(docs, id_col, text_col, words))
    distinct = checkpointed(prints.groupBy("fp").agg(F.min("id").alias("first")))
    parts = connected_components(links(distinct, most, block))
    known = distinct.join(parts.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = known.groupBy("component").agg(F.min("first").alias("component_id"))
    ids = known.join(least, "component").select("fp", "component_id")
    return prints.join(ids, "fp").select("id", "fp", "component_id")


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for all documents."""
    from .common import table

    found = components(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
