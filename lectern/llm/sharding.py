"""Minimax contiguous sharding of atomic groups.

Rows with equal texts form a group that stays together. Groups are ordered by the digest of their text, and the ordered sizes are cut into a
fixed number of contiguous shards so that the largest shard is as small as possible: the smallest capacity for which the greedy
filling needs no more shards than there are. Prefix sums come from a two-level sum over ranges of the digest. The search runs over the
boundaries that can matter: first the first and last group ends of 65,536 ranges, whose greedy filling bounds the capacity from above and the place of each cut; the gaps
between ranges, where no group ends, show which capacities can't do. Then come only the group ends within those bounds, until these are few enough to be read as they are. What the driver holds is bounded by the parameters
and doesn't grow with the data, and the capacity found is exact. Within that capacity the cuts are laid near equal shares, so that the last shards don't stay small or empty.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, table

RANGES = 65_536
READ_AT_MOST = 200_000


def fill(ends: list[int], capacity: int, shards: int) -> list[int] | None:
    """The last boundary of each shard when each takes as much as fits, or None if a step can't move or the shards don't suffice."""
    at, cuts, total = 0, [], ends[-1]
    while at < total:
        if len(cuts) == shards:
            return None
        to = ends[bisect_right(ends, at + capacity) - 1] if ends[0] <= at + capacity else 0
        if to <= at:
            return None
        cuts.append(to)
        at = to
    return cuts


def smallest(ends: list[int], shards: int, low: int) -> int:
    """The smallest feasible capacity, at least `low`, over ascending boundaries."""
    high = ends[-1]
    while low < high:
        middle = (low + high) // 2
        if fill(ends, middle, shards) is None:
            low = middle + 1
        else:
            high = middle
    return low


def optimistic(ends: list[int], gaps: list[tuple[int, int]], shards: int, low: int, high: int) -> int:
    """The smallest capacity in [low, high] that isn't proven too small: a group may end anywhere but inside a gap (after, before) between two neighbouring ends."""

    def can(capacity: int) -> bool:
        at = 0
        for _ in range(shards):
            to = at + capacity
            if to >= ends[-1]:
                return True
            i = bisect_right(gaps, (to, ends[-1])) - 1
            if i >= 0 and to < gaps[i][1]:
                to = gaps[i][0]
            if to <= at:
                return False
            at = to
        return False

    while low < high:
        middle = (low + high) // 2
        if can(middle):
            high = middle
        else:
            low = middle + 1
    return low


def windows(ends: list[int], low: int, high: int, shards: int) -> list[tuple[int, int]]:
    """For each cut, between which prefix sums it can lie for a capacity in [low, high], given only some of the boundaries."""
    out, down, up, total = [], 0, 0, ends[-1]
    for _ in range(shards):
        down = max(down, ends[bisect_right(ends, down + low) - 1] if ends[0] <= down + low else 0)
        up = min(total, up + high)
        out.append((down, up))
    return out


def balanced(ends: list[int], capacity: int, shards: int) -> list[int]:
    """The end of each shard: no shard above the capacity, each as near as the groups allow to an equal share of what is left, and none empty while there are as many boundaries as shards.

    A cut lies where the shards before it can reach it (`fill`) and the rest fits into the shards after it (the same from behind), so every choice can be completed.
    """
    total, latest = ends[-1], fill(ends, capacity, shards)
    latest = latest + [total] * (shards - len(latest))
    earliest, at = [total] * shards, total
    for k in range(shards - 2, -1, -1):
        at = ends[bisect_left(ends, at - capacity)] if at > capacity else 0
        earliest[k] = at
    cuts, before = [], 0
    for k in range(shards):
        i = bisect_right(ends, before)  # the first boundary that gives this shard something
        left = shards - 1 - k
        low = max(bisect_left(ends, earliest[k]), i)
        high = min(bisect_right(ends, min(latest[k], before + capacity)) - 1, max(low, len(ends) - 1 - left))
        want = before + (total - before) / (shards - k)
        near = bisect_left(ends, want)
        near = near - 1 if near and (near == len(ends) or want - ends[near - 1] < ends[near] - want) else near
        to = ends[max(low, min(high, near))] if low <= high else before
        cuts.append(to)
        before = to
    return max(cuts, latest, key=lambda c: min(b - a for a, b in zip([0, *c], c, strict=False)))


def minimax_cuts(groups: DataFrame, shards: int, ranges: int = RANGES, read_at_most: int = READ_AT_MOST) -> list[int]:
    """The end of each shard as a prefix sum, for groups with columns size, prefix (sum up to and with the group) and range."""
    coarse = groups.groupBy("range").agg(F.min("prefix").alias("first"), F.max("prefix").alias("end"), F.max("size").alias("most")).collect()  # at most `ranges` rows
    if not coarse:
        return []
    cells = sorted((x["first"], x["end"]) for x in coarse)
    ends, total = sorted({e for c in cells for e in c}), cells[-1][1]
    gaps = {(0, cells[0][0])} | {(a[1], b[0]) for a, b in zip(cells, cells[1:], strict=False)}
    low, step = max(-(-total // shards), max(x["most"] for x in coarse)), None
    while True:
        high = smallest(ends, shards, low)
        low = optimistic(ends, sorted(gaps), shards, low, high)
        bounds = []
        for a, b in windows(ends, low, high, shards):  # ascending; those that overlap are one
            if bounds and a <= bounds[-1][1]:
                bounds[-1] = (bounds[-1][0], max(b, bounds[-1][1]))
            elif a < b:
                bounds.append((a, b))
        inside = F.lit(False)
        for a, b in bounds:
            inside = inside | ((F.col("prefix") > a) & (F.col("prefix") <= b))
        near = groups.where(inside)
        if near.count() <= read_at_most or step == 1:
            ends = sorted({*ends, *(x[0] for x in near.select("prefix").collect())})
            return balanced(ends, smallest(ends, shards, low), shards)
        # A finer sample of boundaries inside the bounds; the steps shrink with each round, so that it ends.
        finer = max(1, sum(b - a for a, b in bounds) // ranges)
        step = finer if step is None else min(finer, max(1, step // 2))
        cells = sorted((x[1], x[2]) for x in near.groupBy(F.floor(F.col("prefix") / step)).agg(F.min("prefix"), F.max("prefix")).collect())
        ends = sorted({*ends, *(e for c in cells for e in c)})
        for (_, x), (y, _) in zip(cells, cells[1:], strict=False):
            i = bisect_left(bounds, (x, -1))
            if any(a <= x and y <= b for a, b in bounds[max(0, i - 1) : i + 1]):  # all between them was looked at
                gaps.add((x, y))


def grouped(docs: DataFrame, id_col: str, text_col: str, ranges: int) -> tuple[DataFrame, DataFrame]:
    """Rows (id, digest, size, crc) and groups (digest, size, prefix, range) in the order of the digest."""
    text = F.col(text_col)
    rows = checkpointed(docs.select(
        F.col(id_col).alias("id"), F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256)).alias("digest"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"), F.crc32(F.coalesce(text, F.lit(""))).alias("crc"),
    ))
    groups = rows.groupBy("digest").agg(F.sum("size").alias("size"))
    groups = checkpointed(groups.withColumn("range", F.floor(F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long") * ranges / (1 << 32)).cast("long")))
    # At most `ranges` rows: their running sum may be made in one task.
    sums = groups.groupBy("range").agg(F.sum("size").alias("range_size"))
    before = sums.select("range", (F.sum("range_size").over(Window.orderBy("range")) - F.col("range_size")).alias("before"))
    inside = F.sum("size").over(Window.partitionBy("range").orderBy("digest").rowsBetween(Window.unboundedPreceding, 0))
    return rows, checkpointed(groups.join(before, "range").select("digest", "size", "range", (inside + F.col("before")).alias("prefix")))


def shard(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", ranges: int = RANGES, read_at_most: int = READ_AT_MOST) -> DataFrame:
    """One row per row of docs: (id, size, crc, shard, slot). Size is the UTF-8 bytes of the text plus 16; slots count from 0 in each shard.

    Equal texts, null and empty ones among them, lie in one shard. Repeated rows and ids get slots of their own. With fewer groups than shards some
    shards are empty. An empty table gives an empty result.
    """
    rows, groups = grouped(docs, id_col, text_col, ranges)
    cuts = minimax_cuts(groups, shards, ranges, read_at_most)
    number = F.lit(0)
    for cut in cuts[:-1]:
        number = number + (F.col("prefix") > F.lit(cut)).cast("int")
    placed = rows.join(groups.select("digest", number.alias("shard")), "digest")
    # Slots: rows are numbered within small parts of a shard, after the count of the parts before; no task takes a whole shard or group.
    placed = checkpointed(placed.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(1024))).drop("digest"))
    counts = placed.groupBy("shard", "part").agg(F.count("*").alias("n"))
    first = counts.select("shard", "part", (F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).alias("first"))
    nth = F.row_number().over(Window.partitionBy("shard", "part").orderBy("id", "crc", "size")) - 1
    return placed.withColumn("nth", nth).join(first, ["shard", "part"]).select("id", "size", "crc", "shard", (F.col("first") + F.col("nth")).cast("long").alias("slot"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for all documents in 40 shards."""
    found = shard(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
