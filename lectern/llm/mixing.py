"""Mixing sources to target weights by packed blocks.

The words of a source, its documents in a fixed order, are packed into blocks of fixed length. The mix is a sequence of block slots in output
shards; the number of slots of each source in a shard is a multinomial draw given the totals that the targets fix. The j-th slot
of a source takes block perm(j) of it, where perm is a pseudorandom permutation of the source's block numbers for each pass over them, so
that no block is taken twice before all were taken once. The slots of a source take its target, rounded to words, whatever its size: whole passes
first, then blocks by their true lengths, the last one in part. Slots join the packed documents by source and block number.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, checkpointed, table

WEIGHTS = (5, 2, 1)
CAP = 3
BLOCK_WORDS = 64
PARTS = 512
SLOTS_PER_SHARD = 65_536
#: Slots are laid out in runs of so many, and about so many are made in one task.
RUN, SLOTS_PER_TASK = 1024, 200_000
#: Rounds of the permutations.
ROUNDS = 24


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size, weight, target) from (source, source_size): weights repeat over the sources by code point, null last.

    Sources share the sum of all sizes by weight; a target stops at `cap` times its source's size and the excess is shared again by weight among the
    others. All sources whose cap lies below their share are found at once: with sources in the order of cap over weight, the capped ones
    are the first k for which the share of the rest no longer reaches the cap. One row per source, so one task may order them.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    nth = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), nth + 1).cast("double")
    s = sizes.withColumn("weight", weight).withColumn("ratio", F.col("source_size") * cap / F.col("weight"))
    every = Window.partitionBy()
    up = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("all", F.sum("source_size").over(every).cast("double")).withColumn("all_weights", F.sum("weight").over(every))
    s = s.withColumn("capped_before", F.coalesce(F.sum(F.col("source_size") * cap).over(up), F.lit(0)).cast("double")).withColumn("weights_before", F.coalesce(F.sum("weight").over(up), F.lit(0.0)))
    s = s.withColumn("rate", (F.col("all") - F.col("capped_before")) / (F.col("all_weights") - F.col("weights_before")))
    # The common rate is that of the first source whose ratio reaches it.
    rate = F.min_by(F.when(F.col("ratio") >= F.col("rate"), F.col("rate")), F.when(F.col("ratio") >= F.col("rate"), F.col("ratio"))).over(every)
    capped = F.col("ratio") < F.coalesce(rate, F.lit(float("inf")))
    return s.withColumn("target", F.when(capped, F.col("source_size") * float(cap)).otherwise(F.coalesce(rate, F.lit(0.0)) * F.col("weight"))).select("source", "source_size", "weight", "target")


def packed(docs: DataFrame, id_col: str, text_col: str, source_col: str, parts: int) -> DataFrame:
    """(id, source, size, start): the place of each document in the word stream of its source, by a two-level prefix sum."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = checkpointed(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.crc32(text).alias("crc")))
    rows = rows.withColumn("part", F.pmod(F.crc32(F.coalesce(F.col("id").cast("string"), F.lit(""))), F.lit(parts)))
    sums = rows.groupBy("source", "part").agg(F.sum("size").alias("n"))
    before = sums.select("source", "part", (F.sum("n").over(Window.partitionBy("source").orderBy("part")) - F.col("n")).alias("before"))
    inside = F.sum("size").over(Window.partitionBy("source", "part").orderBy("id", "crc").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    placed = rows.withColumn("inside", inside).alias("r").join(before.alias("b"), F.col("r.source").eqNullSafe(F.col("b.source")) & (F.col("r.part") == F.col("b.part")))
    return checkpointed(placed.select("r.id", "r.source", "r.size", "r.crc", (F.col("b.before") + F.col("r.inside")).alias("start")))


def last_place(n, turn, seed):
    """Which slot of a pass takes the last block of n, the only one that can be shorter: drawn by pass."""
    return F.pmod(F.xxhash64(seed, turn, F.lit("offset")), n)


def shuffled(x, n, turn, seed):
    """The place of x in a pseudorandom permutation of [0, n) keyed by pass and source, for any n: a round either keeps a number or swaps it with the one that mirrors it, as a hash of the pair says."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), x, lambda y, k: swapped(y, F.pmod(F.xxhash64(seed, turn, k) - y, n), turn, seed, k))


def swapped(y, mirror, turn, seed, k):
    return F.when(F.xxhash64(F.greatest(y, mirror), seed, turn, k) > 0, mirror).otherwise(y)


def permuted(j, n, seed):
    """Block number of the j-th slot among n blocks: the permutation of its pass, in which the drawn place has the last block; native arithmetic only."""
    at, turn = F.pmod(j, n), F.floor(j / n).cast("long")
    place = last_place(n, turn, seed)
    found = shuffled(at, n, turn, seed)
    return F.when(at == place, n - 1).when(found == n - 1, shuffled(place, n, turn, seed)).otherwise(found)


def slots(sources: DataFrame, block_words: int = BLOCK_WORDS, per_shard: int = SLOTS_PER_SHARD) -> DataFrame:
    """(shard, position, source, block, words, part): the mix as block slots of output shards; a slot takes the first `words` words of its block, fewer than all where it is marked as part.

    The words of a source's slots add up to its target rounded to words, one at least where the target is positive. First the counts are drawn: each source's slots are
    thrown over the output shards, so that the source counts of a shard are multinomial with the sources' shares as
    probabilities, conditioned on the totals that the targets fix. The slots are then derived from the counts: a shard holds the next so many places of the
    source's permutation. Draws depend on source and slot number only, and reruns agree.
    """
    name = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    size, whole = F.col("source_size"), F.lit(block_words).cast("long")
    counted = sources.where("source_size > 0 and target > 0").withColumn("blocks", F.ceil(size / block_words).cast("long")).withColumn("words", F.least(F.greatest(F.round("target").cast("long"), F.lit(1)), size * CAP))
    counted = counted.withColumn("turns", F.floor(F.col("words") / size).cast("long")).withColumn("rest", F.col("words") - F.col("turns") * size)
    # In the last pass the last block stands in slot `short` and lacks `lack` words; one slot more makes up for it where that is needed.
    counted = counted.withColumn("short", last_place(F.col("blocks"), F.col("turns"), name)).withColumn("lack", F.col("blocks") * whole - size).withColumn("fewest", F.ceil(F.col("rest") / block_words).cast("long"))
    more = (F.col("short") < F.col("fewest")) & (F.col("fewest") * whole - F.col("lack") < F.col("rest"))
    counted = counted.withColumn("n_slots", F.col("turns") * F.col("blocks") + F.col("fewest") + more.cast("long"))
    counted = counted.withColumn("shards", F.greatest(F.lit(1), F.ceil(F.sum("n_slots").over(Window.partitionBy()) / per_shard)).cast("long"))
    counted = checkpointed(counted)
    tasks = max(1, min(10_000, (counted.agg(F.sum("n_slots")).first()[0] or 0) // SLOTS_PER_TASK))

    def laid(rows: DataFrame, n: str) -> DataFrame:
        """A row for each i in [0, n): runs of runs are dealt over the tasks before they are laid out."""
        rows = rows.withColumn("far", F.explode(F.expr(f"sequence(0L, ({n} - 1) div {RUN * RUN}L)")))
        rows = rows.withColumn("run", F.explode(F.expr(f"sequence(far * {RUN}L, least(({n} - 1) div {RUN}L, far * {RUN}L + {RUN - 1}L))"))).drop("far")
        rows = rows.repartition(tasks, "source", "run")
        return rows.withColumn("i", F.explode(F.expr(f"sequence(run * {RUN}L, least({n}, run * {RUN}L + {RUN}L) - 1L)"))).drop("run")

    thrown = laid(counted.select("source", "n_slots", "shards"), "n_slots").select("source", F.pmod(F.xxhash64(name, "i", F.lit("shard")), F.col("shards")).alias("shard"))
    drawn = thrown.groupBy("source", "shard").agg(F.count("*").alias("n"))
    drawn = checkpointed(drawn.withColumn("offset", F.sum("n").over(Window.partitionBy("source").orderBy("shard")) - F.col("n")))  # a row for each source and shard
    facts = counted.alias("c").join(drawn.alias("d"), F.col("c.source").eqNullSafe(F.col("d.source"))).select("c.*", "d.shard", "d.n", "d.offset")
    each = laid(facts, "n").withColumn("j", F.col("offset") + F.col("i"))
    each = each.withColumn("block", permuted(F.col("j"), F.col("blocks"), name))
    length = whole - F.when(F.col("block") == F.col("blocks") - 1, F.col("lack")).otherwise(0)
    at = F.col("j") - F.col("turns") * F.col("blocks")
    left = F.col("rest") - at * whole + F.when(F.col("short") < at, F.col("lack")).otherwise(0)
    words = F.when(at < 0, length).otherwise(F.least(length, left))
    return each.select("shard", F.xxhash64(name, "j", F.lit("position")).alias("position"), "source", "block", words.alias("words"), (words < length).alias("part"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_words: int = BLOCK_WORDS, parts: int = PARTS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, pieces, slots) of the mix.

    documents: (id, crc, source, size, start, source_size, target), a row for each row of docs; start is its place in the word stream of its source.
    pieces: (id, source, start, block, first, words, since, times), the part of a document in one block, from word number `first` on, and how often the
    mix takes it, the takes numbered from `since`; where one take of the block is cut short, a piece of its own has what that take reaches of the part.
    slots: see slots().
    Texts that are null or have no words have size 0 and no piece. A null source is a source of its own, last in order. Rows repeated with id and
    text lie side by side in their source's stream, and each is mixed as a row of its own. An empty table gives empty results.
    """
    placed = packed(docs, id_col, text_col, source_col, parts)
    sources = checkpointed(targets(placed.groupBy("source").agg(F.sum("size").alias("source_size"))))
    drawn = slots(sources, block_words)
    taken = checkpointed(drawn.groupBy("source", "block").agg(F.count_if(~F.col("part")).alias("times"), F.max(F.when(F.col("part"), F.col("words"))).alias("cut")))
    cut = placed.where("size > 0").withColumn("block", F.explode(F.expr(f"sequence(start div {block_words}, (start + size - 1) div {block_words})")))
    first = F.greatest(F.lit(0), F.col("block") * block_words - F.col("start"))
    stop = F.least(F.col("size"), (F.col("block") + 1) * block_words - F.col("start"))
    cut = cut.select("id", "source", "start", "block", first.alias("first"), (stop - first).alias("words"))
    found = cut.alias("p").join(taken.alias("t"), (F.col("p.block") == F.col("t.block")) & F.col("p.source").eqNullSafe(F.col("t.source"))).select("p.*", "t.times", "t.cut")
    reached = F.least(F.col("words"), F.col("cut") - (F.col("start") + F.col("first") - F.col("block") * block_words))
    take = lambda words, since, times: F.struct(words.cast("long").alias("words"), since.cast("long").alias("since"), times.cast("long").alias("times"))
    full, short = take(F.col("words"), F.lit(1), F.col("times")), take(reached, F.col("times") + 1, F.lit(1))
    pieces = found.withColumn("take", F.explode(F.when(F.col("cut").isNull(), F.array(full)).otherwise(F.array(full, short)))).where("take.words > 0 and take.times > 0").select("id", "source", "start", "block", "first", "take.words", "take.since", "take.times")
    documents = placed.alias("d").join(sources.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source"))).select("d.id", "d.crc", "d.source", "d.size", "d.start", "s.source_size", "s.target")
    return documents, pieces, drawn


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", chars_col: str = "n_chars") -> DataFrame:
    """The mix as documents, with the columns of docs: copy r of a document holds the words of its blocks that the mix takes r times or more.

    A copy that holds all words keeps the text as it is; another one has the words of its blocks with the white space before each, and its n_chars, where
    there is such a column, follows. Documents of which nothing is taken, texts without words among them, have no row.
    """
    documents, pieces, _ = mix(docs, id_col, text_col, source_col)
    same = F.col("p.source").eqNullSafe(F.col("d.source")) & (F.col("p.start") == F.col("d.start")) & (F.col("d.size") > 0)
    copies = pieces.withColumn("copy", F.explode(F.expr("sequence(since, since + times - 1)"))).groupBy("source", "start", "copy").agg(F.sum("words").alias("words"), F.array_sort(F.collect_list(F.struct("first", "words"))).alias("parts"))
    copies = copies.alias("p").join(documents.alias("d"), same).select("d.id", "d.crc", "d.source", "d.start", "d.size", "p.words", "p.parts")
    # Rows alike in id and text are told apart by their number, in the order of all their columns' hash.
    nth, crc, full = (f"{c}_{uuid.uuid4().hex}" for c in ("nth", "crc", "full"))  # no column of docs has these names
    alike = F.dense_rank().over(Window.partitionBy("id", "crc").orderBy(F.col("source").asc_nulls_last(), "start"))
    copies = copies.withColumn(nth, alike)
    rows = docs.withColumn(crc, F.crc32(F.coalesce(F.col(text_col), F.lit(""))))
    rows = rows.withColumn(nth, F.row_number().over(Window.partitionBy(id_col, crc).orderBy(F.col(source_col).asc_nulls_last(), F.xxhash64(*docs.columns))))
    c, r = copies.alias("c"), rows.alias("r")
    joined = r.join(c, F.col(f"r.{id_col}").eqNullSafe(F.col("c.id")) & (F.col(f"r.{crc}") == F.col("c.crc")) & (F.col(f"r.{nth}") - F.col(f"c.{nth}") == 0))
    # The words are cut out once a row, bound to a variable of their own, and only where a copy lacks some.
    spaced = F.array(F.regexp_extract_all(F.col(f"r.{text_col}"), F.lit(rf"([\x20\x09-\x0D]*{WORD})"), F.lit(1)))
    cut = F.transform(spaced, lambda x: F.array_join(F.flatten(F.transform("c.parts", lambda p: F.slice(x, (p["first"] + 1).cast("int"), p["words"].cast("int")))), ""))
    whole = F.col("c.words") == F.col("c.size")
    out = joined.select(*[F.col(f"r.{x}").alias(x) for x in docs.columns if x != text_col], whole.alias(full), F.when(whole, F.col(f"r.{text_col}")).otherwise(F.element_at(cut, 1)).alias(text_col))
    if chars_col in docs.columns:
        out = out.withColumn(chars_col, F.when(F.col(full), F.col(chars_col)).otherwise(F.char_length(text_col)).cast(docs.schema[chars_col].dataType))
    return out.select(*docs.columns)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken for all documents."""
    documents, pieces, _ = mix(table(spark, sf_dir, "documents"))
    taken = pieces.groupBy("source", "start").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    same = F.col("d.source").eqNullSafe(F.col("t.source")) & (F.col("d.start") == F.col("t.start")) & (F.col("d.size") > 0)
    found = documents.alias("d").join(taken.alias("t"), same, "left")
    return found.select(F.col("d.id").alias("doc_id"), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
