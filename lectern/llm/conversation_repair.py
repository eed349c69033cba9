"""Repair of the role order of conversations by a min-plus scan of matrices.

A repaired conversation's role initials read (s?(ua)+)?. Its automaton has four states (nothing yet, after the system turn, after a user turn, after an assistant turn), and
every turn is a 4x4 matrix over it: an element is the cheapest (cost, audit) that leads from one state to another by keeping, re-roling or deleting the turn, followed by any insertions (the
insert closure). Elements are added by taking the lesser pair and multiplied by adding costs and joining audits; equal costs never belong to audits of which one begins the
other, so the order holds under joining, and products may be taken in any grouping.

Turns are laid out by range of (conversation, turn), so a very long conversation lies in many partitions. Every partition multiplies its own stretch as a balanced tree; the
stretches of a conversation are multiplied in rounds of FAN; and the audit found is cut at the stretches again, each of which applies its own piece. No step holds the turns of a conversation. Only
the audit and the digest of a conversation are single values: the audit is one string, and the digest is taken by streaming the repaired turns in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batch, checkpointed, table

SPACE = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
FAN = 16
#: (letter of the output role, from state, to state)
MOVES = [("s", 0, 1), ("u", 0, 2), ("u", 1, 2), ("u", 3, 2), ("a", 2, 3)]
Matrix = tuple  # 16 elements by rows: None or (cost, audit)


def times(a: Matrix, b: Matrix) -> Matrix:
    out: list = []
    for i in (0, 4, 8, 12):
        for j in range(4):
            best = None
            for k in range(4):
                x, y = a[i + k], b[4 * k + j]
                if x is not None and y is not None and (best is None or x[0] + y[0] <= best[0]):
                    new = (x[0] + y[0], x[1] + y[1])
                    best = new if best is None or new < best else best
            out.append(best)
    return tuple(out)


def matrix(elements: dict[tuple[int, int], tuple[int, str]]) -> Matrix:
    return tuple(elements.get((i, j)) for i in range(4) for j in range(4))


#: No insertion leads back to its state at no cost, so two in a row reach whatever insertions reach cheapest.
ONE = matrix({(i, i): (0, "") for i in range(4)} | {(i, j): (INSERT, "I") for role, i, j in MOVES if role != "s"})
INSERTS = times(ONE, ONE)


@lru_cache(maxsize=256)
def turn_matrix(initial: str, truncated: bool) -> Matrix:
    """A turn that may stay."""
    found: dict[tuple[int, int], tuple[int, str]] = {(i, i): (DELETE, "D") for i in range(4)}
    for role, i, j in MOVES:
        if role == initial:
            found[i, j] = (KEEP + TRUNCATED * truncated, "K")
        elif role != "s":
            found[i, j] = (REROLE + TRUNCATED * truncated, "R")
    return times(matrix(found), INSERTS)


def deleted(n: int) -> Matrix:
    """n turns that have to go."""
    return times(matrix({(i, i): (DELETE * n, "D" * n) for i in range(4)}), INSERTS)


class Product:
    """The product of matrices in their order, multiplied in pairs of equal length, so that audits are joined a logarithmic number of times."""

    def __init__(self) -> None:
        self.parts: list[tuple[int, Matrix]] = []

    def add(self, m: Matrix) -> None:
        level = 0
        while self.parts and self.parts[-1][0] == level:
            m, level = times(self.parts.pop()[1], m), level + 1
        self.parts.append((level, m))

    def value(self) -> Matrix:
        m = self.parts[-1][1]
        for _, left in reversed(self.parts[:-1]):
            m = times(left, m)
        return m


#: What is known of a stretch of a conversation besides its matrix.
COUNTS = ["turns", "blank", "duplicate", "truncated", "illegal"]


class Stretch:
    def __init__(self, conv: Any, place: int):
        self.conv, self.place, self.product, self.counts = conv, place, Product(), dict.fromkeys(COUNTS, 0)
        self.first = self.last = None

    def add(self, m: Matrix, first: str, last: str, counts: dict[str, int]) -> None:
        self.product.add(m)
        for k, v in counts.items():
            self.counts[k] += v
        if self.last is None:
            self.first = first
        elif self.last + first not in ("su", "ua", "au"):
            self.counts["illegal"] += 1
        self.last = last

    def row(self) -> dict[str, Any]:
        m = self.product.value()
        return {"conv": self.conv, "place": self.place, **self.counts, "first": self.first, "last": self.last, "costs": [x and x[0] for x in m], "audits": [x and x[1] for x in m]}


def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, Any]]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 1024):
            yield from batch.slice(lo, 1024).to_pylist()


def in_batches(rows: Iterator[dict[str, Any]], schema: pa.Schema, most: int = 1024) -> Iterator[pa.RecordBatch]:
    held: list[dict[str, Any]] = []
    for row in rows:
        held.append(row)
        if len(held) == most:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def stretches(rows: Iterator[dict[str, Any]]) -> Iterator[dict[str, Any]]:
    """From turns in order, the matrix and counts of each conversation's stretch."""
    now = None
    for r in rows:
        if now is None or r["conv"] != now.conv:
            if now is not None:
                yield now.row()
            now = Stretch(r["conv"], r["part"])
        n, initial = r["n"], r["role"][:1]
        stays = r["opens"] and not r["blank"]
        if stays:
            now.add(turn_matrix(initial, r["cut"]), initial, initial, {"turns": 1, "truncated": int(r["cut"])})
        if gone := n - stays:
            now.add(deleted(gone), initial, initial, {"turns": gone, "blank" if r["blank"] else "duplicate": gone, "illegal": gone - 1})
    if now is not None:
        yield now.row()


def joined(rows: Iterator[dict[str, Any]]) -> Iterator[dict[str, Any]]:
    """From stretches in order of (conv, up, place), one for each (conv, up)."""
    now = None
    for r in rows:
        if now is None or (r["conv"], r["up"]) != (now.conv, now.place):
            if now is not None:
                yield now.row()
            now = Stretch(r["conv"], r["up"])
        m = tuple(None if c is None else (c, a) for c, a in zip(r["costs"], r["audits"], strict=True))
        now.add(m, r["first"], r["last"], {k: r[k] for k in COUNTS})
    if now is not None:
        yield now.row()


def pieces(rows: Iterator[dict[str, Any]]) -> Iterator[dict[str, Any]]:
    """From a conversation's audit followed by the sizes of its stretches, the piece of each stretch: its turns' letters with the insertions that follow them."""
    for r in rows:
        if r["kind"] == 0:
            letters = np.frombuffer(r["audit"].encode(), np.uint8)
            starts = np.append(np.flatnonzero(letters != ord("I")), len(letters))
            before = np.concatenate([[0], np.cumsum(letters != ord("D"))])
            system, turn, audit = bool(before[-1] % 2), 0, r["audit"]
        else:
            lo, hi = int(starts[turn]) if turn else 0, int(starts[turn + r["turns"]])
            turn += r["turns"]
            yield {"conv": r["conv"], "part": r["part"], "audit": audit[lo:hi], "position": int(before[lo]), "system": system}


def applied(rows: Iterator[dict[str, Any]]) -> Iterator[dict[str, Any]]:
    """From a stretch's piece followed by its turns, the turns that stay and those that are inserted, with their positions."""

    def output(edit: str, r: dict[str, Any] | None) -> dict[str, Any]:
        nonlocal position
        role = r["role"] if edit == "K" else ("user", "assistant")[(position - system) % 2]
        key = f"{position}".encode() if r is None else r["digest"]  # inserted turns have no text to look up; their keys are spread
        position += 1
        return {"conv": conv, "position": position - 1, "edit": edit, "turn": r and r["turn"], "was": r and r["role"], "digest": key, "role": role}

    for r in rows:
        if r["kind"] == 0:
            conv, audit, position, system, at = r["conv"], r["audit"], r["position"], r["system"], 0
            while audit[at : at + 1] == "I":  # only before the first turn
                yield output("I", None)
                at += 1
            continue
        for _ in range(r["n"]):
            if audit[at] != "D":
                yield output(audit[at], r)
            at += 1
            while audit[at : at + 1] == "I":
                yield output("I", None)
                at += 1


def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each conversation's role:text lines, streamed."""
    schema = pa.schema([("conv", pa.int64()), ("repaired_sha256", pa.string())])
    conv, sha = None, None
    for batch in batches:
        done: list[tuple[Any, str]] = []
        for name, role, text in zip(batch.column("conv").to_pylist(), batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if sha is None or name != conv:
                if sha is not None:
                    done.append((conv, sha.hexdigest()))
                conv, sha = name, hashlib.sha256()
            else:
                sha.update(b"\n")
            sha.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))
        if done:
            yield arrow_batch(schema, zip(*done, strict=True))
    if sha is not None:
        yield arrow_batch(schema, [[conv], [sha.hexdigest()]])


STRETCH = "conv long, place int, turns long, blank long, duplicate long, truncated long, illegal long, first string, last string, costs array<bigint>, audits array<string>"
TYPES = {"conv": pa.int64(), "place": pa.int32(), **dict.fromkeys(COUNTS, pa.int64()), "first": pa.string(), "last": pa.string(), "costs": pa.list_(pa.int64()), "audits": pa.list_(pa.string())}


def scan(df: DataFrame, step, schema: str, types: dict[str, pa.DataType]) -> DataFrame:
    arrow = pa.schema(list(types.items()))
    return df.mapInArrow(lambda batches: in_batches(step(streamed(batches)), arrow), schema)


def same(a: DataFrame, b: DataFrame, *columns: str) -> Column:
    """Equality of columns, nulls included."""
    on = a[columns[0]].eqNullSafe(b[columns[0]])
    for c in columns[1:]:
        on &= a[c].eqNullSafe(b[c])
    return on


def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(summary, turns) of conversations of any length.

    summary: conv, gaps, blank, duplicate, truncated, illegal, cost, audit, a row for each conversation of rows. turns: conv, position (from 0), edit (K, R or I), turn, role, text of the repaired ones.
    Turns come by turn (null first), role and SHA-256 of the text; a null conversation is one of its own; a null role or text is one space. Copies of a turn count each; the first stays, the rest are
    duplicates. Initials other than s, u and a can't be kept. An empty table gives empty results; other columns have no effect.
    """
    text = F.coalesce(F.col(text_col), F.lit(" "))
    rows = rows.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit(" ")).alias("role"), text.alias("text"))
    key = ["conv", "turn", "role", "digest"]
    turns = rows.withColumn("digest", F.unhex(F.sha2("text", 256))).groupBy(*key).agg(F.count("*").alias("n"), F.max("text").alias("text"))
    turns = checkpointed(turns)
    bare = F.rtrim(F.col("text"), F.lit(SPACE))
    slim = turns.select(*key, "n", (bare == "").alias("blank"), (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("cut"))
    opened = turns.groupBy("conv", "role", "digest").agg(F.min("turn").alias("least"), F.bool_or(F.col("turn").isNull()).alias("unnumbered"))
    opens = F.when(F.col("turn").isNull(), True).otherwise(~F.col("unnumbered") & (F.col("turn") == F.col("least")))
    slim = slim.join(opened, same(slim, opened, "conv", "role", "digest")).select(*(slim[c] for c in slim.columns), opens.alias("opens"))
    placed = checkpointed(slim.repartitionByRange(*key).sortWithinPartitions(*key).withColumn("part", F.spark_partition_id()))

    parts = checkpointed(scan(placed.sortWithinPartitions(*key), stretches, STRETCH, TYPES))
    whole, left = parts, (parts.agg(F.max("place")).first()[0] or 0) + 1
    while True:
        whole = whole.withColumn("up", F.floor(F.col("place") / FAN).cast("int")).repartition("conv", "up").sortWithinPartitions("conv", "up", "place")
        whole = scan(whole, joined, STRETCH, TYPES)
        left = -(-left // FAN)
        if left == 1:
            break
    found = whole.mapInArrow(chosen, "conv long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")
    found = checkpointed(found)

    audits = found.select("conv", F.lit(0).alias("kind"), F.lit(-1).alias("part"), F.lit(0).cast("long").alias("turns"), "audit")
    cut = audits.union(parts.select("conv", F.lit(1), "place", "turns", F.lit(None).cast("string"))).repartition("conv").sortWithinPartitions("conv", "kind", "part")
    cut = scan(cut, pieces, "conv long, part int, audit string, position long, system boolean", {"conv": pa.int64(), "part": pa.int32(), "audit": pa.string(), "position": pa.int64(), "system": pa.bool_()})
    orders = cut.select("conv", "part", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("n"), "audit", "position", "system")
    own = placed.select("conv", "part", F.lit(1), "turn", "role", "digest", "n", F.lit(None).cast("string"), F.lit(None).cast("long"), F.lit(None).cast("boolean"))
    out = scan(orders.union(own).repartition("conv", "part").sortWithinPartitions("conv", "part", "kind", "turn", "role", "digest"), applied,
               "conv long, position long, edit string, turn long, was string, digest binary, role string",
               {"conv": pa.int64(), "position": pa.int64(), "edit": pa.string(), "turn": pa.int64(), "was": pa.string(), "digest": pa.binary(), "role": pa.string()})
    texts = turns.select("conv", "turn", F.col("role").alias("was"), "digest", "text")
    repaired = out.join(texts, same(out, texts, "conv", "turn", "was", "digest"), "left").select(out["conv"], "position", "edit", out["turn"], out["role"], F.coalesce("text", F.lit("")).alias("text"))

    numbers = turns.groupBy("conv", "turn").agg(F.lit(1).alias("one")).groupBy("conv").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"))
    summary = found.join(numbers, same(found, numbers, "conv")).select(found["conv"], "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    return summary, repaired


def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The cheapest way through a whole conversation, insertions before its first turn included."""
    schema = pa.schema([(c, TYPES[c]) for c in ("conv", *COUNTS[1:])] + [("cost", pa.int64()), ("audit", pa.string())])

    def rows() -> Iterator[dict[str, Any]]:
        for r in streamed(batches):
            m = times(INSERTS, tuple(None if c is None else (c, a) for c, a in zip(r["costs"], r["audits"], strict=True)))
            cost, audit = min(x for x in (m[0], m[3]) if x is not None)
            yield {"conv": r["conv"], **{k: r[k] for k in COUNTS[1:]}, "cost": cost, "audit": audit}

    yield from in_batches(rows(), schema)


def repaired_digests(turns: DataFrame) -> DataFrame:
    """(conv, repaired_sha256) of conversations that have turns left. A conversation is streamed through one digest in order, a turn at a time."""
    rows = turns.select("conv", "position", "role", "text").repartition("conv").sortWithinPartitions("conv", "position")
    return rows.select("conv", "role", "text").mapInArrow(digests, "conv long, repaired_sha256 string")


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the faults that crc32 of `conv_id:turn` names: dropped, emptied, without [.!?], twice, or by the user."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat_ws(":", shown("conv_id"), shown("turn"))) % 20
    rows = rows.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"), fault.alias("fault")).where("fault <> 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "fault")
    return rows.withColumn("copy", F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("copy", "fault")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 for every conversation."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    summary, turns = repair(damaged(rows))
    every, shas = rows.select("conv_id").distinct(), repaired_digests(turns).withColumnRenamed("conv", "of")
    out = every.join(summary, every["conv_id"].eqNullSafe(summary["conv"]), "left").join(shas, every["conv_id"].eqNullSafe(shas["of"]), "left")
    zero = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(b""), 256)).alias("repaired_sha256"))


def _added(state: str, cost: str | int, letter: str) -> str:
    return f"CASE WHEN {state} = 'Z' THEN 'Z' ELSE lpad((left({state}, 9)::BIGINT + {cost})::VARCHAR, 9, '0') || substr({state}, 10) || '{letter}' END"


def _op12_sql() -> str:
    """The states' best (cost, audit) as one string each, nine digits and the letters, turn after turn; 'Z' is out of reach."""
    bits = "[0, 1, 2, 3, 4, 5, 6, 7]::BIGINT[]"
    byte = f"list_reduce(list_prepend(xor(c, b), {bits}), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(name, ''), lambda z: ascii(z)::BIGINT)), lambda c, b: {byte}), 4294967295)"
    stay, user = "NOT r.gone", "least(t.s0, t.s1, t.s3)"
    maybe = lambda test, value: f"CASE WHEN {test} THEN {value} ELSE 'Z' END"
    return f"""
WITH RECURSIVE d AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
h AS (SELECT *, {crc} % 20 AS fault FROM d),
e AS (SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role, CASE fault WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM (SELECT *, unnest(range(CASE WHEN fault = 3 THEN 2 ELSE 1 END)) AS copy FROM h WHERE fault <> 0)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS k FROM e),
f AS (SELECT *, NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 AS again,
  NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') AS cut, left(role, 1) AS ini, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY k) AS prev FROM o),
r AS (SELECT *, blank OR again AS gone, cut::BIGINT AS extra FROM f),
c AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE again AND NOT blank) AS duplicate,
  count(*) FILTER (WHERE cut AND NOT gone) AS truncated, count(*) FILTER (WHERE k > 1 AND prev || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id),
t AS (
  SELECT conv_id, 0::BIGINT AS k, '000000000' AS s0, 'Z' AS s1, '000000002I' AS s2, '000000004II' AS s3 FROM c
  UNION ALL
  SELECT conv_id, k, n0, n1, least(n2, {_added("least(n0, n1, n3)", 2, "I")}), least(n3, {_added(f"least(n2, {_added('least(n0, n1, n3)', 2, 'I')})", 2, "I")}) FROM (
    SELECT t.conv_id, r.k, {_added("t.s0", 3, "D")} AS n0, least({_added("t.s1", 3, "D")}, {maybe(f"{stay} AND ini = 's'", _added("t.s0", "extra", "K"))}) AS n1,
      least({_added("t.s2", 3, "D")}, {maybe(f"{stay} AND ini = 'u'", _added(user, "extra", "K"))}, {maybe(stay, _added(user, "extra + 2", "R"))}) AS n2,
      least({_added("t.s3", 3, "D")}, {maybe(f"{stay} AND ini = 'a'", _added("t.s2", "extra", "K"))}, {maybe(stay, _added("t.s2", "extra + 2", "R"))}) AS n3
    FROM t JOIN r ON r.conv_id IS NOT DISTINCT FROM t.conv_id AND r.k = t.k + 1)),
b AS (SELECT c.*, least(t.s0, t.s3) AS best FROM c JOIN t ON t.conv_id IS NOT DISTINCT FROM c.conv_id AND t.k = c.n),
l AS (SELECT conv_id, best, unnest(range(1, length(best) - 8)) AS i FROM b),
m AS (SELECT conv_id, i, substr(best, 9 + i::BIGINT, 1) AS letter, length(replace(substr(best, 10), 'D', '')) % 2 AS system,
  length(replace(substr(best, 10, i::BIGINT), 'I', '')) AS k, length(replace(substr(best, 10, i::BIGINT), 'D', '')) - 1 AS place FROM l),
w AS (SELECT m.conv_id, sha256(string_agg(CASE WHEN letter = 'K' THEN r.role WHEN (place - system) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN letter = 'I' THEN '' ELSE r.text END, chr(10) ORDER BY i)) AS sha
  FROM m LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM m.conv_id AND r.k = m.k AND letter <> 'I' WHERE letter <> 'D' GROUP BY m.conv_id)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(left(best, 9)::BIGINT, 0) AS cost, coalesce(substr(best, 10), '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN w ON w.conv_id IS NOT DISTINCT FROM a.conv_id
"""


OP12_SQL = _op12_sql()
