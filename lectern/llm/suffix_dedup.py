"""Removal of repeated 50-byte strings by prefix-free parsing.

A rolling hash over 24 bytes is taken at every byte. The trigger of a 50-byte string is the smallest hash in it, so equal strings have equal triggers
wherever they stand, and the strings that begin one after another with the same trigger make a phrase. Three exchanges follow, in each of which a batch of
documents sends packed, distinct values to buckets and gets an answer for each value back:

1. triggers: phrases whose trigger occurs in one document only can't repeat and are dropped;
2. the dictionary of distinct phrases: a phrase that a smaller document holds alike goes whole; one document of each phrase that stays in question (its
   trigger has other phrases too) represents it;
3. the suffixes of the representatives in order to the depth of 50 bytes: each string is compared with the smallest document that has it.

A batch sends each value once, with its smallest document, so a bucket holds a value at most once for each batch however often it is repeated; triggers with very
many phrases are dealt to the buckets by phrase. No text leaves its batch but to be cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_bytes, checkpointed, table

LENGTH = 50
GRAM = 24
BATCH_BYTES = 6 << 20
#: Texts are hashed end to end in pieces of about so many bytes.
PIECE_BYTES = 1 << 17
#: A trigger with more phrases in one batch, or in more batches, is dealt to the buckets by phrase.
HOT_IN_BATCH, HOT_BATCHES = 64, 64
MULTIPLIER, OTHER_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Bits of the answer for a phrase: a smaller document has it; this batch represents it in the third exchange.
GONE, STANDS = 1, 2


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def rolled(data: np.ndarray, length: int, multiplier: np.uint64 = MULTIPLIER) -> np.ndarray:
    """A hash of the `length` bytes from each position on, from hashes of powers of two."""
    by_size, size = {1: data.astype(np.uint64) + np.uint64(1)}, 1
    powers = {1: multiplier}
    with np.errstate(over="ignore"):
        while size * 2 <= length:
            h = by_size[size]
            by_size[size * 2] = h[:-size] * powers[size] + h[size:]
            powers[size * 2] = powers[size] * powers[size]
            size *= 2
        out, done = None, 0
        for size in sorted(by_size, reverse=True):
            if done + size <= length:
                h = by_size[size][done:]
                n = len(data) - done - size + 1
                out = h if out is None else out[:n] * powers[size] + h[:n]
                done += size
        return mixed(out)


def smallest(h: np.ndarray, width: int) -> np.ndarray:
    """The smallest of `width` neighbours from each position on."""
    size = 1
    while size * 2 <= width:
        h, size = np.minimum(h[:-size], h[size:]), size * 2
    rest = width - size
    return np.minimum(h[: len(h) - rest], h[rest:]) if rest else h


def phrases(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, trigger, first, count): runs of 50-byte strings with one trigger, by text and by the place of the first string in it."""
    found, held, size = [], [], 0

    def piece() -> None:
        sizes = np.array([len(texts[r]) for r in held], np.int64)
        begins = np.cumsum(sizes) - sizes
        trigger = smallest(rolled(np.frombuffer(b"".join([texts[r] for r in held]), np.uint8), GRAM), LENGTH - GRAM + 1)
        starts = np.zeros(len(trigger), bool)
        starts[0] = True
        np.not_equal(trigger[1:], trigger[:-1], out=starts[1:])
        starts[begins] = True
        ends = begins + sizes - LENGTH + 1  # strings from here on reach into the next text
        starts[ends[:-1]] = True
        first = np.flatnonzero(starts)
        count = np.diff(np.concatenate([first, [len(trigger)]]))
        row = np.searchsorted(begins, first, side="right") - 1
        inside = first < ends[row]
        first, count, row = first[inside], count[inside], row[inside]
        found.append((np.array(held, np.int64)[row], trigger[first], first - begins[row], count))

    for r, text in enumerate(texts):
        if len(text) >= LENGTH:
            held.append(r)
            size += len(text)
        if size >= PIECE_BYTES:
            piece()
            held, size = [], 0
    if held:
        piece()
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def short(trigger: np.ndarray) -> np.ndarray:
    """48 bits of a trigger, evenly spread, for the exchanges. Equal triggers stay equal; a chance collision only lets more phrases through."""
    return mixed(trigger * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(16)


def runs(*columns: np.ndarray) -> np.ndarray:
    """The places where a run of equal rows begins in sorted columns."""
    n = len(columns[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def member(values: np.ndarray, of: np.ndarray) -> np.ndarray:
    if not len(of):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(of, values), len(of) - 1)
    return of[at] == values


def packed(values: np.ndarray, width: int = 6) -> bytes:
    """The low bytes of unsigned values, those of one rank together, so that sorted or small values compress well."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unpacked(data: bytes, width: int = 6) -> np.ndarray:
    n = len(data) // width
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(width, n).T
    return out.view("<u8").ravel().astype(np.uint64)


def column(t: pa.Table, name: str) -> list:
    return t.column(name).to_pylist()


def least_by(keys: tuple[np.ndarray, ...], doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, begin, at): rows ordered by keys and doc, where each key begins in that order, and each ordered row's key."""
    order = np.lexsort((doc, *reversed(keys)))
    begin = runs(*(k[order] for k in keys))
    return order, begin, np.repeat(np.arange(len(begin)), np.diff(np.concatenate([begin, [len(order)]])))


#: Rows of three kinds: messages to a bucket (a, b and c are packed columns, by exchange), parts of texts that stay with their batch, ranges to remove.
ALL = "bucket int, batch int, a binary, b binary, c binary, rid long, doc long, first long, data binary, begin long, end long"
NAMES = {"bucket": pa.int32(), "batch": pa.int32(), "a": pa.binary(), "b": pa.binary(), "c": pa.binary(), "rid": pa.int64(), "doc": pa.int64(), "first": pa.int64(), "data": pa.binary(), "begin": pa.int64(), "end": pa.int64()}


def shaped(n: int, **columns: object) -> pa.Table:
    """A table of all NAMES with n rows; columns that aren't given are null."""
    return pa.table([pa.array(columns[k], t) if k in columns else pa.nulls(n, t) for k, t in NAMES.items()], names=list(NAMES))


def messages(batch: int, bucket: np.ndarray, *columns: tuple[np.ndarray, int]) -> pa.Table:
    """One row for each bucket that is sent something: its share of the columns (values, width), in their order."""
    order = np.argsort(bucket, kind="stable")
    begin = runs(bucket[order])
    cut = [np.split(order, begin[1:])] if len(order) else [[]]
    out: dict[str, list] = {n: [] for n in ("bucket", "batch", "a", "b", "c")}
    for at in cut[0]:
        out["bucket"].append(int(bucket[at[0]]))
        out["batch"].append(batch)
        for name, (values, width) in zip(("a", "b", "c"), columns, strict=True):
            out[name].append(packed(values[at], width))
    return shaped(len(out["bucket"]), **out)


def answered(bucket: np.ndarray, answers: pa.Table) -> np.ndarray:
    """The answers (bucket, a), one byte for each value sent, in the order of the values."""
    out = np.zeros(len(bucket), np.uint8)
    order = np.argsort(bucket, kind="stable")
    ordered = bucket[order]
    for k, data in zip(column(answers, "bucket"), column(answers, "a"), strict=True):
        out[order[np.searchsorted(ordered, k) : np.searchsorted(ordered, k, side="right")]] = np.frombuffer(data, np.uint8)
    return out


ANSWER = pa.schema([("bucket", pa.int32()), ("batch", pa.int32()), ("a", pa.binary())])


def answers(t: pa.Table, flags: np.ndarray, sizes: list[int]) -> pa.Table:
    parts = np.split(flags.astype(np.uint8), np.cumsum(sizes)[:-1])
    return pa.Table.from_arrays([t.column("bucket").combine_chunks(), t.column("batch").combine_chunks(), pa.array([x.tobytes() for x in parts], pa.binary())], schema=ANSWER)


def repetitive(rows: DataFrame, batches: int, buckets: int) -> DataFrame:
    """The first exchange, and what the second sends: rows of the shape ALL, with a bucket for messages and without for the parts of rows (batch, rid, doc,
    data) all of whose strings have a trigger of two documents or more."""
    sent = pa.schema([("bucket", pa.int32()), ("batch", pa.int32()), ("a", pa.binary()), ("b", pa.binary())])
    back = pa.schema([("batch", pa.int32()), ("shared", pa.binary()), ("hot", pa.binary())])
    bounds = np.array([(k << 48) // buckets for k in range(1, buckets)], np.uint64)

    def collect(t: pa.Table) -> pa.Table:
        docs = np.array(column(t, "doc"), np.int64)
        row, trigger, _, _ = phrases([x or b"" for x in column(t, "data")])
        value, doc = short(trigger), docs[row]
        order, begin, _ = least_by((value,), doc)
        value, doc = value[order], doc[order]
        count = np.diff(np.concatenate([begin, [len(value)]]))
        marks = (doc[begin] != doc[begin + count - 1]).astype(np.uint8) | ((count > HOT_IN_BATCH) << 1).astype(np.uint8)
        cut = np.searchsorted(value[begin], bounds)
        parts = zip(np.split(value[begin], cut), np.split(marks, cut), strict=True)
        out = [(k, a, m) for k, (a, m) in enumerate(parts) if len(a)]
        batch = column(t, "batch")[0]
        return pa.Table.from_pydict({"bucket": [k for k, _, _ in out], "batch": [batch] * len(out), "a": [packed(a) for _, a, _ in out], "b": [m.tobytes() for _, _, m in out]}, schema=sent)

    def meet(t: pa.Table) -> pa.Table:
        held = [unpacked(x) for x in column(t, "a")]
        marks = [np.frombuffer(x, np.uint8) for x in column(t, "b")]
        value, mark = np.concatenate(held), np.concatenate(marks)
        order = np.argsort(value, kind="stable")
        value, mark = value[order], mark[order]
        begin = runs(value)
        count = np.diff(np.concatenate([begin, [len(value)]]))
        mark = np.bitwise_or.reduceat(mark, begin)
        shared = value[begin][(count > 1) | (mark & 1 > 0)]
        hot = value[begin][(count > HOT_BATCHES) | (mark & 2 > 0)]
        out = [(b, h[member(h, shared)]) for b, h in zip(column(t, "batch"), held, strict=True)]
        return pa.Table.from_pydict({"batch": [b for b, h in out if len(h)], "shared": [packed(h) for _, h in out if len(h)], "hot": [packed(h[member(h, hot)]) for _, h in out if len(h)]}, schema=back)

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return shaped(0)
        batch = column(left, "batch")[0]
        shared = np.sort(np.concatenate([unpacked(x) for x in column(right, "shared")]))
        hot = np.sort(np.concatenate([unpacked(x) for x in column(right, "hot")]))
        rids, docs, texts = column(left, "rid"), column(left, "doc"), [x or b"" for x in column(left, "data")]
        row, trigger, first, count = phrases(texts)
        hit = member(short(trigger), shared)
        row, first, count = row[hit], first[hit], count[hit]
        if not len(row):
            return shaped(0)
        new = np.concatenate([[True], (row[1:] != row[:-1]) | (first[1:] != first[:-1] + count[:-1])])
        at = np.flatnonzero(new)
        last = np.concatenate([at[1:], [len(row)]]) - 1
        places = list(zip(row[at].tolist(), first[at].tolist(), (first[last] + count[last] + LENGTH - 1).tolist(), strict=True))
        parts = shaped(len(places), batch=[batch] * len(places), rid=[rids[r] for r, _, _ in places], doc=[docs[r] for r, _, _ in places], first=[a for _, a, _ in places], data=[texts[r][a:z] for r, a, z in places])
        p = Phrases(parts, hot, buckets)
        kept = [packed(np.unique(p.value[p.hot]))] + [b""] * (len(places) - 1)  # with the first part, so that the next step deals alike
        parts = parts.set_column(parts.column_names.index("c"), "c", pa.array(kept, pa.binary()))
        return pa.concat_tables([parts, messages(batch, p.bucket, (p.value, 6), (p.digest, 8), (p.least.view(np.uint64), 8))])

    sets = rows.groupBy("batch").applyInArrow(collect, "bucket int, batch int, a binary, b binary")
    told = sets.groupBy("bucket").applyInArrow(meet, "batch int, shared binary, hot binary")
    return rows.groupBy("batch").cogroup(told.groupBy("batch")).applyInArrow(cut, ALL)


class Phrases:
    """The phrases of a batch's parts, and the distinct ones in the order in which they are sent: by short trigger and digest, with the smallest document of each."""

    def __init__(self, parts: pa.Table, hot: np.ndarray, buckets: int) -> None:
        self.texts = column(parts, "data")
        self.row, self.trigger, self.first, self.count = phrases(self.texts)
        self.doc = np.array(column(parts, "doc"), np.int64)[self.row]
        ends = (self.first + self.count + LENGTH - 1).tolist()
        digest = np.fromiter((xxhash.xxh3_64_intdigest(self.texts[r][a:z]) for r, a, z in zip(self.row.tolist(), self.first.tolist(), ends, strict=True)), np.uint64, len(ends))
        value = short(self.trigger)
        self.order, begin, self.of = least_by((value, digest), self.doc)
        self.lead = self.order[begin]
        self.value, self.digest, self.least = value[self.lead], digest[self.lead], self.doc[self.lead]
        self.hot = member(self.value, hot)
        self.bucket = np.where(self.hot, mixed(self.digest) % np.uint64(buckets), self.value * np.uint64(buckets) >> np.uint64(48)).astype(np.int64)


class Strings:
    """The distinct 50-byte strings of a batch's representatives in the order in which they are sent, by two hashes, with the smallest document of each."""

    def __init__(self, rows: pa.Table, buckets: int) -> None:
        texts = column(rows, "data")
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        counts = sizes - LENGTH + 1
        self.row = np.repeat(np.arange(len(sizes)), counts)
        self.offset = np.arange(len(self.row)) - np.repeat(np.cumsum(counts) - counts, counts)
        data, at = np.frombuffer(b"".join(texts), np.uint8), (np.cumsum(sizes) - sizes)[self.row] + self.offset
        key, other = rolled(data, LENGTH)[at], rolled(data, LENGTH, OTHER_MULTIPLIER)[at] >> np.uint64(32)
        self.doc = np.array(column(rows, "doc"), np.int64)[self.row]
        self.order, begin, self.of = least_by((key, other), self.doc)
        lead = self.order[begin]
        self.key, self.other, self.least = key[lead], other[lead], self.doc[lead]
        self.bucket = ((self.key >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def phrase_answers(sent: DataFrame) -> DataFrame:
    """(bucket, batch, a): GONE and STANDS for each phrase sent."""

    def meet(t: pa.Table) -> pa.Table:
        value = [unpacked(x) for x in column(t, "a")]
        sizes = [len(x) for x in value]
        value, digest = np.concatenate(value), np.concatenate([unpacked(x, 8) for x in column(t, "b")])
        doc = np.concatenate([unpacked(x, 8) for x in column(t, "c")]).view(np.int64)
        order, begin, of = least_by((value, digest), doc)
        least = doc[order][begin][of]
        triggers = value[order][begin]
        other = np.zeros(len(begin), bool)  # the trigger has another phrase
        other[1:] |= triggers[1:] == triggers[:-1]
        other[:-1] |= triggers[:-1] == triggers[1:]
        flags = np.zeros(len(order), np.uint8)
        flags[order] = np.where(doc[order] > least, GONE, np.where(other[of], STANDS, 0))
        return answers(t, flags, sizes)

    return sent.groupBy("bucket").applyInArrow(meet, "bucket int, batch int, a binary")


def string_answers(sent: DataFrame) -> DataFrame:
    """(bucket, batch, a): 1 for each string sent that a smaller document has."""

    def meet(t: pa.Table) -> pa.Table:
        key = [unpacked(x, 8) for x in column(t, "a")]
        sizes = [len(x) for x in key]
        doc = np.concatenate([unpacked(x, 8) for x in column(t, "c")]).view(np.int64)
        order, begin, of = least_by((np.concatenate(key), np.concatenate([unpacked(x, 4) for x in column(t, "b")])), doc)
        flags = np.zeros(len(order), np.uint8)
        flags[order] = doc[order] > doc[order][begin][of]
        return answers(t, flags, sizes)

    return sent.groupBy("bucket").applyInArrow(meet, "bucket int, batch int, a binary")


def ranges(rid: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Table:
    """Byte ranges to remove, those that follow each other (ordered by text and place) joined."""
    at = np.flatnonzero(np.concatenate([[True], (rid[1:] != rid[:-1]) | (begin[1:] > end[:-1]) | (begin[1:] < begin[:-1])])) if len(rid) else np.zeros(0, np.int64)
    last = np.concatenate([at[1:], [len(rid)]]).astype(np.int64)[: len(at)] - 1
    return shaped(len(at), rid=rid[at], begin=begin[at], end=end[last])


def resolved(parts: DataFrame, told: DataFrame, buckets: int) -> DataFrame:
    """From the answers for phrases: ranges of whole phrases, the representatives as parts, and what the third exchange sends."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return shaped(0)
        batch = column(left, "batch")[0]
        hot = np.unique(np.concatenate([unpacked(x) for x in column(left, "c")]))
        p = Phrases(left, hot, buckets)
        flags = answered(p.bucket, right)
        gone, stands = np.zeros(len(p.order), bool), np.zeros(len(p.order), bool)
        gone[p.order] = (p.doc[p.order] > p.least[p.of]) | (flags[p.of] & GONE > 0)
        stands[p.order] = (flags[p.of] & STANDS > 0) | p.hot[p.of]
        stands &= ~gone
        rid, begin = np.array(column(left, "rid"), np.int64)[p.row], np.array(column(left, "first"), np.int64)[p.row] + p.first
        at = np.flatnonzero(stands)
        cut = zip(p.row[at].tolist(), p.first[at].tolist(), (p.first[at] + p.count[at] + LENGTH - 1).tolist(), strict=True)
        kept = shaped(len(at), batch=np.full(len(at), batch, np.int32), rid=rid[at], doc=p.doc[at], first=begin[at], data=[p.texts[r][a:z] for r, a, z in cut])
        out = [ranges(rid[gone], begin[gone], begin[gone] + p.count[gone] + LENGTH - 1), kept]
        if len(at):
            s = Strings(kept, buckets)
            out.append(messages(batch, s.bucket, (s.key, 8), (s.other, 4), (s.least.view(np.uint64), 8)))
        return pa.concat_tables(out)

    return parts.groupBy("batch").cogroup(told.groupBy("batch")).applyInArrow(run, ALL)


def string_ranges(kept: DataFrame, told: DataFrame, buckets: int) -> DataFrame:
    """(rid, begin, end): the strings of representatives that a smaller document has."""
    names = ["rid", "begin", "end"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return shaped(0).select(names)
        s = Strings(left, buckets)
        gone = np.zeros(len(s.order), bool)
        gone[s.order] = (s.doc[s.order] > s.least[s.of]) | (answered(s.bucket, right)[s.of] > 0)
        row = s.row[gone]
        begin = np.array(column(left, "first"), np.int64)[row] + s.offset[gone]
        return ranges(np.array(column(left, "rid"), np.int64)[row], begin, begin + LENGTH).select(names)

    return kept.groupBy("batch").cogroup(told.groupBy("batch")).applyInArrow(run, "rid long, begin long, end long")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: (id, n_bytes, spans, kept): spans are the maximal removed runs (begin, end) of the text's UTF-8 bytes, kept the bytes that stay.

    A byte goes if it lies in a 50-byte string that also starts in a document with a smaller id, judged on the input. Null texts count as empty; texts under
    50 bytes stay whole. Rows with equal ids don't remove from each other; rows with a null id stay whole and remove nothing. An
    empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("data"))
    rows = rows.select(F.xxhash64("doc", "data").alias("rid"), "doc", "data")
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    batches, buckets = max(8, -(-total // BATCH_BYTES)), max(24, -(-total // (48 << 20)))
    batched = rows.where("doc is not null").withColumn("batch", F.pmod(F.xxhash64("rid"), F.lit(batches)).cast("int"))
    sent, kept = ["bucket", "batch", "a", "b", "c"], ["batch", "rid", "doc", "first", "data", "c"]
    first = checkpointed(repetitive(batched, batches, buckets))
    told = phrase_answers(first.where("bucket is not null").select(sent))
    second = checkpointed(resolved(first.where("bucket is null").select(kept), told, buckets))
    told = string_answers(second.where("bucket is not null").select(sent))
    strings = string_ranges(second.where("bucket is null and batch is not null").select(kept), told, buckets)
    whole = second.where("batch is null").select("rid", "begin", "end")
    spans = F.array_sort(F.collect_list(F.struct("begin", "end")))
    found = checkpointed(whole.union(strings).groupBy("rid").agg(spans.alias("ranges")))

    def run(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(them, "data", 4 << 20):
            spans, kept = [], []
            for data, ranges in zip(batch.column("data").to_pylist(), batch.column("ranges").to_pylist(), strict=True):
                out, runs, at = [], [], 0
                for r in ranges or ():
                    if runs and r["begin"] <= runs[-1]["end"]:
                        runs[-1]["end"] = max(runs[-1]["end"], r["end"])
                    else:
                        runs.append(dict(r))
                for r in runs:
                    out.append(data[at : r["begin"]])
                    at = r["end"]
                out.append(data[at:])
                spans.append(runs)
                kept.append(b"".join(out))
            sizes = [len(x) for x in batch.column("data").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes, pa.int64()), pa.array(spans, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())], ["id", "n_bytes", "spans", "kept"])

    both = rows.join(found, "rid", "left").select(F.col("doc").alias("id"), "data", "ranges")
    return both.mapInArrow(run, both.select("id").schema.add("n_bytes", "long").add("spans", T.ArrayType(T.StructType().add("begin", "long").add("end", "long"))).add("kept", "binary"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for all documents."""
    found = remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.col("n_bytes") - F.octet_length("kept")
    return found.select(F.col("id").alias("doc_id"), "n_bytes", removed.cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
