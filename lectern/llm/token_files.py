"""Token ids of documents in Parquet files that can be read in parts.

Documents are laid out by range of their id, so the files, one after the other, hold the corpus in ascending order. A row has the document's id, the place of its ids among
the file's ids (start, stop) and the ids as a list. Ids are dictionary-encoded (a dictionary of 50,000 ids takes 16 bits for each) or delta-encoded; the other columns rise and are delta-encoded.
Row groups and pages are of set sizes and every page has its bounds in the page index, so a reader of some documents, or of a stretch of the corpus' ids, opens the pages that
hold them, and a reader of metadata never opens the ids.

Texts are encoded by the tokenizer library through their distinct pieces: a batch's bytes are cut where no pattern of the pre-tokenizer and no special string
spans the cut, long texts like short ones, and the library sees each distinct piece.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import by_bytes, checkpointed, shared_folder, table

#: Bytes of a batch of texts, which is cut into pieces at once; a longer text is a batch of its own.
BATCH_BYTES = 6 << 20
#: A worker keeps so many pieces, and so many bytes of them, for the tasks it runs one after the other; beyond that it keeps those that it has met more than once.
CACHE_PIECES, CACHE_BYTES = 400_000, 7 << 20
#: Classes of bytes: ASCII white space, letters and digits, punctuation; the rest belongs to characters beyond ASCII, or controls nothing.
SPACE, WORD, MARK = 1, 2, 3
CLASS = np.zeros(256, np.uint8)
CLASS[[9, 10, 11, 12, 13, 32]] = SPACE
CLASS[[b for b in range(128) if chr(b).isalnum()]] = WORD
CLASS[[b for b in range(33, 127) if not chr(b).isalnum()]] = MARK
#: White space beyond ASCII, by its last bytes.
WIDE_SPACE = [int.from_bytes(c.encode(), "big") for c in "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"]


def safe_cuts(data: np.ndarray) -> np.ndarray:
    """Places in UTF-8 bytes where texts of this kind of vocabulary may be cut: before white space that follows something else, and between an ASCII letter or digit and an ASCII mark."""
    kind = CLASS[data]
    left, right = kind[:-1], kind[1:]
    at = np.flatnonzero(((right == SPACE) & (left != SPACE)) | ((left == WORD) & (right == MARK))) + 1
    wide = np.flatnonzero(data[at - 1] >= 128)
    before = at[wide]
    last = lambda n: data[np.maximum(before - n, 0)].astype(np.int64)
    two = last(2) << 8 | last(1)
    keep = np.ones(len(at), bool)
    keep[wide] = ~np.isin(two, WIDE_SPACE) & ~np.isin(last(3) << 16 | two, WIDE_SPACE)
    return at[keep]


class Encoder:
    """A vocabulary file with the ids of the pieces met so far."""

    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
        from tokenizers import Tokenizer

        self.model, self.end_id = Tokenizer.from_file(path), end_id
        self.model.no_truncation()
        self.model.no_padding()
        added = self.model.get_added_tokens_decoder()
        self.special = [t.content.encode() for t in added.values()]
        self.separator = next(((t.content, i) for i, t in added.items() if not (t.lstrip or t.rstrip or t.single_word or t.normalized)), None)
        ids = lambda *texts: list(chain.from_iterable(self.encode_batch(texts)))
        self.cuts = all(ids(f"a.{x}b1&é {x}5é\n{x}x's?") == ids("a", ".", f"{x}b1", "&é", f" {x}5é", f"\n{x}x", "'s", "?") for x in (" ", "  ", "\t", "\n", "\r\n", " \u00a0", " \u3000"))
        self.clear()

    def encode_batch(self, texts) -> list[list[int]]:
        return [x.ids for x in self.model.encode_batch_fast(list(texts), add_special_tokens=False)]

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, lengths) of pieces. A special string, which nothing spans, stands between pieces without special strings, so that one call encodes many."""
        name, sign = self.separator or ("", -1)
        joined = name.join([*pieces, ""]) if name else ""
        if joined.count(name) != len(pieces) or any(x.decode() in joined for x in self.special if x.decode() != name) or not name:
            found = self.encode_batch(pieces)
            lengths = np.fromiter(map(len, found), np.int64, len(found))
            return np.fromiter(chain.from_iterable(found), np.int32, int(lengths.sum())), lengths
        ids = np.array(self.encode_batch([joined])[0], np.int32)
        ends = np.flatnonzero(ids == sign)
        return ids[ids != sign], np.diff(ends, prepend=-1) - 1

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.bytes, self.ids, self.ends, self.met = 0, np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(0, np.int64)

    def shrink(self) -> None:
        """Keep the pieces that more than one batch held, none if these are too many as well."""
        kept = np.flatnonzero(self.met > 1)
        names = list(self.known)
        names = [names[i] for i in kept.tolist()]
        if len(names) > CACHE_PIECES // 2 or (size := sum(map(len, names))) > CACHE_BYTES // 2:
            return self.clear()
        sizes = np.diff(self.ends)[kept]
        self.ids = gathered(self.ids, self.ends[kept], sizes)
        self.known, self.bytes, self.ends, self.met = {x: i for i, x in enumerate(names)}, size, np.concatenate([[0], np.cumsum(sizes)]), np.zeros(len(names), np.int64)

    def numbers(self, pieces: list[str]) -> np.ndarray:
        """The place of each of the distinct pieces among the known ones."""
        if len(self.known) > CACHE_PIECES or self.bytes > CACHE_BYTES:
            self.shrink()
        new = [x for x in pieces if x not in self.known]
        ids, lengths = [self.ids], [np.zeros(0, np.int64)]
        for lo in range(0, len(new), 512):  # what the library returns for a piece takes many times its bytes
            found, sizes = self.encode_pieces(new[lo : lo + 512])
            ids.append(found)
            lengths.append(sizes)
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
        self.ids, sizes = np.concatenate(ids), np.concatenate(lengths)
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])
        self.met = np.concatenate([self.met, np.zeros(len(new), np.int64)])
        self.bytes += sum(map(len, new))
        at = np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))
        self.met[at] += 1
        return at

    def documents(self, texts: pa.StringArray) -> pa.ListArray:
        """The ids of each text and the end id after them, as one list a text; a null text is empty."""
        texts = pa.concat_arrays([pc.fill_null(texts.cast(pa.large_string()), "")])  # offsets from 0, without nulls
        ends = np.frombuffer(texts.buffers()[1], np.int64)[: len(texts) + 1]
        buffer = texts.buffers()[2] or pa.py_buffer(b"")
        data = np.frombuffer(buffer, np.uint8)[: ends[-1]]
        at = safe_cuts(data) if self.cuts and len(data) else np.zeros(0, np.int64)
        for name in self.special:  # no cut within a special string
            begin = np.array([m.start() for m in re.finditer(re.escape(name), data)], np.int64)
            within = np.searchsorted(begin, at, side="left") - 1  # the last that begins before the cut
            at = at[(within < 0) | (at >= begin[np.maximum(within, 0)] + len(name))] if len(begin) else at
        places = np.sort(np.concatenate([at, ends]), kind="stable")
        places = places[np.append(True, np.diff(places) > 0)]
        cut = pa.LargeStringArray.from_buffers(len(places) - 1, pa.py_buffer(places.astype(np.int64)), buffer).dictionary_encode()
        known = self.numbers(cut.dictionary.to_pylist())[np.asarray(cut.indices)]
        starts = self.ends[known]
        lengths = self.ends[known + 1] - starts
        flat = gathered(self.ids, starts, lengths)
        sums = np.concatenate([[0], np.cumsum(lengths)])[np.searchsorted(places, ends)]
        offsets = sums + np.arange(len(ends))
        out = np.full(offsets[-1], self.end_id, np.int32)
        inner = np.ones(len(out), bool)
        inner[offsets[1:] - 1] = False
        out[inner] = flat
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(out))


def gathered(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The stretches of values, one after the other."""
    ends = np.cumsum(lengths)
    at = np.arange(ends[-1] if len(ends) else 0, dtype=np.int32 if len(values) < 1 << 30 else np.int64)
    at += np.repeat((starts - (ends - lengths)).astype(at.dtype), lengths)
    return values[at]


@lru_cache(maxsize=2)
def encoder(path: str, end_id: int) -> Encoder:
    return Encoder(path, end_id)


def write(
    docs: DataFrame, folder: str, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, encoding: str = "dictionary", row_group_bytes: int = 32 << 20, page_bytes: int = 256 << 10, page_rows: int = 256, compression: str = "snappy"
) -> None:
    """Encode docs and write `folder`: part, doc_id, start, stop, ids by ascending doc_id, the parts in order of their number.

    A null text is empty, and an empty one has the end id only. Null ids come first; rows that repeat an id follow each other by XXH64 of their text. An empty table gives a folder that reads as an empty table.
    A text may be of any length that a list value holds. Other columns aren't written. encoding: `dictionary` or `delta`, of the ids.
    """
    if encoding not in ("dictionary", "delta"):
        raise ValueError("encoding is dictionary or delta")
    schema = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, context, begin = encoder(vocabulary, end_id), TaskContext.get(), 0
        part = context.partitionId() if context else 0
        for batch in by_bytes(batches, "text", BATCH_BYTES):
            ids = model.documents(batch.column("text"))
            stops = begin + np.asarray(ids.offsets).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), part, np.int32)), batch.column("id"), pa.array(stops[:-1]), pa.array(stops[1:]), ids], schema=schema)
            begin = int(stops[-1])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("hash"), F.monotonically_increasing_id().alias("row"))
    order = ["id", "hash", "row"]  # the last one deals out rows that are alike
    laid = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "text")
    out = laid.mapInArrow(run, "part int, doc_id long, start long, stop long, ids array<int>").write
    for k, v in {"block.size": row_group_bytes, "page.size": page_bytes, "page.row.count.limit": page_rows, "writer.version": "v2", "enable.dictionary": "false", "enable.dictionary#ids.list.element": str(encoding == "dictionary").lower()}.items():
        out = out.option(f"parquet.{k}", v)
    out.option("compression", compression).parquet(folder)


def begins(files: DataFrame) -> DataFrame:
    """(part, base): the ids before each part, from the metadata columns of the files; a row a part."""
    sums = files.groupBy("part").agg(F.max("stop").alias("n"))
    return sums.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))


def metadata(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens) of all documents, start counted over the corpus; the ids aren't read."""
    files = spark.read.parquet(folder)
    return files.select("part", "doc_id", "start", "stop").join(begins(files), "part").select("doc_id", (F.col("base") + F.col("start")).alias("start"), (F.col("stop") - F.col("start")).alias("n_tokens"))


def tokens_of(spark: SparkSession, folder: str, first: int, last: int) -> DataFrame:
    """(doc_id, ids) of the documents first <= doc_id <= last, from the pages that hold them."""
    return spark.read.parquet(folder).where(F.col("doc_id").between(first, last)).select("doc_id", "ids")


def tokens_between(spark: SparkSession, folder: str, lo: int, hi: int) -> DataFrame:
    """(doc_id, start, ids) of the corpus' ids lo <= i < hi: of each document that holds some, these. start is the place of the first of them in the corpus."""
    files = spark.read.parquet(folder)
    base = begins(files).collect()  # two numbers a file
    found = None
    for r in base:
        own = files.where((F.col("part") == r["part"]) & (F.col("stop") > lo - r["base"]) & (F.col("start") < hi - r["base"]))
        skip, stop = F.greatest(F.lit(lo - r["base"]) - F.col("start"), F.lit(0)), F.least(F.col("stop"), F.lit(hi - r["base"]))
        own = own.select("doc_id", (F.col("start") + skip + r["base"]).alias("start"), F.slice("ids", (skip + 1).cast("int"), (stop - F.col("start") - skip).cast("int")).alias("ids"))
        if r["base"] < hi:
            found = own if found is None else found.union(own)
    return found if found is not None else files.select("doc_id", "start", "ids").limit(0)


def checksums(files: DataFrame) -> DataFrame:
    """(part, doc_id, start, n_tokens, ids_crc32): CRC-32 of each row's ids as little-endian 32-bit integers."""
    schema = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            offsets = np.asarray(ids.offsets).astype(np.int64)
            data = memoryview(np.ascontiguousarray(np.asarray(ids.flatten()), "<i4").view(np.uint8))
            ends = ((offsets - offsets[0]) * 4).tolist()
            crcs = [zlib.crc32(data[lo:hi]) for lo, hi in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("doc_id"), batch.column("start"), pa.array(np.diff(offsets)), pa.array(crcs, pa.int64())], schema=schema)

    return files.select("part", "doc_id", "start", "ids").mapInArrow(run, "part int, doc_id long, start long, n_tokens long, ids_crc32 long")


def remove(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def default_vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of all documents, from the files that were written; the files go once the result is kept."""
    folder = f"{shared_folder(spark)}/token-files-{uuid.uuid4().hex}"
    write(table(spark, sf_dir, "documents"), folder, default_vocabulary())
    files = spark.read.parquet(folder)
    out = checksums(files).join(begins(files), "part").select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")
    out = checkpointed(out)
    remove(spark, folder)
    return out
