"""Chunks of two versions of a text paired with each other, and how each pair changed."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .alignment import parts_in_order
from .differences import MOST_RATIO, MOST_WORDS, compare_words

#: Fixed value: the similarity that a pair in order exceeds.
ALIKE = 0.03
_WORD = re.compile(r"[^\W_]+")
_LOWER = {0x130: "i", 0x3A3: "\u03c3"}

Chunk = tuple[int, str | None, str]


def _words(text: str | None) -> list[str] | None:
    """Distinct words of a chunk in lower case, letter by letter."""
    return None if text is None else list(dict.fromkeys(_WORD.findall(text.translate(_LOWER).lower())))


def pairs(old: list[Chunk], new: list[Chunk]) -> list[tuple[int, int, str]]:
    """(i, j, how): chunks (number, heading's key or nothing, text) of old and new, in the order of their numbers, that belong together, each once: by heading, in order, or by position.

    Equal headings pair first, the first occurrence of each on either side. Of the rest those are paired that keep their order and have the largest sum of word similarities. If both
    sides then have equally many left, these are paired by position.
    """
    first = [{}, {}]
    for held, side in zip(first, (old, new), strict=True):
        for k, (_, key, _) in enumerate(side):
            if key is not None:
                held.setdefault(key, k)
    found = [(i, first[1][key], "heading") for key, i in first[0].items() if key in first[1]]

    def left() -> tuple[list[int], list[int]]:
        used = {i for i, _, _ in found}, {j for _, j, _ in found}
        return [i for i in range(len(old)) if i not in used[0]], [j for j in range(len(new)) if j not in used[1]]

    x, y = left()
    a, b, _ = parts_in_order([_words(old[i][2]) for i in x], [_words(new[j][2]) for j in y], None, ALIKE)
    found += [(x[i], y[j], "order") for i, j in zip(a.tolist(), b.tolist(), strict=True)]
    x, y = left()
    return found + [(i, j, "position") for i, j in zip(x, y, strict=True)] if len(x) == len(y) else found


def changes(old: list[Chunk], new: list[Chunk], met: list[tuple[int, int, str]]) -> Iterator[tuple]:
    """(a, b, how, kind, changed_words, change_ratio) of every chunk."""
    for i, j, how in met:
        d = compare_words(old[i][2] or "", new[j][2] or "")
        words = len(d["words_removed"]) + len(d["words_added"]) + len(d["words_modified"])
        kind = "unchanged" if not words else "changed" if d["change_ratio"] > MOST_RATIO or words >= MOST_WORDS else "minor"
        yield old[i][0], new[j][0], how, kind, words, d["change_ratio"]
    gone, came = {i for i, _, _ in met}, {j for _, j, _ in met}
    yield from ((x[0], None, None, "removed", None, None) for i, x in enumerate(old) if i not in gone)
    yield from ((None, x[0], None, "added", None, None) for j, x in enumerate(new) if j not in came)


def compared(old: DataFrame, new: DataFrame) -> DataFrame:
    """(id, a, b, how, kind, changed_words, change_ratio) of every chunk (id, chunk, heading, text) of old and new: unchanged, minor or changed for a pair, by its word differences, and removed or added for a chunk of one version alone. Chunks with a null id pair with none.

    The chunks of both versions of a text meet in one row by one exchange; they are paired and compared in the task that gets it.
    """
    key = F.when(F.col("heading") != "", T.collapsed(F.lower("heading")))
    side = lambda x, name: x.select("id", F.lit(name).alias("side"), F.struct(F.col("chunk").cast("int").alias("chunk"), key.alias("key"), "text").alias("c"))
    both = side(old, "old").union(side(new, "new"))
    texts = both.groupBy("id").agg(*[F.array_sort(F.collect_list(F.when(F.col("side") == n, F.col("c")))).alias(n) for n in ("old", "new")])
    schema = pa.schema([("id", pa.int64()), ("a", pa.int32()), ("b", pa.int32()), ("how", pa.string()), ("kind", pa.string()), ("changed_words", pa.int32()), ("change_ratio", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                x, y = ([(c["chunk"], c["key"], c["text"]) for c in row[n]] for n in ("old", "new"))
                rows = [(row["id"], *r) for r in changes(x, y, [] if row["id"] is None else pairs(x, y))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return texts.select(F.col("id").cast("long").alias("id"), "old", "new").mapInArrow(run, "id long, a int, b int, how string, kind string, changed_words int, change_ratio double")
