"""Patterns of labels: inference from examples, and which of them overlap."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Runs that examples are cut into: digits, capitals, small letters, white space, and any other character by itself.
RUNS = r"[0-9]+|[A-Z]+|[a-z]+|\s+|[^0-9A-Za-z\s]"
CLASSES = (("[0-9]", "^[0-9]"), ("[A-Z]", "^[A-Z]"), ("[a-z]", "^[a-z]"), (r"\s", r"^\s"))
SPECIAL = r"([\\.^$|?*+(){}\[\]\-#&~])"


def infer(examples: DataFrame) -> DataFrame:
    """(id, pattern, examples): the patterns of a group's examples (id, text), one for each sequence of kinds of characters.

    Kinds are digits, capitals, small letters and white space; other characters stand for themselves, and so does a run of letters that is the same in all of at least two examples. A run's length goes from the least to the most
    that was seen. Every example matches its pattern. Only the runs of equal places are aggregated, so no group is held as a whole.
    """
    runs = F.regexp_extract_all("text", F.lit(RUNS), F.lit(0))
    quoted = lambda x: F.regexp_replace(x, SPECIAL, r"\\$1")

    def kind(x):
        ladder = None
        for name, p in CLASSES:
            ladder = F.when(F.rlike(x, F.lit(p)), name) if ladder is None else ladder.when(F.rlike(x, F.lit(p)), name)
        return ladder.otherwise(quoted(x))

    x = examples.where("text is not null and text <> ''").select("id", runs.alias("runs")).withColumn("shape", F.array_join(F.transform("runs", kind), ""))
    parts = x.select("id", "shape", F.posexplode("runs").alias("no", "run"))
    by = parts.groupBy("id", "shape", "no").agg(F.min(F.length("run")).alias("low"), F.max(F.length("run")).alias("high"), F.min("run").alias("one"), F.max("run").alias("other"), F.count("*").alias("n"))
    fixed = (F.col("one") == F.col("other")) & (F.col("n") > 1) & F.rlike("one", F.lit("^[A-Za-z]"))
    times = F.when((F.col("low") == 1) & (F.col("high") == 1), "").when(F.col("low") == F.col("high"), F.concat(F.lit("{"), F.col("low").cast("string"), F.lit("}"))).otherwise(F.concat(F.lit("{"), F.col("low").cast("string"), F.lit(","), F.col("high").cast("string"), F.lit("}")))
    by = by.withColumn("piece", F.when(fixed, quoted(F.col("one"))).otherwise(F.concat(kind(F.col("one")), times)))
    whole = by.groupBy("id", "shape").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "piece"))), lambda p: p["piece"]), "").alias("pattern"), F.max("n").alias("examples"))
    return whole.select("id", "pattern", "examples")


#: A piece of an inferred pattern: a kind or a character, and how often it stands.
PIECE = re.compile(r"(\[0-9\]|\[A-Z\]|\[a-z\]|\\s|\\.|.)(?:\{(\d+)(?:,(\d+))?\})?", re.S)
_KINDS = {"[0-9]": lambda c: c.isdigit(), "[A-Z]": str.isupper, "[a-z]": str.islower, r"\s": str.isspace}


def steps(pattern: str) -> list[tuple[str, bool]]:
    """The characters of the longest match, each a kind or itself, and whether it may be left out."""
    out = []
    for kind, low, high in PIECE.findall(pattern):
        kind = kind if kind in _KINDS else kind[-1]
        least, most = int(low or 1), int(high or low or 1)
        out += [(kind, False)] * least + [(kind, True)] * (most - least)
    return out


def overlaps(one: str, other: str) -> bool:
    """Whether some text matches both patterns, by walking the product of their automata."""
    a, b = steps(one), steps(other)
    meet = lambda x, y: x == y or (y in _KINDS and x not in _KINDS and _KINDS[y](x)) or (x in _KINDS and y not in _KINDS and _KINDS[x](y))
    seen, todo = {(0, 0)}, [(0, 0)]
    while todo:
        i, j = todo.pop()
        if i == len(a) and j == len(b):
            return True
        after = [(i + 1, j)] if i < len(a) and a[i][1] else []
        after += [(i, j + 1)] if j < len(b) and b[j][1] else []
        after += [(i + 1, j + 1)] if i < len(a) and j < len(b) and meet(a[i][0], b[j][0]) else []
        for state in after:
            if state not in seen:
                seen.add(state)
                todo.append(state)
    return False


def conflicts(patterns: DataFrame) -> DataFrame:
    """(id, a, b, pattern_a, pattern_b): pairs of levels a < b of a group whose patterns (id, level, pattern) overlap. A group has as many patterns as a document type has levels."""
    x = patterns.select("id", F.col("level").alias("a"), F.col("pattern").alias("pattern_a"))
    y = patterns.select("id", F.col("level").alias("b"), F.col("pattern").alias("pattern_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [overlaps(p, q) for p, q in zip(batch.column("pattern_a").to_pylist(), batch.column("pattern_b").to_pylist(), strict=True)]
            yield batch.filter(pa.array(good, pa.bool_()))

    pairs = x.join(y, "id").where("a < b").select("id", "a", "b", "pattern_a", "pattern_b")
    return pairs.mapInArrow(run, pairs.schema)
