"""Token counts by batch encoding, returning lengths only.

Every text is split at white space, the boundary that no token of the vocabulary spans, and the tokenizer library encodes the distinct pieces in
batches of equal bytes; a text's count is the sum over its pieces. Splitting at every safe boundary, in short and long texts alike, makes the work
follow the distinct words, and no call holds a whole long text.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import Words, default_vocabulary, split_words
from .common import by_bytes, table

PIECE_BATCH_BYTES = 256 << 10


@lru_cache(maxsize=2)
def library(path: str) -> tuple[Callable[[list[str]], list[int]], Callable[[str], list[str]]]:
    """(encode, split) of a vocabulary file, loaded once by a worker: the lengths of a batch of texts, and the cutting of a text at safe boundaries."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)], lambda text: [text]  # its pieces hold the white space
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    ids = lambda text: model.encode(text, add_special_tokens=False).ids
    # White space is a safe boundary only where the normalizer and the pre-tokenizer drop it, whichever of it stands there.
    drops = all(ids(f"a{x}b") == ids("a") + ids("b") for x in (" ", "  ", "\t", "\n", "\r\n", "\n\n", "\u00a0", "\u3000"))
    return lambda texts: [len(x) for x in model.encode_batch_fast(texts, add_special_tokens=False)], split_words if drops else lambda text: [text]


class Counter:
    """A task's pieces with their token counts."""

    def __init__(self, path: str):
        self.encode, self.split = library(path)
        self.clear()

    def clear(self) -> None:
        self.pieces, self.counts = Words(), np.zeros(0, np.int64)

    def learn(self) -> None:
        """Encode the pending pieces in batches of about equal bytes, the longest pieces first."""
        pending = self.pieces.pending
        sizes = np.fromiter((len(x.encode("utf-8", "surrogatepass")) for x in pending), np.int64, len(pending))
        found, order = np.zeros(len(pending), np.int64), np.argsort(-sizes, kind="stable")
        ends = np.cumsum(sizes[order])
        for part in np.split(order, np.flatnonzero(np.diff(ends // PIECE_BATCH_BYTES)) + 1):
            found[part] = self.encode([pending[i] for i in part.tolist()]) if len(part) else 0
        self.counts = np.concatenate([self.counts, found])
        pending.clear()

    def lengths(self, texts: list[str | None]) -> np.ndarray:
        if self.pieces.full():
            self.clear()
        split = [self.split(t) if t else [] for t in texts]
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        numbers = np.fromiter(map(self.pieces.__getitem__, chain.from_iterable(split)), np.int64, int(sizes.sum()))
        self.learn()
        sums = np.concatenate([[0], np.cumsum(self.counts[numbers])])
        ends = np.cumsum(sizes)
        return sums[ends] - sums[ends - sizes]


def counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = 2 << 20) -> DataFrame:
    """(id, n_bytes, n_tokens), a row for each row of docs; null and empty texts have no bytes and no tokens, and repeated rows stay."""
    schema = pa.schema([("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(vocabulary)
        for batch in by_bytes(batches, "text", batch_bytes):
            texts = batch.column("text").to_pylist()
            sizes = [len(t.encode("utf-8", "surrogatepass")) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes, pa.int64()), pa.array(counter.lengths(texts), pa.int64())], ["id", *schema.names])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, rows.select("id").schema.add("n_bytes", "long").add("n_tokens", "long"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than 2048 tokens) for all documents."""
    found = counts(table(spark, sf_dir, "documents"), default_vocabulary())
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))
