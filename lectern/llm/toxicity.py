"""Toxicity by a convolutional text classifier.

A word's embedding is the mean of hashed rows for the word and its beginnings, filters of several widths slide over the words of the whole text, and
the largest value of each filter feeds a logistic output. The network is trained in numpy on a bounded sample of labelled rows. Its threshold is
calibrated by language: the language is guessed from the text alone, and the logit is shifted so that each language's own threshold lies at
a score of 0.7. Scoring reads the text and nothing else.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import Words
from .common import by_bytes, table

ROWS = 1 << 15
DIM = 8
WIDTHS = (1, 2, 3)
FILTERS = 8
BEGINNINGS = (4, 5)
PADS = max(WIDTHS)
#: At most so many labelled rows of each class, and so many bytes of their texts, are trained on.
PER_CLASS, BYTES_PER_CLASS = 2000, 32 << 20
THRESHOLD = 0.7
#: A language has a threshold of its own with so many calibration rows of either class; others share one.
OWN_THRESHOLD = 10
EDGES = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())


def word_table(words: list[str]) -> np.ndarray:
    """The embedding rows of each word, hashed from the word and its beginnings (in bytes) without ASCII punctuation at its ends; ROWS stands for none."""
    crc, found = zlib.crc32, []
    for word in words:
        w = word.lower().strip(EDGES).encode("utf-8", "surrogatepass")
        found.append((crc(w, 1) if w else -1, *[crc(w[:n]) if len(w) >= n else -1 for n in BEGINNINGS]))
    rows = np.array(found, np.int64).reshape(len(words), 1 + len(BEGINNINGS))
    return np.where(rows < 0, ROWS, rows % ROWS).astype(np.int32)


@dataclass
class Model:
    """Weights; prior is the score of every text where there was nothing to learn from."""

    prior: float | None = None
    embedding: np.ndarray = field(default_factory=lambda: np.zeros((ROWS + 1, DIM), np.float32))
    filters: list[np.ndarray] = field(default_factory=list)  # of each width: (width, DIM, FILTERS)
    bias: list[np.ndarray] = field(default_factory=list)
    out: np.ndarray = field(default_factory=lambda: np.zeros(len(WIDTHS) * FILTERS, np.float32))
    constant: float = 0.0
    languages: list[str] = field(default_factory=list)
    profile: np.ndarray = field(default_factory=lambda: np.zeros((ROWS + 1, 1), np.float32))  # log odds of a word by language
    shift: np.ndarray = field(default_factory=lambda: np.zeros(1, np.float32))  # by language

    def vectors(self, rows: np.ndarray) -> np.ndarray:
        return self.embedding[rows].sum(axis=1) / np.maximum((rows < ROWS).sum(axis=1), 1)[:, None].astype(np.float32)


class Scorer:
    """A model with the projections of the words seen so far, a row for each offset of each filter."""

    def __init__(self, model: Model):
        self.model = model
        if model.prior is None:
            self.clear()

    def clear(self) -> None:
        pads = np.full((1, 1 + len(BEGINNINGS)), ROWS, np.int32)
        self.words = Words()
        self.words[""] = 0
        self.part, self.profile = self.project(pads)

    def project(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        m = self.model
        x = m.vectors(rows)
        return np.concatenate([x @ w[o] for w in m.filters for o in range(len(w))], axis=1), m.profile[rows[:, 0]]

    def pooled(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(largest filter values, number of the language) of each text; texts without words have padding alone."""
        if self.words.full():
            self.clear()
        split = [[*(t.split() if t else ()), *[""] * PADS] for t in texts]
        ends = np.cumsum(np.fromiter(map(len, split), np.int64, len(split)))
        numbers = np.fromiter(map(self.words.__getitem__, chain.from_iterable(split)), np.int64, int(ends[-1]))
        if self.words.pending:
            part, profile = self.project(word_table(self.words.pending))
            self.part, self.profile = np.concatenate([self.part, part]), np.concatenate([self.profile, profile])
            self.words.pending.clear()
        starts = np.concatenate([[0], ends[:-1]])
        out, at = np.empty((len(split), len(WIDTHS) * FILTERS), np.float32), 0
        for k, width in enumerate(WIDTHS):
            n = len(numbers) - width + 1
            value = self.part[numbers[:n], at * FILTERS : (at + 1) * FILTERS].copy()
            for o in range(1, width):
                value += self.part[numbers[o : o + n], (at + o) * FILTERS : (at + o + 1) * FILTERS]
            for j in range(width - 1):  # windows that begin in the padding would reach into the next text
                value[(ends - 1 - j)[ends - 1 - j < n]] = -np.inf
            out[:, k * FILTERS : (k + 1) * FILTERS] = np.maximum.reduceat(value, starts, axis=0) + self.model.bias[k]
            at += width
        language = np.add.reduceat(self.profile[numbers], starts, axis=0).argmax(axis=1)
        return np.maximum(out, 0), language

    def logits(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        pooled, language = self.pooled(texts)
        return pooled @ self.model.out + self.model.constant, language

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.model.prior is not None:
            return np.full(len(texts), self.model.prior)
        logit, language = self.logits(texts)
        return 1 / (1 + np.exp(-np.clip((logit + self.model.shift[language]).astype(np.float64), -30, 30)))


def calibration_split(n: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """(calibration, fitted): a fifth of the rows is kept for the thresholds; fewer than 50 rows serve both ends."""
    if n < 50:
        return np.arange(n), np.arange(n)
    kept = rng.permutation(n)[: n // 5]
    return kept, np.setdiff1d(np.arange(n), kept)


def departure(docs: list[np.ndarray], rows: np.ndarray, y: np.ndarray, of: np.ndarray) -> np.ndarray:
    """For each embedding row, by how many standard deviations more toxic texts hold it than a random share of all texts would."""
    seen = np.zeros((2, ROWS + 1))
    for i in of:
        np.add.at(seen[int(y[i])], np.unique(rows[docs[i]]), 1)
    n1, n = float(y[of].sum()), float(len(of))
    both = seen.sum(axis=0)[:ROWS]
    share = both / n
    spread = np.sqrt(np.maximum(n1 * (n - n1) / n * share * (1 - share), 1e-9))
    return np.where(both > 0, (seen[1][:ROWS] - n1 * share) / np.maximum(spread, 0.3), 0)


def train(texts: list[str], toxic: list[int], langs: list[str | None], steps: int = 600, batch: int = 32, seed: int = 7) -> Model:
    """Fit a model in 8 passes over the rows, or more up to `steps` batches. Without rows, or with rows of one class, every score is the share of toxic rows (0 without rows), kept within 0 and 1."""
    y = np.asarray(toxic, np.float32)
    if len(set(toxic)) < 2:
        return Model(prior=float(y.mean()) if len(y) else 0.0)
    rng = np.random.default_rng(seed)
    words = Words()
    words[""] = 0
    docs = [np.array([words[w] for w in [*t.split(), *[""] * PADS]], np.int64) for t in texts]
    rows = word_table(list(words))
    filled = np.maximum((rows < ROWS).sum(axis=1), 1).astype(np.float32)
    m = Model()
    m.embedding[:ROWS] = rng.normal(0, 0.1, (ROWS, DIM))
    m.filters = [rng.normal(0, 0.5 / np.sqrt(w), (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    m.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
    m.out = rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32)
    fitted_on = calibration_split(len(docs), rng)
    # The first coordinate of a row begins at how far its share of toxic texts departs from chance, and the first filter of width 1 reads it.
    m.embedding[:ROWS, 0] = 2 * np.tanh(departure(docs, rows, y, fitted_on[1]) / 8)
    m.filters[0][0, :, 0] = np.eye(DIM, dtype=np.float32)[0] * 2
    m.out[0] = 2
    squares = {}

    def step(name, value, grad, at=slice(None), rate=0.1):
        s = squares.setdefault(name, np.full(value.shape, 1e-6, np.float32))
        s[at] += grad * grad
        value[at] -= rate * grad / np.sqrt(s[at])

    constant = np.zeros(1, np.float32)
    calibration, fitted = fitted_on
    for _ in range(max(8, -(-steps * batch // len(fitted)))):
        order = rng.permutation(fitted)
        for chosen in np.split(order, range(batch, len(order), batch)):
            ids = np.concatenate([docs[i] for i in chosen])
            ends = np.cumsum([len(docs[i]) for i in chosen])
            starts = ends - [len(docs[i]) for i in chosen]
            used, inverse = np.unique(ids, return_inverse=True)
            x = (m.embedding[rows[used]].sum(axis=1) / filled[used][:, None])[inverse]
            best, top = [], []
            for w, b in zip(m.filters, m.bias, strict=True):
                n = len(ids) - len(w) + 1
                value = sum(x[o : o + n] @ w[o] for o in range(len(w)))
                at = np.stack([s + value[s : e - len(w) + 1].argmax(axis=0) for s, e in zip(starts, ends, strict=True)])
                best.append(at)
                top.append(np.take_along_axis(value, at, axis=0) + b)
            z = np.maximum(np.concatenate(top, axis=1), 0)
            g = (1 / (1 + np.exp(-np.clip(z @ m.out + constant, -30, 30))) - y[chosen]) / len(chosen)
            gz = g[:, None] * m.out * (z > 0)
            step("out", m.out, z.T @ g + 1e-4 * m.out)
            step("constant", constant, np.array([g.sum()], np.float32))
            gx: dict[str, list] = {"at": [], "by": []}
            for k, w in enumerate(m.filters):
                gk = gz[:, k * FILTERS : (k + 1) * FILTERS]
                grad = np.empty_like(w)
                for o in range(len(w)):
                    grad[o] = np.einsum("bkd,bk->dk", x[best[k] + o], gk)
                    gx["at"].append((best[k] + o).ravel())
                    gx["by"].append((gk[..., None] * w[o].T).reshape(-1, DIM))
                step(f"filter{k}", w, grad)
                step(f"bias{k}", m.bias[k], gk.sum(axis=0))
            by = np.concatenate(gx["by"])
            word = ids[np.concatenate(gx["at"])]
            live = np.abs(by).sum(axis=1) > 0
            word, by = word[live], by[live] / filled[word[live]][:, None]
            target = rows[word]
            touched, where = np.unique(target, return_inverse=True)
            grad = np.zeros((len(touched), DIM), np.float32)
            np.add.at(grad, where.reshape(target.shape), np.broadcast_to(by[:, None, :], (*target.shape, DIM)))
            inside = touched < ROWS
            step("embedding", m.embedding, grad[inside], touched[inside])
    m.constant = float(constant[0])
    # Language profiles: log odds of the hashed words of each language's texts.
    m.languages = sorted({x or "" for x in langs})
    counts = np.ones((ROWS + 1, len(m.languages)), np.float64)
    for d, x in zip(docs, langs, strict=True):
        np.add.at(counts[:, m.languages.index(x or "")], rows[np.unique(d), 0], 1)
    share = counts / counts.sum(axis=0)
    m.profile = (np.log(share) - np.log(share).mean(axis=1, keepdims=True)).astype(np.float32)
    m.profile[ROWS] = 0
    # The threshold of a language: midway in the widest gap around the cut with the fewest errors on the calibration rows.
    m.shift = np.zeros(len(m.languages), np.float32)
    held = calibration
    logit, guess = Scorer(m).logits([texts[i] for i in held])
    goal = np.log(THRESHOLD / (1 - THRESHOLD))
    for k in range(len(m.languages)):
        mine = guess == k
        a, b = (mine, y[held]) if min(np.sum(y[held][mine] == c) for c in (0, 1)) >= OWN_THRESHOLD else (np.ones_like(mine), y[held])
        order = np.argsort(logit[a])
        value, label = logit[a][order], b[a][order]
        errors = np.concatenate([[0], np.cumsum(label)]) + np.concatenate([np.cumsum((1 - label)[::-1])[::-1], [0]])
        cuts = np.concatenate([[value[0] - 1], (value[1:] + value[:-1]) / 2, [value[-1] + 1]])
        good = cuts[errors == errors.min()]
        m.shift[k] = goal - (good.min() + good.max()) / 2
    return m


def sample(documents: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, bytes_per_class: int = BYTES_PER_CLASS) -> tuple[list, list, list]:
    """Texts, labels and languages of at most `per_class` rows of each class, drawn by a hash of the id among rows outside the held-out third.

    Of rows with one id, one is taken, and an id with both labels counts as toxic. Texts are taken in the order of the hash while their bytes, all together, stay within `bytes_per_class`; longer
    ones are not learned from. Labels other than 0 and 1 and null ids are left out.
    """
    known = labels.where("doc_id is not null and toxic in (0, 1)").where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) != 1)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    drawn = lambda c: known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
    chosen = F.broadcast(drawn(0).union(drawn(1)))  # at most twice per_class rows of two numbers
    lang = F.col("lang") if "lang" in documents.columns else F.lit(None).cast("string")
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), lang.alias("lang"))
    rows = rows.where(F.octet_length("text") <= bytes_per_class).join(chosen, "doc_id")
    rows = rows.groupBy("doc_id", "toxic").agg(F.min_by(F.struct("text", "lang"), F.xxhash64("text", "lang")).alias("one")).select("doc_id", "toxic", "one.*")
    before = Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)  # at most per_class rows each
    rows = rows.withColumn("bytes", F.sum(F.octet_length("text")).over(before)).where(F.col("bytes") <= bytes_per_class).drop("bytes").collect()
    rows.sort(key=lambda r: r["doc_id"])
    return [r["text"] for r in rows], [r["toxic"] for r in rows], [r["lang"] for r in rows]


def with_scores(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """docs with the column `name` appended or replaced. Null and empty texts get the score of a text without words; repeated rows get equal scores."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size: about 2 MB
    rows = docs.drop(name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in by_bytes(batches, text_col, 2 << 20):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scorer.scores(batch.column(text_col).to_pylist()), pa.float64())], [*batch.schema.names, name])

    return rows.mapInArrow(run, rows.select("*").schema.add(name, "double"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted for all documents."""
    documents = table(spark, sf_dir, "documents")
    model = train(*sample(documents, table(spark, sf_dir, "labels")))
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1
    return with_scores(documents.select("doc_id", "text"), model).select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
