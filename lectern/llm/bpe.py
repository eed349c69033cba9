"""Byte-pair encoding and decoding with a pair occurrence index.

The distinct words of a batch are laid end to end as symbols in linked lists. An index maps each pair to all its positions; pairs that have a merge
are active, and active ranks are applied in ascending order to all positions of their pair at once. A merge changes the pairs to
its left and right, whose positions join the lists of their ranks. Words never interact, so one application serves every text of the batch.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_bytes, table

#: Fixed values of the tokenizer file's normalizer and pre-tokenizer: white space, and the pieces of a word.
SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")
PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
SEPARATORS = "\x1c\x1d\x1e\x1f"
#: A task keeps so many words, and so many characters of them; its cache is emptied beyond that, which changes speed only.
CACHE_WORDS, CACHE_CHARS = 100_000, 2 << 20
BATCH_BYTES = 2 << 20


def split_words(text: str) -> list[str]:
    """The words of a text as the tokenizer's white space divides them; str.split() also divides at four control characters."""
    if any(c in text for c in SEPARATORS):
        return [w for w in SPACE.split(text) if w]
    return text.split()


def normalized(piece: str) -> str:
    """NFC, then each character lower-cased on its own."""
    if piece.isascii():
        return piece.lower()
    piece = unicodedata.normalize("NFC", piece)
    return "".join(c.lower() for c in piece) if "Σ" in piece else piece.lower()


class Merges:
    """The merges of a tokenizer file as arrays, and the encoder over them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        suffix = spec["model"]["end_of_word_suffix"] or ""
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special_pattern = re.compile("|".join(map(re.escape, self.special)) or "(?!)")
        self.tokens = [""] * (max(*vocab.values(), *self.special.values()) + 1)
        for token, i in (*vocab.items(), *self.special.items()):
            self.tokens[i] = token
        if len(self.tokens) > 1 << 16:
            raise ValueError("pair keys hold ids of 16 bits")
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        char = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.inner = np.array([vocab[char[b]] for b in range(256)], np.int32)
        self.final = np.array([vocab[char[b] + suffix] for b in range(256)], np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        self.left = np.array([vocab[a] for a, _ in pairs], np.int32)
        self.right = np.array([vocab[b] for _, b in pairs], np.int32)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        keys = self.left.astype(np.uint32) << 16 | self.right.astype(np.uint32)
        self.by_key = np.argsort(keys, kind="stable").astype(np.int32)
        self.keys = keys[self.by_key]

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 where there is no merge."""
        keys = a.astype(np.uint32) << 16 | b.astype(np.uint32)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.by_key[at], -1)

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends): the ids of all pieces laid end to end, and where each piece ends in them. No piece is empty."""
        data = np.frombuffer(b"".join(pieces), np.uint8)
        ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        if not len(pieces):
            return np.zeros(0, np.int32), ends
        symbol = self.inner[data]
        symbol[ends - 1] = self.final[data[ends - 1]]
        following = np.arange(1, len(data) + 1, dtype=np.int64)
        following[ends - 1] = -1
        before = np.arange(-1, len(data) - 1, dtype=np.int64)
        before[np.concatenate([[0], ends[:-1]])] = -1
        # The index: positions of each active pair, by rank.
        at = np.flatnonzero(following >= 0)
        rank = self.ranks(symbol[at], symbol[at + 1])
        at, rank = at[rank >= 0], rank[rank >= 0]
        order = np.argsort(rank, kind="stable")
        at, rank = at[order], rank[order]
        present, first = np.unique(rank, return_index=True)
        index = {int(r): [part] for r, part in zip(present, np.split(at, first[1:]), strict=True)} if len(present) else {}
        active = list(index)
        heapq.heapify(active)
        while active:
            r = heapq.heappop(active)
            lists = index.pop(r)
            where = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            a, b, made = self.left[r], self.right[r], self.made[r]
            after = following[where]
            holds = (symbol[where] == a) & (after >= 0) & (symbol[after] == b)
            where = where[holds]
            if a == b and len(where) > 1:  # of overlapping pairs, every other one from the left
                where = np.unique(where)
                joined = np.concatenate([[False], following[where[:-1]] == where[1:]])
                n = np.arange(len(where))
                where = where[(n - np.maximum.accumulate(np.where(joined, 0, n))) % 2 == 0]
            if not len(where):
                continue
            gone = following[where]
            after = following[gone]
            symbol[where], symbol[gone] = made, -1
            following[where] = after
            has = after >= 0
            before[after[has]] = where[has]
            left = before[where]
            left = left[left >= 0]
            right = where[has]
            new = np.concatenate([left, right])
            if not len(new):
                continue
            rank = self.ranks(symbol[new], symbol[following[new]])
            new, rank = new[rank >= 0], rank[rank >= 0]
            if len(new) == 0:
                continue
            order = np.argsort(rank, kind="stable")
            new, rank = new[order], rank[order]
            bounds = np.flatnonzero(np.diff(rank)) + 1
            for k, part in zip(rank[np.concatenate([[0], bounds])].tolist(), np.split(new, bounds), strict=True):
                if k in index:
                    index[k].append(part)
                else:
                    index[k] = [part]
                    heapq.heappush(active, k)
        alive = symbol >= 0
        return symbol[alive], np.cumsum(alive)[ends - 1]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends): the ids of all words laid end to end, and where each word ends in them.

        The pieces of a word follow each other. Special strings inside a word are tokens of their own, found before normalisation; their places
        are filled in after the pieces are encoded.
        """
        pieces: list[bytes] = []
        last: list[int] = []
        special: list[tuple[int, int]] = []  # after how many pieces, and the id
        for word in words:
            if "<" in word and self.special_pattern.search(word):
                at = 0
                for m in self.special_pattern.finditer(word):
                    pieces += [x.encode("utf-8", "surrogatepass") for x in PIECE.findall(normalized(word[at : m.start()]))]
                    special.append((len(pieces), self.special[m[0]]))
                    pieces.append(b"?")
                    at = m.end()
                word = word[at:]
            text = normalized(word)
            if text.isalpha():
                pieces.append(text.encode("utf-8", "surrogatepass"))
            else:
                pieces += [x.encode("utf-8", "surrogatepass") for x in PIECE.findall(text)]
            last.append(len(pieces))
        ids, ends = self.encode_pieces(pieces)
        ends = np.concatenate([[0], ends])
        for n, i in special:
            ids[ends[n]] = i
        return ids, ends[last] if last else np.zeros(0, np.int64)


class Words(dict):
    """Word numbers by first appearance; words that were new are in pending."""

    def __init__(self):
        super().__init__()
        self.pending: list[str] = []
        self.chars = 0

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.pending.append(word)
        self.chars += len(word)
        return n

    def full(self) -> bool:
        return len(self) > CACHE_WORDS or self.chars > CACHE_CHARS


@lru_cache(maxsize=2)
def merges(path: str) -> Merges:
    """The merges of a tokenizer file, read once by a worker; of fixed size."""
    return Merges(path)


class Cache:
    """A task's words and their ids, laid end to end."""

    def __init__(self, path: str):
        self.merges = merges(path)
        self.spaced = [t + " " for t in self.merges.tokens]
        self.clear()

    def clear(self) -> None:
        self.words, self.ids, self.ends = Words(), np.zeros(0, np.int32), np.zeros(1, np.int64)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends): the ids of all texts laid end to end, and where each text ends in them."""
        if self.words.full():
            self.clear()
        split = [split_words(t) if t else [] for t in texts]
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        numbers = np.fromiter(map(self.words.__getitem__, chain.from_iterable(split)), np.int64, int(sizes.sum()))
        if self.words.pending:
            ids, ends = self.merges.encode_words(self.words.pending)
            self.ids, self.ends = np.concatenate([self.ids, ids]), np.concatenate([self.ends, ends + len(self.ids)])
            self.words.pending.clear()
        begins, lengths = self.ends[numbers], self.ends[numbers + 1] - self.ends[numbers]
        stops = np.cumsum(lengths)
        found = self.ids[np.repeat(begins - stops + lengths, lengths) + np.arange(stops[-1] if len(stops) else 0)]
        return found, np.concatenate([[0], stops])[np.cumsum(sizes)]


def encode_texts(cache: Cache, texts: list[str | None]) -> Iterator[tuple[bytes, str]]:
    """(ids as little-endian 32-bit integers, decoded text) of each text; null counts as empty."""
    ids, ends = cache.encode(texts)
    ids, token = ids.astype("<u4"), cache.spaced.__getitem__
    for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
        yield ids[a:b].tobytes(), "".join(map(token, ids[a:b].tolist()))[:-1]


def encode(docs: DataFrame, vocabulary: str, text_col: str = "text") -> DataFrame:
    """docs with n_tokens, ids (binary: little-endian unsigned 32-bit integers) and decoded (string) appended.

    The ids are those of the tokenizer file `vocabulary`, without added special tokens; special strings inside a text are special tokens. decoded
    joins the tokens with single spaces, special ones included. Null and empty texts have no tokens. Columns of docs with these
    three names are replaced. Rows keep their order and number, repeated ones too.
    """
    added = ("n_tokens", "ids", "decoded")
    kept = docs.select([c for c in docs.columns if c not in added])
    schema = kept.select("*").schema.add("n_tokens", "long").add("ids", "binary").add("decoded", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Cache(vocabulary)
        for batch in by_bytes(batches, text_col, BATCH_BYTES):
            found = list(encode_texts(cache, batch.column(text_col).to_pylist()))
            rows, size = 0, 0
            for i, (ids, decoded) in enumerate(found):  # a result is larger than its text
                size += len(ids) + len(decoded)
                if size > BATCH_BYTES or i + 1 == len(found):
                    part = found[rows : i + 1]
                    columns = [*batch.slice(rows, len(part)).columns, pa.array([len(x) // 4 for x, _ in part], pa.int64()), pa.array([x for x, _ in part], pa.binary()), pa.array([x for _, x in part], pa.string())]
                    yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, *added])
                    rows, size = i + 1, 0

    return kept.mapInArrow(run, schema)


def default_vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for all documents."""
    found = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), default_vocabulary())
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
