"""Encoding of texts with a byte-level BPE vocabulary: a segment tree over adjacent pair ranks.

A text is cut into pieces by the vocabulary's pattern. Within a piece, each leaf of a segment tree
holds the rank of the pair that starts at a part (or none); inner nodes hold the smaller of their
children, the left one in ties, so the root yields the leftmost lowest-rank merge. A merge changes
three leaves, each in logarithmic time, until no pair can be merged.

Texts repeat their words. Pieces end before every white space that follows other characters, so a
text is cut at its blanks with a fast split and each distinct chunk is encoded once per worker; the
caches are emptied when full, which costs time but changes nothing. Within a piece, a boundary
between two bytes that stand side by side in no entry of the vocabulary can never be crossed by a
merge; long runs of letters are cut there first.

Defined cases. Null and empty texts get an empty list. Text that looks like a special token is
plain text. Texts of any length are encoded whole. Repeated rows are encoded alike.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Folder of the public tokenizers' vocabulary files.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that splits text before merges, as published with the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries of a worker's cache of chunks, and the characters up to which a chunk or part is kept.
CACHE_ENTRIES, CACHE_CHARS = 300_000, 64
NONE = 1 << 62
#: A blank may end a chunk if another character than white space stands before it.
UNSAFE = re.compile(r"\s ").search
SAFE_BLANK = re.compile(r"(?<=\S) ").split


class Kept(dict):
    """Cache that computes what it lacks, keeps short keys and empties itself when full."""

    def __init__(self, compute: Callable):
        super().__init__()
        self.compute = compute

    def __missing__(self, key):
        value = self.compute(key)
        if len(key) <= CACHE_CHARS:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[key] = value
        return value


class Encoder:
    """One vocabulary, with its caches."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.ranks = ranks
        self.find = regex.compile(pattern).findall
        self.joints = {t[i : i + 2] for t in ranks for i in range(len(t) - 1)}
        self.parts = Kept(self.merge)
        self.pieces = Kept(self.piece)
        self.after_blank = Kept(lambda text: self.chunk(" " + text))

    @classmethod
    def from_bytes(cls, raw: bytes) -> Encoder:
        return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())})

    @classmethod
    def from_file(cls, path: str) -> Encoder:
        with open(path, "rb") as f:
            return cls.from_bytes(f.read())

    def merge(self, part: bytes) -> list[int]:
        """Ids of one part by the segment tree."""
        ranks = self.ranks
        if part in ranks:
            return [ranks[part]]
        n = len(part)
        size = 1 << max(0, n - 2).bit_length()
        tree = [NONE] * (2 * size)  # rank * n + position: the order of merges in one number
        start, after, before = list(range(n)), list(range(1, n + 1)), list(range(-1, n - 1))
        token = [part[i : i + 1] for i in range(n)]
        get = ranks.get
        for i in range(n - 1):
            if (r := get(part[i : i + 2])) is not None:
                tree[size + i] = r * n + i
        for k in range(size - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])

        def put(leaf: int, value: int) -> None:
            k = size + leaf
            tree[k] = value
            k >>= 1
            while k:
                v = min(tree[2 * k], tree[2 * k + 1])
                if tree[k] == v:
                    break
                tree[k] = v
                k >>= 1

        while (top := tree[1]) != NONE:
            i = top % n
            j = after[i]
            token[i] += token[j]
            token[j] = b""
            nxt = after[i] = after[j]
            if j < n - 1:
                put(j, NONE)
            if nxt < n:
                before[nxt] = i
                r = get(token[i] + token[nxt])
                put(i, NONE if r is None else r * n + i)
            else:
                put(i, NONE)
            if (p := before[i]) >= 0:
                r = get(token[p] + token[i])
                put(p, NONE if r is None else r * n + p)
        return [ranks[token[i]] for i in start if token[i]]

    def piece(self, text: str) -> list[int]:
        """Ids of one piece of the pattern, cut where no merge can cross."""
        raw = text.encode("utf-8", "replace")
        if raw in self.ranks:
            return [self.ranks[raw]]
        cuts = [0, *(i for i in range(1, len(raw)) if raw[i - 1 : i + 1] not in self.joints), len(raw)]
        out: list[int] = []
        for a, b in zip(cuts, cuts[1:]):
            out += self.parts[raw[a:b]]
        return out

    def chunk(self, text: str) -> list[int]:
        out: list[int] = []
        for p in self.find(text):
            out += self.pieces[p]
        return out

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        first, *rest = SAFE_BLANK(text) if UNSAFE(text) else text.split(" ")
        return list(chain(self.chunk(first), chain.from_iterable(map(self.after_blank.__getitem__, rest))))


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """The encoder of a vocabulary file."""
    return Encoder.from_file(path)


@lru_cache(maxsize=4)
def shared_encoder(raw: bytes) -> Encoder:
    """The encoder of a vocabulary; one per worker process, so caches outlive tasks."""
    return Encoder.from_bytes(raw)


def shipped(documents: DataFrame, path: str | None):
    """The vocabulary file, read on the driver and sent to the executors (0.8 MB for the default one), which need no copy.

    Without a path it is the default file in the folder that spark.cohortloom.tokenizers names, or in TOKENIZERS.
    """
    spark = documents.sparkSession
    path = path or f"{spark.conf.get('spark.cohortloom.tokenizers', TOKENIZERS)}/{VOCABULARY}"
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode_documents(documents: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ids of each document. Narrow: no shuffle; Arrow batches in and flat lists out."""
    vocabulary = shipped(documents, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = shared_encoder(vocabulary.value)
        for batch in batches:
            flat: list[np.ndarray] = []
            ends = np.zeros(batch.num_rows + 1, dtype=np.int32)
            for i, text in enumerate(batch.column(1)):
                ids = np.array(enc.encode(text.as_py()), dtype=np.int32)
                flat.append(ids)
                ends[i + 1] = ends[i] + len(ids)
            values = np.concatenate(flat) if flat else np.zeros(0, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], names=["doc_id", "ids"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id bigint, ids array<int>")


def count_tokens(documents: DataFrame, columns: list[str], path: str | None = None) -> DataFrame:
    """The named columns and n_tokens of each document's text (0 for null and empty texts)."""
    vocabulary = shipped(documents, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = shared_encoder(vocabulary.value)
        for batch in batches:
            n = [len(enc.encode(text.as_py())) for text in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n, pa.int64())], names=[*columns, "n_tokens"])

    df = documents.select(*columns, "text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields[:-1])
    return df.mapInArrow(run, f"{schema}, n_tokens bigint")
