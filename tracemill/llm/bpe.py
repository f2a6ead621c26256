"""Byte-level BPE with a public vocabulary: every text becomes its list of token ids.

A text is cut into pieces by the vocabulary's own pattern. A piece that is a vocabulary entry has
that id. Else its bytes are the leaves of a segment tree whose nodes hold the leftmost minimum of the
ranks of neighbouring pairs; a merge takes the root's pair, and updates the two live neighbours'
ranks on their paths to the root, so a piece of n bytes costs n log n whatever its length. Pieces
come back all the time, so every worker keeps the pieces it has seen lately.

Edge cases: null and empty text give an empty list; blank text is encoded as it is. A lone
surrogate cannot occur in Spark's strings. Special tokens' names in a text are ordinary text. Rows
equal in text are encoded alike; other columns pass through.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The folder of the public tokenizers' files.
FOLDER = "/opt/tokenizers"
#: The pattern this vocabulary's pieces are cut by (a fixed value of the public tokenizer).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces a worker remembers before it starts anew; longer pieces are not remembered.
REMEMBERED, REMEMBERED_LENGTH = 500_000, 64
NONE = 1 << 62


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one piece, by a segment tree over its byte positions."""
    n = len(piece)
    if n == 1:
        return [ranks[piece]]
    size = 1 << (n - 1).bit_length()
    get = ranks.get
    end = list(range(1, n + 1))  # of the part that starts here
    before = list(range(-1, n - 1))
    tree = [NONE] * (2 * size)  # a node holds rank * size + position, so that its minimum is the leftmost
    for i in range(n - 1):
        r = get(piece[i : i + 2])
        if r is not None:
            tree[size + i] = r * size + i
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a <= b else b
    while tree[1] != NONE:
        i = tree[1] % size
        j = end[i]
        end[i] = stop = end[j]
        if stop < n:
            before[stop] = i
        changes = [(j, NONE)]
        r = get(piece[i : end[stop]]) if stop < n else None
        changes.append((i, NONE if r is None else r * size + i))
        h = before[i]
        if h >= 0:
            r = get(piece[h:stop])
            changes.append((h, NONE if r is None else r * size + h))
        for at, value in changes:
            k = size + at
            tree[k] = value
            while k > 1:
                k >>= 1
                a, b = tree[2 * k], tree[2 * k + 1]
                value = a if a <= b else b
                if tree[k] == value:
                    break
                tree[k] = value
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Encoder:
    def __init__(self, path: str) -> None:
        self.ranks = read_ranks(path)
        self.cut = regex.compile(PATTERN).findall
        self.seen: dict[str, list[int]] = {}

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        out: list[int] = []
        seen = self.seen
        for piece in self.cut(text):
            ids = seen.get(piece)
            if ids is None:
                raw = piece.encode()
                whole = self.ranks.get(raw)
                ids = [whole] if whole is not None else merged(raw, self.ranks)
                if len(piece) <= REMEMBERED_LENGTH:
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen[piece] = ids
            out += ids
        return out


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """One encoder a worker; the file is read on the worker."""
    return Encoder(path)


def encode(df: DataFrame, key: str, text: str, folder: str = FOLDER, vocabulary: str = "byte_bpe_50k") -> DataFrame:
    """``key, ids`` of every row."""
    path = f"{folder}/{vocabulary}.tiktoken"
    schema = df.select(key).schema.add("ids", T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in batches:
            ids = pa.array([e.encode(t) for t in b.column(1).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], [key, "ids"])

    return df.select(key, text).mapInArrow(run, schema)


def count_tokens(df: DataFrame, text: str, to: str, folder: str = FOLDER, vocabulary: str = "byte_bpe_50k") -> DataFrame:
    """``df`` with the number of tokens of ``text`` as ``to``."""
    path = f"{folder}/{vocabulary}.tiktoken"

    @F.pandas_udf("long")
    def size(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = encoder(path)
        for t in texts:
            yield t.map(lambda x: len(e.encode(x)), na_action=None)

    return df.withColumn(to, size(text))
