"""Byte-pair encoding and decoding.

Encoding splits a text by the tokenizer's pattern; in each piece, adjacent symbols form a doubly linked list, and a priority
queue holds the ranks of the merges that are possible. The lowest rank (leftmost first) is applied until none is left; an entry
whose pair has changed since it was queued is stale and skipped. Decoding concatenates the vocabulary's byte strings.

Cases: a null text gives null tokens, null count and null decoded text; an empty text gives no tokens; ids may be null or
repeated, each row is encoded by itself; other columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import heapq
import os
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StructField, StructType

from .common import col, numbered
from .kernels import scatter, slices

DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces that a worker remembers in each of two generations; a bound on memory, not on what is encoded.
MEMO = 100_000
#: Bytes up to which a piece's ranks are looked through for the lowest one: a queue costs more than it spares there.
SHORT = 24
NONE = 1 << 40


def load_ranks(path: str = DEFAULT_RANKS) -> dict[bytes, int]:
    """Vocabulary file with a base64 string and its rank in each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Memo(dict):
    """Results by key, computed when missing; two generations bound its size and keep what is in use."""

    def __init__(self, compute, size: int = MEMO):
        super().__init__()
        self.compute, self.size, self.old = compute, size, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        self[key] = value
        return value

    def age(self) -> None:
        if len(self) > self.size:
            self.old = dict(self)
            self.clear()


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        import regex

        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        self.single = [ranks[bytes((b,))] for b in range(256)]
        self.two = [ranks.get(bytes((b >> 8, b & 255)), -1) for b in range(1 << 16)]
        self.near = [NONE if r < 0 else r for r in self.two]
        self.pieces = Memo(lambda piece: array("i", self.merge(piece.encode())).tobytes())
        size = max(ranks.values(), default=-1) + 1
        strings = [b""] * size
        for token, rank in ranks.items():
            strings[rank] = token
        self.width = np.array([len(s) for s in strings], np.int64)
        self.begin = np.concatenate(([0], np.cumsum(self.width)[:-1])) if size else np.zeros(0, np.int64)
        self.bytes = np.frombuffer(b"".join(strings), np.uint8)

    def merge(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        return self.scanned(piece) if len(piece) <= SHORT else self.queued(piece)

    def scanned(self, piece: bytes) -> list[int]:
        """The merges of a short piece, the lowest rank (leftmost first) found by looking at all."""
        rank_of, single, near = self.ranks.get, self.single, self.near
        begin = list(range(len(piece) + 1))
        token = [single[b] for b in piece]
        pair = [near[a << 8 | b] for a, b in zip(piece, piece[1:], strict=False)]
        while pair and (rank := min(pair)) < NONE:
            i = pair.index(rank)
            token[i] = rank
            del token[i + 1], begin[i + 1], pair[i]
            if i < len(pair):
                pair[i] = rank_of(piece[begin[i] : begin[i + 2]], NONE)
            if i:
                pair[i - 1] = rank_of(piece[begin[i - 1] : begin[i + 1]], NONE)
        return token

    def queued(self, piece: bytes) -> list[int]:
        n, rank_of, push, pop, two = len(piece), self.ranks.get, heapq.heappush, heapq.heappop, self.two
        # Symbols are linked by where they begin: after[i] is the next one (n at the end), before[i] the previous one.
        after, before = list(range(1, n + 1)), list(range(-1, n))
        token = [self.single[b] for b in piece]
        pair = [two[a << 8 | b] for a, b in zip(piece, piece[1:], strict=False)]  # rank of the merge with the next symbol, -1 if none
        pair.append(-1)
        queue = [rank << 32 | i for i, rank in enumerate(pair) if rank >= 0]
        heapq.heapify(queue)
        while queue:
            entry = pop(queue)
            i = entry & 0xFFFFFFFF
            rank = entry >> 32
            if pair[i] != rank:
                continue  # stale: one of the two symbols has changed since
            right = after[i]
            to = after[right]
            token[i], after[i], pair[right], pair[i] = rank, to, -1, -1
            if to < n:
                before[to] = i
                if (rank := rank_of(piece[i : after[to]])) is not None:
                    pair[i] = rank
                    push(queue, rank << 32 | i)
            if i:
                left = before[i]
                if (rank := rank_of(piece[left:to])) is not None:
                    pair[left] = rank
                    push(queue, rank << 32 | left)
                else:
                    pair[left] = -1
        out, i = [], 0
        while i < n:
            out.append(token[i])
            i = after[i]
        return out

    def encode(self, text: str) -> bytes:
        """Token ids as the bytes of 32-bit integers."""
        out = b"".join(map(self.pieces.__getitem__, self.split(text)))
        self.pieces.age()
        return out

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all tokens on end, and where each token ends."""
        width = self.width[ids]
        return self.bytes[scatter(self.begin[ids], width)], np.cumsum(width)


@lru_cache(2)
def encoder(path: str, pattern: str = PATTERN) -> Encoder:
    if not os.path.exists(path):
        raise FileNotFoundError(f"no vocabulary at {path}")
    return Encoder(load_ranks(path), pattern)


def encode_decode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str = DEFAULT_RANKS, pattern: str = PATTERN) -> DataFrame:
    """Token ids of each text, their number, and the text decoded from them: columns doc_id, tokens, n_tokens, decoded."""

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(ranks, pattern)
        for batch in slices(batches, 1):
            texts = batch.column(1)
            encoded = [b"" if t is None else coder.encode(t) for t in texts.to_pylist()]
            size = np.fromiter(map(len, encoded), np.int64, len(encoded)) // 4
            ends = np.concatenate(([0], np.cumsum(size)))
            ids = np.frombuffer(b"".join(encoded), np.int32)
            data, token_ends = coder.decode(ids)
            byte_ends = np.concatenate(([0], token_ends))[ends]
            void = texts.is_null()
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids), mask=void if texts.null_count else None)
            valid = pa.array(~np.asarray(void.to_numpy(zero_copy_only=False), bool))
            bits = valid.buffers()[1] if texts.null_count else None
            decoded = pa.StringArray.from_buffers(len(texts), pa.py_buffer(byte_ends.astype(np.int32)), pa.py_buffer(data.tobytes()), bits)
            counts = pa.array(size.astype(np.int32), mask=void.to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, counts, decoded], ["doc_id", "tokens", "n_tokens", "decoded"])

    kind = df.select(col(id_col)).schema[0].dataType.simpleString()
    return df.select(col(id_col).alias("doc_id"), col(text_col).alias("text")).mapInArrow(stage, f"doc_id {kind}, tokens array<int>, n_tokens int, decoded string")


def counted(df: DataFrame, text_col: str = "text", ranks: str = DEFAULT_RANKS, pattern: str = PATTERN) -> DataFrame:
    """df with each text replaced by the number of its tokens; by encoding it, for what runs beside an encoding anyway."""
    place = df.columns.index(text_col)

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(ranks, pattern)
        for batch in slices(batches, place, 1 << 20):
            columns = list(batch.columns)
            columns[place] = pa.array([None if t is None else len(coder.encode(t)) // 4 for t in columns[place].to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    work = numbered(df)
    schema = StructType([StructField(f.name, LongType() if k == place else f.dataType) for k, f in enumerate(work.schema.fields)])
    return work.mapInArrow(stage, schema).toDF(*df.columns)
