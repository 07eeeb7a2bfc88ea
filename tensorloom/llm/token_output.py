"""Packed token-id matrices.

A task tokenises its rows and packs what it holds, a window of some millions of
ids at a time, by best-fit decreasing: pieces by falling length, each into the
fullest sequence that still takes it, which a segment tree over the capacities
finds. Sequences that a window leaves open pass their pieces on to the next
window, so only a task's last one costs space. There is no shuffle, and a lost
task makes the same sequences again.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensorloom.llm.staging import ship_code
from tensorloom.llm.tokens import tokenizer, vocabulary

SEQ_LEN, END_ID, PAD_ID = 4096, 1, 0
WINDOW = 1 << 21
#: A sequence with more room than this is packed again with the next window.
OPEN_ROOM = 16


class CapacityTree:
    """For every room 0..n the sequences that have it; finds the least room of at least x."""

    def __init__(self, n: int):
        self.size = 1 << n.bit_length()
        self.any = bytearray(2 * self.size)
        self.at: list[list[int]] = [[] for _ in range(self.size)]

    def put(self, room: int, sequence: int) -> None:
        self.at[room].append(sequence)
        i = self.size + room
        while i and not self.any[i]:
            self.any[i] = 1
            i >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """Removes and returns (room, sequence) of the tightest fit."""
        i = self.size + least
        if not self.any[i]:
            while i > 1 and (i & 1 or not self.any[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if self.any[2 * i] else 2 * i + 1
        room = i - self.size
        sequence = self.at[room].pop()
        if not self.at[room]:
            self.any[i] = 0
            i >>= 1
            while i and not (self.any[2 * i] or self.any[2 * i + 1]):
                self.any[i] = 0
                i >>= 1
        return room, sequence


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Sequences as lists of places in lengths; none exceeds capacity."""
    tree, out = CapacityTree(capacity), []
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        got = tree.take(n)
        if got is None:
            out.append([i])
            tree.put(capacity - n, len(out) - 1)
        else:
            out[got[1]].append(i)
            tree.put(got[0] - n, got[1])
    return out


def token_pieces(batches: Iterator[pd.DataFrame], path: str, seq_len: int) -> Iterator[tuple[int | None, int, int, np.ndarray]]:
    """(doc_id, piece, start, ids) of every document, with the end id; only longer ones than seq_len are cut."""
    for b in batches:
        texts = [x if isinstance(x, str) else "" for x in b["text"]]
        docs = b["doc_id"].astype("Int64").tolist()
        for lo, hi in spans(texts):
            flat, size = tokenizer(path).encode(texts[lo:hi])
            ends = np.cumsum(size)
            for i, (n, end) in enumerate(zip(size.tolist(), ends.tolist(), strict=True)):
                ids = np.empty(n + 1, "<u4")
                ids[:n], ids[n] = flat[end - n : end], END_ID
                doc = docs[lo + i]
                for piece, start in enumerate(range(0, n + 1, seq_len)):
                    yield (None if doc is pd.NA else doc), piece, start, ids[start : start + seq_len]


def spans(texts: list[str], most: int = 1 << 23) -> Iterator[tuple[int, int]]:
    """Stretches of texts of about `most` characters."""
    lo = held = 0
    for i, x in enumerate(texts):
        held += len(x)
        if held >= most:
            yield lo, i + 1
            lo, held = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


SCHEMA = (
    "sequence_id long, n_tokens int, ids binary, position_ids binary, cu_seqlens array<int>, doc_ids array<long>, "
    "pieces array<int>, starts array<long>, ids_crc32 long"
)


def _matrix_row(sequence: int, parts: list, seq_len: int) -> tuple:
    n = [len(p[3]) for p in parts]
    ids = np.full(seq_len, PAD_ID, "<u4")
    positions = np.zeros(seq_len, "<u4")
    cu = np.concatenate([[0], np.cumsum(n)]).astype("int32")
    for a, p in zip(cu, parts, strict=False):
        ids[a : a + len(p[3])] = p[3]
        positions[a : a + len(p[3])] = np.arange(len(p[3]))
    return (sequence, int(cu[-1]), ids.tobytes(), positions.tobytes(), cu.tolist(), [p[0] for p in parts], [p[1] for p in parts], [p[2] for p in parts], zlib.crc32(ids[: cu[-1]].tobytes()))


def _packer(path: str, seq_len: int, window: int):
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base, made = TaskContext.get().partitionId() << 33, 0
        held: list = []

        def emit(last: bool) -> Iterator[pd.DataFrame]:
            nonlocal held, made
            rows, left = [], []
            for places in best_fit_decreasing(np.array([len(p[3]) for p in held], np.int64), seq_len):
                parts = [held[i] for i in places]
                if not last and seq_len - sum(len(p[3]) for p in parts) > OPEN_ROOM:
                    left += parts
                    continue
                rows.append(_matrix_row(base + made, parts, seq_len))
                made += 1
                if len(rows) == 256:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            held = left
            if rows:
                yield pd.DataFrame(rows, columns=names)

        tokens = 0
        for part in token_pieces(batches, path, seq_len):
            held.append(part)
            tokens += len(part[3])
            if tokens >= window:
                yield from emit(False)
                tokens = sum(len(p[3]) for p in held)
                if tokens > window // 2:
                    yield from emit(True)
                    tokens = 0
        yield from emit(True)

    return run


def packed_matrices(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, seq_len: int = SEQ_LEN, window: int = WINDOW) -> DataFrame:
    """One row per sequence: ids and position_ids (little-endian unsigned 32-bit, padded with 0 to seq_len), cu_seqlens, doc_ids, pieces, starts, ids_crc32.

    Positions start again at 0 with every piece. Null and empty texts are the
    end id alone; a document longer than seq_len is cut into pieces that joined
    by `starts` give it back; null ids and repeated rows stay; extra columns are
    not read; no rows give no rows. A task holds one window of ids.
    """
    ship_code(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return base.mapInPandas(_packer(path or vocabulary(), seq_len, window), SCHEMA)


def write_packed(docs: DataFrame, target: str, **options) -> None:
    """The matrices as a Parquet table, one row per sequence."""
    packed_matrices(docs, **options).write.option("compression", "zstd").parquet(target)
