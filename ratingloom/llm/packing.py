"""Packing token ids into rows of fixed length, best fit decreasing.

Each task tokenises its documents and packs them in groups of a bounded number
of tokens: pieces are taken in order of falling length, and each goes into the
open row whose free space fits it best. A segment tree over free space finds
that row. A document longer than a row is split into full rows and a rest, so
no token is lost. Nothing is shuffled, and a task that is run again packs the
same rows, as it reads the same rows of the input.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: how the public byte-level vocabulary cuts text before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@dataclass(frozen=True)
class PackParams:
    """``ranks_file`` is the tokenizer's file on every executor, and ``end`` the id that closes a
    document and pads rows; rows have ``length`` ids, groups about ``group`` tokens.
    """

    ranks_file: str = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    end: int = 50256
    length: int = 2048
    group: int = 1 << 21


@lru_cache(2)
def _tokenizer(ranks_file: str) -> tiktoken.Encoding:
    with open(ranks_file, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class FreeSpace:
    """Open rows by their free space; a segment tree finds the tightest fit.

    Leaf ``s`` holds the rows with ``s`` free places; an inner node says
    whether any leaf below it holds one.
    """

    def __init__(self, most: int):
        self.width = 1 << most.bit_length()
        self.filled = [False] * (2 * self.width)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def add(self, row: int, space: int) -> None:
        self.rows[space].append(row)
        node = space + self.width
        while node and not self.filled[node]:
            self.filled[node] = True
            node >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """The row with the least free space of at least ``size``, which is taken out, and that space."""
        node = size + self.width
        if not self.filled[node]:
            # up to the first subtree on the right that holds a row, then down to its first leaf
            while node > 1 and not (node % 2 == 0 and self.filled[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.width:
                node = 2 * node if self.filled[2 * node] else 2 * node + 1
        space = node - self.width
        row = self.rows[space].pop(0)
        if not self.rows[space]:
            while node and not (node < self.width and (self.filled[2 * node] or self.filled[2 * node + 1])):
                self.filled[node] = False
                node >>= 1
        return row, space


def best_fit_decreasing(sizes: list[int], length: int) -> list[list[int]]:
    """Rows of item numbers; items are 1 to ``length`` long. Equal sizes keep their order."""
    rows: list[list[int]] = []
    free = FreeSpace(length)
    for item in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        found = free.take(sizes[item])
        if found is None:
            rows.append([])
            found = len(rows) - 1, length
        row, space = found
        rows[row].append(item)
        if space > sizes[item]:
            free.add(row, space - sizes[item])
    return rows


_ROW = (
    "shard int, group int, row int, n_tokens int, ids binary, cu_seqlens array<int>, "
    "position_resets array<int>, doc_ids array<long>, doc_offsets array<int>"
)


def pack_group(documents: list[tuple[int | None, np.ndarray]], params: PackParams) -> Iterator[dict]:
    """Rows of a group of (doc_id, ids)."""
    pieces = [
        (key, start, ids[start : start + params.length])
        for key, ids in documents
        for start in range(0, len(ids), params.length)
    ]
    for number, items in enumerate(best_fit_decreasing([len(p[2]) for p in pieces], params.length)):
        ids = np.full(params.length, params.end, "<u4" if params.end > 0xFFFF else "<u2")
        ends = np.cumsum([len(pieces[i][2]) for i in items]).tolist()
        ids[: ends[-1]] = np.concatenate([pieces[i][2] for i in items])
        bounds = [0, *ends]
        yield {
            "row": number,
            "n_tokens": bounds[-1],
            "ids": ids.tobytes(),
            "cu_seqlens": bounds,
            "position_resets": bounds[:-1],
            "doc_ids": [pieces[i][0] for i in items],
            "doc_offsets": [pieces[i][1] for i in items],
        }


def pack(docs: DataFrame, params: PackParams = PackParams()) -> DataFrame:
    """``docs`` (doc_id, text) as rows of token ids.

    ``ids`` are ``length`` little-endian ids (two bytes each, or four if the vocabulary needs them),
    padded with ``end``; ``cu_seqlens`` are the cumulative segment lengths from 0 to n_tokens;
    position ids start again from 0 at ``position_resets``; each segment comes from the document in
    ``doc_ids``, ``doc_offsets`` tokens into it. Every document ends with ``end``; a null or
    empty text is that token alone. Repeated rows are packed each time; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [
                ("shard", pa.int32()),
                ("group", pa.int32()),
                ("row", pa.int32()),
                ("n_tokens", pa.int32()),
                ("ids", pa.binary()),
                ("cu_seqlens", pa.list_(pa.int32())),
                ("position_resets", pa.list_(pa.int32())),
                ("doc_ids", pa.list_(pa.int64())),
                ("doc_offsets", pa.list_(pa.int32())),
            ]
        )
        encode = _tokenizer(params.ranks_file).encode_ordinary
        shard, group, waiting, size = TaskContext.get().partitionId(), 0, [], 0

        def flush() -> pa.RecordBatch:
            rows = [{"shard": shard, "group": group} | r for r in pack_group(waiting, params)]
            return pa.RecordBatch.from_pylist(rows, schema)

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.array([*encode(text or ""), params.end], np.uint32)
                waiting.append((key, ids))
                size += len(ids)
                if size >= params.group:
                    yield flush()
                    group, waiting, size = group + 1, [], 0
        if waiting:
            yield flush()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _ROW)


def segments(packed: DataFrame, params: PackParams = PackParams()) -> DataFrame:
    """Packed rows back as (doc_id, doc_offset, ids array<int>), one row per segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = "<u4" if params.end > 0xFFFF else "<u2"
        for batch in batches:
            keys, offsets, parts = [], [], []
            for ids, ends, docs, starts in zip(*(batch.column(i).to_pylist() for i in range(4))):
                row = np.frombuffer(ids, kind).astype(np.int32)
                keys += docs
                offsets += starts
                parts += [row[a:b] for a, b in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(offsets, pa.int32()), pa.array(parts, pa.list_(pa.int32()))],
                ["doc_id", "doc_offset", "ids"],
            )

    rows = packed.select("ids", "cu_seqlens", "doc_ids", "doc_offsets")
    return rows.mapInArrow(run, "doc_id long, doc_offset int, ids array<int>")


def position_ids(packed: DataFrame) -> DataFrame:
    """Packed rows with ``positions``, the position id of every token that is not padding."""
    starts, ends = F.col("position_resets"), F.slice("cu_seqlens", F.lit(2), F.size("position_resets"))
    runs = F.zip_with(starts, ends, lambda a, b: F.sequence(F.lit(0), b - a - 1))
    return packed.withColumn("positions", F.flatten(runs))
