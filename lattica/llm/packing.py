"""Hierarchical packing of documents into sequences of several context sizes.

A document's ids beyond whole longest windows are routed to the smallest tier that holds them. Tiers are packed from the
longest: each window takes the longest waiting pieces that fit, first of its own tier, then of shorter ones; what gap
is left is filled by cutting a waiting piece, so that a window is full. Full windows of a flush are dealt to step
groups of nearly equal tokens. The tail of a task's stream is closed in powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heapify, heapreplace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import batch_of, column, documents, table
from .wordcache import segment_encoder

TIERS = (512, 1024, 2048, 4096)
#: Tokens of a step group, and tokens that wait before a flush.
STEP_TOKENS = 16 * 4096
FLUSH_TOKENS = 64 * 4096
END_ID = 2


@dataclass(slots=True)
class Piece:
    doc: tuple  # doc_id, ids, number of ids
    start: int
    length: int


class Packer:
    """Takes documents one by one; gives windows (size, pieces). Waiting pieces are kept by tier, sorted by length."""

    def __init__(self, tiers: tuple[int, ...] = TIERS, flush: int = FLUSH_TOKENS):
        self.tiers, self.flush_at = tiers, flush
        self.waiting: dict[int, list[tuple[int, int, Piece]]] = {t: [] for t in tiers}
        self.held = self.order = 0

    def route(self, piece: Piece) -> None:
        if piece.length:
            tier = next(t for t in self.tiers if piece.length <= t)
            insort(self.waiting[tier], (piece.length, self.order, piece))
            self.order += 1
            self.held += piece.length

    def add(self, doc: tuple) -> list[tuple[int, list[Piece]]]:
        top, n = self.tiers[-1], doc[2]
        whole = n // top * top
        windows = [(top, [Piece(doc, s, top)]) for s in range(0, whole, top)]
        self.route(Piece(doc, whole, n - whole))
        return windows + (self.flush() if self.held >= self.flush_at else [])

    def take(self, tier: int, most: int) -> Piece | None:
        """The longest waiting piece of up to `most` ids in a tier."""
        queue = self.waiting[tier]
        k = bisect_right(queue, (most, self.order, None)) - 1
        if k < 0:
            return None
        _, _, piece = queue.pop(k)
        self.held -= piece.length
        return piece

    def fill(self, size: int) -> list[Piece]:
        """One window: whole pieces while any fits, then a cut one. Called only where enough ids wait."""
        pieces, gap = [], size
        lower = [t for t in reversed(self.tiers) if t <= size]
        while gap and (piece := next((p for t in lower if (p := self.take(t, gap))), None)):
            pieces.append(piece)
            gap -= piece.length
        if gap:
            tier = next((t for t in self.tiers if self.waiting[t]), None)
            if tier is None:
                return pieces
            _, _, piece = self.waiting[tier].pop()
            self.held -= piece.length
            pieces.append(Piece(piece.doc, piece.start, gap))
            self.route(Piece(piece.doc, piece.start + gap, piece.length - gap))
        return pieces

    def flush(self) -> list[tuple[int, list[Piece]]]:
        windows = []
        for size in reversed(self.tiers):
            while self.waiting[size] and self.held >= size:
                windows.append((size, self.fill(size)))
        return windows

    def close(self) -> list[tuple[int, list[Piece]]]:
        windows = self.flush()
        while self.held:
            windows.append(self.rest(1 << (min(self.held, self.tiers[-1]).bit_length() - 1)))
        return windows

    def rest(self, size: int) -> tuple[int, list[Piece]]:
        pieces, gap = [], size
        while gap:
            tier = next(t for t in reversed(self.tiers) if self.waiting[t])
            _, _, piece = self.waiting[tier].pop()
            self.held -= piece.length
            used = min(gap, piece.length)
            pieces.append(Piece(piece.doc, piece.start, used))
            self.route(Piece(piece.doc, piece.start + used, piece.length - used))
            gap -= used
        return size, pieces


def step_groups(sizes: list[int], step: int = STEP_TOKENS) -> list[int]:
    """A group for each window: longest first, each to the group with the fewest tokens."""
    loads = [(0, g) for g in range(max(1, round(sum(sizes) / step)))]
    heapify(loads)
    groups = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        load, g = loads[0]
        groups[i] = g
        heapreplace(loads, (load + sizes[i], g))
    return groups


NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group"]


def pack_documents(docs: DataFrame, tokenizer_path: str, with_ids: bool = False) -> DataFrame:
    """One row per piece; with_ids adds its ids (little-endian uint32).

    Each task packs its own rows, as they come from the input, so nothing is shuffled; sequence_id and step_group carry
    the task's number in their upper bits. Null or empty text: the end id alone. Repeated rows are packed repeatedly.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = segment_encoder(tokenizer_path), Packer()
        end = np.array([END_ID], "<u4").tobytes()
        base = TaskContext.get().partitionId() << 33
        sequence = group = 0

        def rows(windows: list[tuple[int, list[Piece]]]) -> Iterator[pa.RecordBatch]:
            nonlocal sequence, group
            if not windows:
                return
            out, groups = [], step_groups([size for size, _ in windows])
            for (size, pieces), g in zip(windows, groups, strict=True):
                offset = 0
                for p in pieces:
                    ids = p.doc[1][4 * p.start : 4 * (p.start + p.length)]
                    out.append((p.doc[0], p.start, p.length, zlib.crc32(ids), p.doc[2], base + sequence, offset, size, base + group + g, *([ids] if with_ids else [])))
                    offset += p.length
                sequence += 1
            group += max(groups) + 1
            yield batch_of(NAMES + ["ids"] * with_ids, [*zip(*out, strict=True)], [pa.int64()] * 9 + [pa.binary()] * with_ids)

        for b in batches:
            keys, texts = column(b, "doc_id"), column(b, "text")
            windows = []
            for d, x in zip(keys, encoder.encode([t or "" for t in texts]), strict=True):
                windows += packer.add((d, x + end, len(x) // 4 + 1))
            yield from rows(windows)
        yield from rows(packer.close())

    schema = ", ".join(f"{n} long" for n in NAMES) + ", ids binary" * with_ids
    return documents(docs).mapInArrow(run, schema)


def op8_hierarchical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`pack_documents` of documents: one or more pieces per row, the end id alone for null and empty texts; an empty table gives no piece."""
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
