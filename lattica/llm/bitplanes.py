"""Token-id shards in bit-plane form.

Ids are cut into blocks of fixed size. A block's ids (uint32) are transposed into byte planes (or, by parameter, bit
planes), each plane is compressed by zstandard, and the chunk index keeps each plane's place, so that one block, or one
plane of it, can be read alone. A shard: MAGIC, planes of all blocks, document index (compressed), chunk index, footer.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_of, column, documents, table, written
from .wordcache import segment_encoder

MAGIC = b"LPLN0001"
FOOTER = struct.Struct("<QQQQIII8s")  # documents, ids, places of the document and chunk index, block, planes, blocks, magic
BLOCK = 1 << 15
BYTE_PLANES, BIT_PLANES = 4, 32
LEVEL = 1
SHARD_IDS = 1 << 21
END = np.zeros(1, "<u4").tobytes()


def to_planes(ids: np.ndarray, planes: int) -> list[bytes]:
    """ids as uint32: plane k has bits or bytes k, lowest first, of all ids."""
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if planes == BYTE_PLANES:
        return [raw[:, k].tobytes() for k in range(4)]
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(bits[:, k], bitorder="little").tobytes() for k in range(32)]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    if len(planes) == BYTE_PLANES:
        return np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1).reshape(-1).view("<u4")
    bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in planes], axis=1)
    return np.packbits(bits, axis=1, bitorder="little").reshape(-1).view("<u4")


def write_shard(doc_ids: list[int], lengths: list[int], ids: np.ndarray, block: int = BLOCK, planes: int = BYTE_PLANES, level: int = LEVEL) -> bytes:
    """A null doc_id is kept as the least int64."""
    press = zstandard.ZstdCompressor(level=level).compress
    parts, index, at = [MAGIC], [], len(MAGIC)
    for i in range(0, len(ids), block):
        for plane in to_planes(ids[i : i + block], planes):
            parts.append(p := press(plane))
            index.append((at, len(p)))
            at += len(p)
    docs = np.array([[NULL_ID if d is None else d, n] for d, n in zip(doc_ids, lengths, strict=True)], "<i8").reshape(-1, 2)
    parts.append(d := press(docs.T.tobytes()))
    at_docs, at = at, at + len(d)
    parts.append(np.array(index, "<u8").reshape(-1, 2).tobytes())
    blocks = -(-len(ids) // block)
    parts.append(FOOTER.pack(len(docs), len(ids), at_docs, at, block, planes, blocks, MAGIC))
    return b"".join(parts)


NULL_ID = -(1 << 63)


class Shard:
    """Reads a shard: all of it, or the blocks that a range of ids needs."""

    def __init__(self, data: bytes):
        self.data = data
        if data[: len(MAGIC)] != MAGIC or data[-len(MAGIC) :] != MAGIC:
            raise ValueError("not a shard")
        self.n_docs, self.n_ids, self.at_docs, self.at_index, self.block, self.planes, self.blocks, _ = FOOTER.unpack(data[-FOOTER.size :])
        self.index = np.frombuffer(data, "<u8", self.blocks * self.planes * 2, self.at_index).reshape(self.blocks, self.planes, 2)
        self.inflate = zstandard.ZstdDecompressor().decompress

    def documents(self) -> tuple[list[int | None], np.ndarray]:
        table = np.frombuffer(self.inflate(self.data[self.at_docs : self.at_index]), "<i8").reshape(2, -1)
        return [None if d == NULL_ID else int(d) for d in table[0]], table[1]

    def read_block(self, k: int) -> np.ndarray:
        n = min(self.block, self.n_ids - k * self.block)
        return from_planes([self.inflate(self.data[a : a + size]) for a, size in self.index[k].tolist()], n)

    def ids(self, start: int = 0, end: int | None = None) -> np.ndarray:
        end = self.n_ids if end is None else end
        if end <= start:
            return np.empty(0, "<u4")
        first, last = start // self.block, (end - 1) // self.block
        got = np.concatenate([self.read_block(k) for k in range(first, last + 1)])
        return got[start - first * self.block : end - first * self.block]


SHARDS = "part int, seq int, first_start long, n_ids long, content binary"


def write_shards(docs: DataFrame, tokenizer_path: str, label: str = "planes") -> DataFrame:
    """Shards of all documents in ascending doc_id order (nulls first, ties by text), each document's ids then id 0.

    Rows are ranged by doc_id, so part follows doc_id; each task encodes its range and closes a shard at SHARD_IDS
    ids, so that a shard is far from the 2 GB that a cell may have unless a single document is. Spark's committer stores the shards, so
    lost tasks leave nothing behind; the files are rows (name in part and seq, content), readable on any store that Spark reads. Equal
    ids share a task, which holds a shard at a time, whatever their number. Repeated rows are written repeatedly.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seq, start = segment_encoder(tokenizer_path), TaskContext.get().partitionId(), 0, 0
        doc_ids, lengths, ids, held = [], [], [], 0

        def close() -> pa.RecordBatch:
            content = write_shard(doc_ids, lengths, np.frombuffer(b"".join(ids), "<u4"))
            return batch_of(["part", "seq", "first_start", "n_ids", "content"], [[part], [seq], [start], [held], [content]], [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()])

        for b in batches:
            keys, texts = column(b, "doc_id"), column(b, "text")
            for d, x in zip(keys, encoder.encode([t or "" for t in texts]), strict=True):
                doc_ids.append(d)
                ids += [x, END]
                lengths.append(len(x) // 4 + 1)
                held += lengths[-1]
                if held >= SHARD_IDS:
                    yield close()
                    seq, start = seq + 1, start + held
                    doc_ids, lengths, ids, held = [], [], [], 0
        if held:
            yield close()

    ranged = documents(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return written(ranged.mapInArrow(run, SHARDS), label)


def read_shards(shards: DataFrame) -> DataFrame:
    """Per document: start, n_tokens, ids_crc32, all from the shards' bytes.

    A part's base is the sum of the parts before it: one row a task of the writer, added up on the driver.
    """
    spark = shards.sparkSession
    base, bases = 0, []
    for part, n in sorted((r.part, r.n) for r in shards.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()):
        bases.append((part, base))
        base += n
    offsets = spark.createDataFrame(bases, "part int, base long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content, first in zip(column(b, "content"), column(b, "first"), strict=True):
                shard = Shard(content)
                keys, lengths = shard.documents()
                raw = shard.ids().tobytes()
                ends = np.cumsum(lengths)
                starts = ends - lengths
                crcs = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield batch_of(["doc_id", "start", "n_tokens", "ids_crc32"], [keys, starts + first, lengths, crcs], [pa.int64()] * 4)

    joined = shards.join(F.broadcast(offsets), "part").select("content", (F.col("first_start") + F.col("base")).alias("first"))
    return joined.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def export_shards(shards: DataFrame, folder: str) -> DataFrame:
    """The shards as plain files `part-seq.planes` in a folder that all executors share; names and sizes are returned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        for b in batches:
            names, sizes = [], []
            for part, seq, content in zip(column(b, "part"), column(b, "seq"), column(b, "content"), strict=True):
                name = f"{part:06d}-{seq:06d}.planes"
                with open(f"{folder}/.{name}.{os.getpid()}", "wb") as f:
                    f.write(content)
                os.replace(f.name, f"{folder}/{name}")
                names.append(name)
                sizes.append(len(content))
            yield batch_of(["name", "bytes"], [names, sizes], [pa.string(), pa.int64()])

    return shards.mapInArrow(run, "name string, bytes long")


def op4_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`write_shards` of documents, read back by `read_shards`: a row per row, the end id alone for null and empty texts. Rows with a null doc_id
    come first, rows with an equal one by their text. An empty table gives no row."""
    import public_tokenizers

    return read_shards(write_shards(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))
