"""Helpers that the training-data operators share: inputs, shared folders, packed exchanges."""

from __future__ import annotations

import ctypes
import functools
import gc
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"


#: Bytes of text that an Arrow batch may hold; by rows alone, batches of long texts would fill an executor.
BATCH_BYTES = 4 << 20


def bounded(docs: DataFrame) -> DataFrame:
    """docs, with the session's Arrow batches limited by bytes as well as by rows."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return docs


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, so that further columns, whatever their names, can't get in the way."""
    return bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


KEPT: list[Callable] = []


def kept_by_worker(make: Callable) -> Callable:
    """What `make` gives for a few arguments, made once for each worker process and kept from task to task until `forget_kept`."""
    cached = functools.lru_cache(maxsize=2)(make)
    KEPT.append(cached)
    return cached


def forget_kept() -> None:
    """Frees what earlier operators' tasks left in this worker, for operators that need the memory themselves."""
    held = [f for f in KEPT if f.cache_info().currsize]
    for f in held:
        f.cache_clear()
    if held:
        gc.collect()
        try:  # small objects' pages go back to the machine only if asked for
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError, TypeError):
            pass


def spare(docs: DataFrame, name: str) -> str:
    """A column name like this one that docs doesn't have."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where the session names none and all runs on one machine (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not (own := getattr(spark, "_lattica_shared", None)):
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        own = "file://" + tempfile.mkdtemp(prefix="lattica-shared-")
        spark._lattica_shared = own
        spark.sparkContext.setCheckpointDir(own)
    return own


#: Folders of the tables that were written, for `temporary`.
PATHS: list[str] = []


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """What is written inside is removed at the end, but for the table written last."""
    before = len(PATHS)
    try:
        yield
    finally:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path
        for path in PATHS[before:-1]:
            folder = hadoop(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        del PATHS[before:-1]


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a table in the shared folder, read again: lineage ends here, and lost executors cost nothing above it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    PATHS.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def batch_of(names: list[str], columns: list, types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types, strict=True)], names=names)


def mix64(x: np.ndarray) -> np.ndarray:
    """A finaliser for 64-bit hashes (splitmix64), array-wise."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def single_threaded() -> None:
    """Native tokenizer threads would fight the executor's other tasks."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ["RAYON_NUM_THREADS"] = "1"


# --- packed exchange -------------------------------------------------------------------------------------------
# A shuffle of many small fixed-width records costs most of its time in row objects. Here each map task sorts its
# records by bucket with numpy and sends one binary row per bucket and flush; the reduce side gets arrays again.


def pack_by_bucket(records: np.ndarray, bucket: np.ndarray, buckets: int) -> pa.RecordBatch:
    """records (structured array) cut by bucket into rows (bucket int, payload binary)."""
    order = np.argsort(bucket, kind="stable")
    records, bucket = records[order], bucket[order]
    ends = np.searchsorted(bucket, np.arange(buckets), side="right")
    starts = np.concatenate([[0], ends[:-1]])
    used = np.flatnonzero(ends > starts)
    return batch_of(["bucket", "payload"], [used.tolist(), [records[starts[b] : ends[b]].tobytes() for b in used]], [pa.int32(), pa.binary()])


def payloads(batches: Iterator[pa.RecordBatch], dtype: np.dtype) -> np.ndarray:
    parts = [np.frombuffer(p, dtype=dtype) for b in batches for p in column(b, "payload")]
    return np.concatenate(parts) if parts else np.empty(0, dtype=dtype)


def exchange(packed: DataFrame, buckets: int) -> DataFrame:
    """Rows (bucket, payload) so that each task of the next stage holds whole buckets, one bucket to a task where possible."""
    return packed.repartition(buckets, "bucket")


# --- Bloom filter of fixed size ----------------------------------------------------------------------------------
#: 4 MB, whatever the input: a filter before a shuffle join, which stays exact. Where it fills up, it only lets more through.
BLOOM_BITS = 1 << 25
BLOOM_SLOTS = 16


def bloom_places(x: np.ndarray) -> list[np.ndarray]:
    h = mix64(x.view(np.uint64))
    return [((h >> np.uint64(s)) & np.uint64(BLOOM_BITS - 1)).astype(np.int64) for s in (0, 19, 38)]


def bloom_filter(keys: DataFrame) -> np.ndarray:
    """Packed bits for keys (one long column). Tasks' bits are united slot by slot; the driver gets BLOOM_SLOTS rows."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(BLOOM_BITS, bool)
        n = 0
        for b in batches:
            n += b.num_rows
            for places in bloom_places(b.column(0).to_numpy(zero_copy_only=False)):
                bits[places] = True
        if n:
            parts = np.packbits(bits).reshape(BLOOM_SLOTS, -1)
            yield batch_of(["bucket", "payload"], [list(range(BLOOM_SLOTS)), [p.tobytes() for p in parts]], [pa.int32(), pa.binary()])

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        united: dict[int, np.ndarray] = {}
        for b in batches:
            for slot, payload in zip(column(b, "bucket"), column(b, "payload"), strict=True):
                part = np.frombuffer(payload, np.uint8)
                united[slot] = united[slot] | part if slot in united else part
        if united:
            yield batch_of(["bucket", "payload"], [[*united], [p.tobytes() for p in united.values()]], [pa.int32(), pa.binary()])

    schema = "bucket int, payload binary"
    out = np.zeros((BLOOM_SLOTS, BLOOM_BITS // 8 // BLOOM_SLOTS), np.uint8)
    for r in exchange(keys.mapInArrow(build, schema), BLOOM_SLOTS).mapInArrow(unite, schema).collect():
        out[r.bucket] = np.frombuffer(r.payload, np.uint8)
    return out.reshape(-1)


def maybe_in(df: DataFrame, name: str, bits: np.ndarray) -> DataFrame:
    """Rows of df whose long column `name` may be among the filter's keys: all that are, and few others."""
    shared = df.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for b in batches:
            x = b.column(b.schema.get_field_index(name)).to_numpy(zero_copy_only=False)
            keep = np.ones(len(x), bool)
            for places in bloom_places(x):
                keep &= (bits[places >> 3] >> (7 - (places & 7)).astype(np.uint8)) & 1 == 1
            yield b.filter(pa.array(keep))

    return df.mapInArrow(run, df.schema)
