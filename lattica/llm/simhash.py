"""SimHash near-duplicates by a byte-position inverted index with count filtering.

Fingerprints of 64 bits that differ in at most 4 bits agree in at least 4 of their 8 bytes. The index is dealt by the bytes at
three positions at once, over 20 position sets of which any 4 agreeing bytes contain one, so that lists stay short at any
size. Within a list, postings of the single bytes at the other positions are tallied pair by pair; pairs whose tally
reaches the guaranteed 4 are verified by their differing bits. Equal fingerprints are one entry. Long lists are searched
breadth first, so that what is already reached is not tallied again; very long ones are dealt anew as pairs of blocks.
Each task gives stars, not pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_of, bounded, column, documents, exchange, mix64, pack_by_bucket, partitions, payloads, spare, table, written
from .components import connected_components, local_roots

SHINGLE = 4
SEED = 42
MOST_BITS = 4
LEAST_BYTES = 8 - MOST_BITS
KEY_BYTES = 3
#: A list longer than this is searched breadth first.
LONG_LIST = 64
#: A list longer than this is searched as pairs of blocks, each in a task of its own.
BLOCK = 1 << 15


def fingerprint(text: str | None) -> int:
    """Bit i is set if it is in over half of the hashes of the shingles of words, repeats included; no word: 0."""
    words = (text or "").encode("utf-8").lower().split()  # of bytes: A-Z alone, and the six ASCII blanks
    if not words:
        return 0
    if len(words) < SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)), strict=False))
    digest = xxhash.xxh64_digest
    hashes = np.frombuffer(b"".join([digest(s, SEED) for s in shingles]), np.uint8).reshape(-1, 8)
    if len(hashes) < 255:
        counts = np.unpackbits(hashes, axis=1).sum(axis=0, dtype=np.uint8).astype(np.int64)
    else:
        counts = np.zeros(64, np.int64)
        for i in range(0, len(hashes), 255):
            counts += np.unpackbits(hashes[i : i + 255], axis=1).sum(axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, *further: str) -> DataFrame:
    """(doc_id, fp, further columns) with fp the fingerprint as a signed long."""
    types = [docs.schema[c].dataType.simpleString() for c in further]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t) for t in column(b, "text")], np.uint64)
            more = [b.column(b.schema.get_field_index(c)) for c in further]
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("doc_id")), pa.array(fps.view(np.int64)), *more], names=["doc_id", "fp", *further])

    schema = ", ".join(["doc_id long", "fp long", *(f"{c} {t}" for c, t in zip(further, types, strict=True))])
    return bounded(docs).select("doc_id", "text", *further).mapInArrow(run, schema)


def position_sets(size: int) -> list[tuple[int, ...]]:
    """Sets of byte positions such that any LEAST_BYTES positions contain one of them."""
    if size == LEAST_BYTES:
        return list(combinations(range(8), size))
    # Turan's system for triples: positions in three groups; triples within a group, or two of one and one of the next
    group = [p % 3 for p in range(8)]
    sets = []
    for t in combinations(range(8), 3):
        g = sorted(group[p] for p in t)
        if g[0] == g[2] or (len(set(g)) == 2 and (next(x for x in g if g.count(x) == 1) - next(x for x in g if g.count(x) == 2)) % 3 == 1):
            sets.append(t)
    return sets


def masks(size: int) -> np.ndarray:
    return np.array([sum(0xFF << (8 * p) for p in s) for s in position_sets(size)], np.uint64)


def verified(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y) <= MOST_BITS


def free_positions(mask: np.uint64) -> list[int]:
    """Byte positions that a list's key doesn't fix."""
    return [p for p in range(8) if not int(mask) >> 8 * p & 0xFF]


def runs(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal values starts, and the runs' sizes."""
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.empty(0, np.int64)
    return starts, np.diff(np.concatenate([starts, [len(ordered)]]))


def pairs_within(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (lesser, greater) of every two equal values."""
    order = np.argsort(values, kind="stable")
    ordered = values[order]
    a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for step in range(1, len(ordered)):
        same = np.flatnonzero(ordered[step:] == ordered[:-step])
        if not len(same):
            break
        a.append(order[same])
        b.append(order[same + step])
    return np.concatenate(a), np.concatenate(b)


def short_lists(fps: np.ndarray, lists: np.ndarray, mask: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Links within short lists (numbers in `lists`): shared postings are tallied for each pair."""
    free = free_positions(mask)
    fixed = 8 - len(free)
    if fixed >= LEAST_BYTES:  # the key alone reaches the count
        a, b = pairs_within(lists)
    else:
        n = np.int64(len(fps))
        found = [pairs_within(lists << np.int64(8) | (fps >> np.uint64(8 * p) & np.uint64(0xFF)).astype(np.int64)) for p in free]
        pair, tally = np.unique(np.concatenate([x * n + y for x, y in found]), return_counts=True)
        pair = pair[fixed + tally >= LEAST_BYTES]
        a, b = pair // max(n, 1), pair % max(n, 1)
    hit = verified(fps[a], fps[b])
    return fps[a[hit]], fps[b[hit]]


class Postings:
    """Entries of one list by their bytes at the free positions."""

    def __init__(self, entries: np.ndarray, free: list[int]):
        self.entries, self.free = entries, free
        self.alive = np.ones(len(entries), bool)
        self.order, self.starts = [], []
        for p in free:
            byte = (entries >> np.uint64(8 * p) & np.uint64(0xFF)).astype(np.int64)
            self.order.append(np.argsort(byte, kind="stable"))
            self.starts.append(np.searchsorted(byte[self.order[-1]], np.arange(257)))

    def tally(self, fp: int) -> np.ndarray:
        """For each entry, how many positions it shares with fp."""
        met = [o[s[b] : s[b + 1]] for p, o, s in zip(self.free, self.order, self.starts, strict=True) for b in [fp >> 8 * p & 0xFF]]
        return np.bincount(np.concatenate(met), minlength=len(self.entries))


def search(entries: np.ndarray, mask: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what a long list connects; each entry is tallied against those not yet reached."""
    free = free_positions(mask)
    a, b, queue, first = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)], [], 0
    postings = Postings(entries, free)
    left = len(entries)
    while left or queue:
        if not left:
            break
        if not queue:
            while not postings.alive[first]:
                first += 1
            postings.alive[first] = False
            left -= 1
            queue.append(postings.entries[first])
        at = queue.pop()
        near = np.flatnonzero((8 - len(free) + postings.tally(int(at)) >= LEAST_BYTES) & postings.alive)
        near = near[verified(postings.entries[near], at)]
        if len(near):
            found = postings.entries[near]
            a.append(np.full(len(found), at))
            b.append(found)
            queue += list(found)
            postings.alive[near] = False
            left -= len(near)
            if 2 * left < len(postings.entries):
                postings, first = Postings(postings.entries[postings.alive], free), 0
    return np.concatenate(a), np.concatenate(b)


RECORD = np.dtype([("set", "u1"), ("fp", "<u8")])


def list_links(records: np.ndarray, set_masks: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray]]]:
    """Links within the lists of one bucket, and (set, entries) for pairs of blocks of lists too long to be searched here."""
    a, b, blocks = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)], []
    for s in np.unique(records["set"]):
        fps = records["fp"][records["set"] == s].astype(np.uint64)
        keys = fps & set_masks[s]
        order = np.argsort(keys, kind="stable")
        fps = fps[order]
        starts, sizes = runs(keys[order])
        for i in np.flatnonzero(sizes > LONG_LIST):
            own = fps[starts[i] : starts[i] + sizes[i]]
            if len(own) > block:
                parts = np.array_split(own, -(-len(own) // block))
                blocks += [(int(s), np.concatenate(two)) for two in combinations(parts, 2)]
            else:
                x, y = search(own, set_masks[s])
                a.append(x)
                b.append(y)
        short = np.repeat((sizes > 1) & (sizes <= LONG_LIST), sizes)
        x, y = short_lists(fps[short], np.repeat(np.arange(len(sizes)), sizes)[short], set_masks[s])
        a.append(x)
        b.append(y)
    return np.concatenate(a), np.concatenate(b), blocks


def stars(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    nodes, roots = local_roots(x.view(np.int64), y.view(np.int64))
    own = nodes != roots
    return nodes[own], roots[own]


def fingerprint_links(distinct: DataFrame, key_bytes: int = KEY_BYTES) -> DataFrame:
    """distinct(fp): edges (a, b) whose components are those of all links between fingerprints."""
    spark = distinct.sparkSession
    set_masks, buckets, block = masks(key_bytes), partitions(spark), BLOCK

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = b.column(0).to_numpy().view(np.uint64)
            if not len(fps):
                continue
            records = np.empty(len(fps) * len(set_masks), RECORD)
            records["set"] = np.repeat(np.arange(len(set_masks)), len(fps))
            records["fp"] = np.tile(fps, len(set_masks))
            key = mix64((records["fp"] & set_masks[records["set"]]) + records["set"].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            yield pack_by_bucket(records, (key % np.uint64(buckets)).astype(np.int64), buckets)

    names, types = ["a", "b", "set", "entries"], [pa.int64(), pa.int64(), pa.int32(), pa.binary()]

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, y, blocks = list_links(payloads(batches, RECORD), set_masks, block)
        if len(x):
            a, b = stars(x, y)
            yield batch_of(names, [a, b, [None] * len(a), [None] * len(a)], types)
        for s, entries in blocks:
            yield batch_of(names, [[None], [None], [s], [entries.tobytes()]], types)

    def block_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, entries in zip(column(batch, "set"), column(batch, "entries"), strict=True):
                a, b = stars(*search(np.frombuffer(entries, "<u8").astype(np.uint64), set_masks[s]))
                yield batch_of(["a", "b"], [a, b], [pa.int64()] * 2)

    found = written(exchange(distinct.mapInArrow(index, "bucket int, payload binary"), buckets).mapInArrow(links, "a long, b long, set int, entries binary"), "simhash-lists")
    long_lists = found.where("entries is not null").select("set", "entries").repartition(buckets).mapInArrow(block_links, "a long, b long")
    return found.where("entries is null").select("a", "b").unionByName(long_lists)


def components_of(fps: DataFrame) -> DataFrame:
    """fps(fp): (fp, component) for every different fp."""
    entries = fps.select("fp").distinct()
    found = connected_components(fingerprint_links(entries), "simhash-links")
    return entries.join(found, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("component", "fp").alias("component"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) per row of docs(doc_id, text); component_id is the smallest doc_id reachable over links.

    Null and empty texts have fingerprint zero and are linked with each other like any equal fingerprints. A null doc_id
    takes part but never names a component with other doc_ids in it. Rows with an equal doc_id are linked as their texts are;
    repeated rows give repeated results.
    """
    fps = written(fingerprints(documents(docs)), "simhash")
    least = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    grouped = written(least.join(components_of(fps), "fp"), "simhash-groups")
    named = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    named = grouped.select("fp", "component").join(named, "component").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of near duplicates: that of the smallest doc_id (null last), of rows with the same one by
    a hash of the text, then of all columns. Rows that are equal in all columns stay once. All columns stay."""
    text_hash, row_hash, own = (spare(docs, x) for x in ("kept_text_hash", "kept_row_hash", "own_row_hash"))
    maps = [f.name for f in docs.schema if "map<" in f.dataType.simpleString()]
    row = F.xxhash64(*(F.to_json(F.struct(F.col(f"`{c}`"))) if c in maps else F.col(f"`{c}`") for c in docs.columns))
    id_of, text_of = F.col("doc_id").cast("long"), F.col("text").cast("string")
    fps = written(fingerprints(docs.select(id_of.alias("doc_id"), text_of.alias("text"), F.xxhash64(text_of).alias("text_hash"), row.alias("row_hash")), "text_hash", "row_hash"), "simhash")
    first = F.min(F.struct(F.isnull("doc_id").alias("no_id"), F.col("doc_id").alias("id"), "text_hash", "row_hash")).alias("first")
    grouped = fps.groupBy("fp").agg(first).join(components_of(fps), "fp").groupBy("component").agg(F.min("first").alias("first"))
    keep = grouped.select(F.col("first.text_hash").alias(text_hash), F.col("first.row_hash").alias(row_hash))
    # both steps are dealt by the same two hashes: texts are shuffled once
    kept = docs.withColumn(own, row).join(keep, (F.xxhash64(text_of) == F.col(text_hash)) & (F.col(own) == F.col(row_hash))).dropDuplicates([text_hash, row_hash])
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`near_duplicates` of documents: a row per row. Null and empty texts have fingerprint zero; an empty table gives no row."""
    return near_duplicates(table(spark, sf_dir, "documents"))
