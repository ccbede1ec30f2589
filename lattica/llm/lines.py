"""Line dedup by a segment-partition edit join.

Each distinct line is split into MAX_EDITS + 1 segments; lines within MAX_EDITS edits share a segment at nearly the same
place. Segments are indexed by length, number and content; each line probes the index of every length it may match with
the substrings that multi-match-aware selection leaves. A segment that very many lines share is indexed together with a
further part of the line: what is left and right of it is cut into MAX_EDITS + 1 parts, of which one is free of edits
too. Lines that meet in the index form groups; within a group lines are linked breadth first by banded bit-parallel edit
distance, so what is already connected is not compared again. A line's class is the connected component of its links; of
a class only the first line in the corpus stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_of, bloom_filter, bounded, column, exchange, forget_kept, maybe_in, mix64, pack_by_bucket, partitions, payloads, spare, table, written
from .components import connected_components
from .rolling import Rolling

MAX_EDITS = 2
#: Shorter lines (code points) are compared for equality alone, as at two edits most of them would be alike.
MIN_CHARS = 16
#: A group beyond this size is compared in blocks, each pair of blocks apart.
BLOCK = 1024
#: Code points of lines that are hashed, or whose groups are compared, at once.
CHUNK = 1 << 20
BINS = 32
#: Pairs of lines that all groups at hand compare at once, or one line of each with its rest if that is more.
PAIRS = 1 << 14
#: Segments are counted by a hash of this many slots. Those in slots of more than HOT entries, and of more than HOT_LOAD times the
#: mean, are indexed with a further part. So no task gets more than HOT_LOAD / SLOTS of all entries by one segment alone.
SLOTS = 1 << 20
HOT = 1024
HOT_LOAD = 4


def segment_starts(length: np.ndarray, i: int, edits: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and size of segment i of lines of these lengths: sizes differ by one at most, the longer ones are last."""
    base = length // (edits + 1)
    longer = length - base * (edits + 1)
    return i * base + np.maximum(0, i - (edits + 1 - longer)), base + (i >= edits + 1 - longer)


def selections(length: np.ndarray, edits: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """What lines of these lengths look up: (line, start, size, tag of indexed length and segment)."""
    for _, _, *found in shifted_selections(length, edits):
        yield tuple(found)


def shifted_selections(length: np.ndarray, edits: int) -> Iterator[tuple]:
    """`selections`, each with how much shorter the indexed line is and how far the segment has moved."""
    rows = np.arange(len(length))
    for shorter in range(edits + 1):
        other = length - shorter
        for i in range(edits + 1):
            start, size = segment_starts(other, i, edits)
            low = np.maximum(start - i, start + shorter - (edits - i))
            high = np.minimum(start + i, start + shorter + (edits - i))
            for shift in range(-edits, edits + shorter + 1):
                at = start + shift
                ok = (at >= np.maximum(low, 0)) & (at <= np.minimum(high, length - size)) & (other > edits)
                yield shorter, shift, rows[ok], at[ok], size[ok], other[ok] * (edits + 1) + i


def index_entries(length: np.ndarray, edits: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    rows = np.arange(len(length))
    for i in range(edits + 1):
        start, size = segment_starts(length, i, edits)
        yield rows, start, size, length * (edits + 1) + i


def parts_beside(length: np.ndarray, i: int, edits: int) -> Iterator[tuple[bool, np.ndarray, np.ndarray]]:
    """What segment i leaves of lines of these lengths, cut into edits + 1 parts: (is it left of the segment, start, size)."""
    start, size = segment_starts(length, i, edits)
    right = length - start - size
    n_left = 0 if i == 0 else edits + 1 if i == edits else i
    for k in range(n_left):
        low = start * k // n_left
        yield True, low, start * (k + 1) // n_left - low
    n_right = edits + 1 - n_left
    for k in range(n_right):
        low = right * k // n_right
        yield False, start + size + low, right * (k + 1) // n_right - low


def moves(left: bool, shift: int, shorter: int, edits: int) -> Iterator[int]:
    """How far a part free of edits may have moved, if its segment has moved by `shift` and the line has grown by `shorter`."""
    for d in range(-edits, edits + 1):
        if (abs(d) + abs(shift - d) + abs(shorter - shift) if left else abs(shift) + abs(d - shift) + abs(shorter - d)) <= edits:
            yield d


def code_points(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points in a row, and the lengths."""
    return np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), "<u4"), np.fromiter(map(len, lines), np.int64, len(lines))


def within(a: np.ndarray, b: np.ndarray, points: np.ndarray, begin: np.ndarray, length: np.ndarray, edits: int) -> np.ndarray:
    """Which pairs of lines (numbers into begin and length) are within `edits` edits of each other.

    Hyyro's banded bit-parallel algorithm, over all pairs at once: the band's 2 * edits + 1 diagonals are the upper bits of
    a word, which slide along the diagonal with each character of the longer line.
    """
    swap = length[a] > length[b]
    a, b = np.where(swap, b, a), np.where(swap, a, b)
    m, n = length[a], length[b]
    out = n - m <= edits
    live = np.flatnonzero(out)
    if not len(live):
        return out
    live = live[np.argsort(n[live], kind="stable")]
    a, b, m, n = a[live], b[live], m[live], n[live]
    width = 64
    top = np.uint64(1 << (width - 1))
    one = np.uint64(1)
    vp = np.full(len(live), ((1 << (edits + 1)) - 1) << (width - edits - 1), np.uint64)
    vn = np.zeros(len(live), np.uint64)
    dist = np.full(len(live), edits, np.int64)
    sideways = np.full(len(live), 1 << (width - 2), np.uint64)
    far = edits + n - (m - edits)
    hit = np.zeros(len(live), bool)
    at = np.arange(len(live))
    last = len(points) - 1
    for i in range(int(n.max())):
        # lines that ended, or that can't come back, leave
        if (over := (n[at] <= i) | (dist > far[at])).any():
            done = at[over]
            hit[done] = (n[done] <= i) & (dist[over] <= edits)
            stay = ~over
            at, vp, vn, dist, sideways = at[stay], vp[stay], vn[stay], dist[stay], sideways[stay]
            if not len(at):
                break
        x = np.zeros(len(at), np.uint64)
        c = points[begin[b[at]] + i]
        for r in range(-edits, edits + 1):
            p = i + r
            if p >= 0:
                same = (p < m[at]) & (points[np.minimum(begin[a[at]] + p, last)] == c)
                x |= same.astype(np.uint64) << np.uint64(width - 1 - edits + r)
        d0 = (((x & vp) + vp) ^ vp) | x | vn
        hp = vn | ~(d0 | vp)
        hn = d0 & vp
        diagonal = i < m[at] - edits
        right = (hp & sideways) != 0
        left = (hn & sideways) != 0
        dist = dist + np.where(diagonal, (d0 & top) == 0, right.astype(np.int64) - left)
        sideways = np.where(diagonal, sideways, sideways >> one)
        d0 >>= one
        vp, vn = hn | ~(d0 | hp), d0 & hp
    hit[at] = dist <= edits
    result = np.zeros(len(out), bool)
    result[live] = hit
    return result


RECORD = np.dtype([("key", "<u8"), ("line", "<i8"), ("probe", "u1")])


def meetings(records: np.ndarray, block: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(groups, lines) for the lines that meet in the index. A group's name is a hash of its lines, so that the same lines
    that meet again form no further group; a large group is named for each pair of its blocks, one block at a time."""
    records = records[np.lexsort((records["line"], records["key"]))]
    key, line = records["key"], records["line"]
    if not len(key):
        return
    new_key = np.concatenate([[True], key[1:] != key[:-1]])
    begins = np.flatnonzero(new_key)
    new_line = new_key | np.concatenate([[True], line[1:] != line[:-1]])
    lines = np.add.reduceat(new_line.astype(np.int64), begins)
    both = (np.minimum.reduceat(records["probe"], begins) == 0) & (np.maximum.reduceat(records["probe"], begins) == 1)
    sizes = np.diff(np.concatenate([begins, [len(key)]]))
    good = np.repeat((lines > 1) & both, sizes) & new_line
    members, run = line[good], np.repeat(np.arange(len(begins)), sizes)[good]
    if not len(members):
        return
    starts = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
    count = np.diff(np.concatenate([starts, [len(run)]]))
    name = np.add.reduceat(mix64(members.view(np.uint64)), starts)
    small = np.repeat(count <= block, count)
    yield np.repeat(name, count)[small].view(np.int64), members[small]
    for k in np.flatnonzero(count > block):
        own = members[starts[k] : starts[k] + count[k]]
        blocks = -(-len(own) // block)
        mine = (mix64(own.view(np.uint64)) % np.uint64(blocks)).astype(np.int64)
        for j in range(blocks):
            low, high = np.minimum(mine, j), np.maximum(mine, j)
            yield mix64(name[k] ^ mix64((low * blocks + high + 1).astype(np.uint64))).view(np.int64), own


def group_links(sizes: np.ndarray, lines: list[str], edits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (numbers of lines) that connect what is connected within each group; groups stand one after another."""
    points, length = code_points(lines)
    begin = np.cumsum(length) - length
    owner = np.repeat(np.arange(len(lines)), length)
    bags = np.bincount(owner * BINS + (points & (BINS - 1)), minlength=len(lines) * BINS).reshape(-1, BINS).astype(np.int32)
    ends = np.cumsum(sizes)
    waiting = [np.arange(e - s, e) for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
    queues: list[list[int]] = [[] for _ in waiting]
    active = [g for g, w in enumerate(waiting) if len(w) > 1]
    links_a, links_b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    while active:
        # while many groups are left, each compares one line with its rest; the last ones compare several at once
        most = PAIRS // len(active)
        steps, pairs_a, pairs_b, n = [], [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0
        for g in active:
            rest, reached = waiting[g], bool(queues[g])
            heads = max(1, min(len(queues[g]) if reached else len(rest) - 1, most // len(rest)))
            if reached:
                own = np.array(queues[g][-heads:])
                del queues[g][-heads:]
            else:
                own, rest = rest[:heads], rest[heads:]
                # none is known to be connected, so they are compared with each other too
                if heads > 1:
                    x, y = np.triu_indices(heads, 1)
                    pairs_a.append(own[x])
                    pairs_b.append(own[y])
                    n += len(x)
            pairs_a.append(np.repeat(own, len(rest)))
            pairs_b.append(np.tile(rest, heads))
            steps.append((g, n, heads, rest, reached))
            n += heads * len(rest)
        a, b = np.concatenate(pairs_a), np.concatenate(pairs_b)
        # each edit changes a length by one at most, and a bag of characters by two
        near = np.abs(length[a] - length[b]) <= edits
        near[near] = np.abs(bags[a[near]] - bags[b[near]]).sum(axis=1) <= 2 * edits
        near[near] = within(a[near], b[near], points, begin, length, edits)
        for g, start, heads, rest, reached in steps:
            hits = near[start : start + heads * len(rest)].reshape(heads, len(rest))
            hit = hits.any(axis=0)
            if reached and heads > 1:  # the heads are connected: one link to each line will do
                first = hits.argmax(axis=0)
                hits[:] = False
                hits[first[hit], np.flatnonzero(hit)] = True
            queues[g] += rest[hit].tolist()
            waiting[g] = rest[~hit]
        links_a.append(a[near])
        links_b.append(b[near])
        active = [g for g in active if len(waiting[g]) > (0 if queues[g] else 1)]
    return np.concatenate(links_a), np.concatenate(links_b)


def spans(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Slices of about CHUNK code points."""
    start = held = 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= CHUNK:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


class Segments:
    """Keys of the segments of some lines, on both sides of the index."""

    def __init__(self, texts: list[str], edits: int):
        points, self.length = code_points(texts)
        self.begin, self.edits = np.cumsum(self.length) - self.length, edits
        self.rolling = Rolling(mix64(points.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)))

    def keys(self, rows: np.ndarray, start: np.ndarray, size: np.ndarray, tag: np.ndarray) -> np.ndarray:
        return mix64(self.rolling.windows(self.begin[rows] + start, size) ^ mix64(tag.astype(np.uint64)))

    def indexed(self) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """(shorter, shift, line, tag, key) of a line's own segments."""
        for rows, start, size, tag in index_entries(self.length, self.edits):
            yield 0, 0, rows, tag, self.keys(rows, start, size, tag)

    def probed(self) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        for shorter, shift, rows, start, size, tag in shifted_selections(self.length, self.edits):
            yield shorter, shift, rows, tag, self.keys(rows, start, size, tag)

    def refined(self, probe: bool, shorter: int, shift: int, rows: np.ndarray, tag: np.ndarray, key: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(line, key) with a further part, for entries of one segment number."""
        if not len(rows):
            return
        other, i = tag // (self.edits + 1), int(tag[0] % (self.edits + 1))
        for part, (left, start, size) in enumerate(parts_beside(other, i, self.edits), 1):
            for move in moves(left, shift, shorter, self.edits) if probe else [0]:
                at = start + move
                ok = (at >= 0) & (at + size <= self.length[rows])
                content = self.rolling.windows(self.begin[rows[ok]] + at[ok], size[ok])
                yield rows[ok], mix64(key[ok] + mix64(content ^ mix64(np.full(len(content), part, np.uint64))))


def slot_of(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(40)).astype(np.int64) & (SLOTS - 1)


def hot_slots(lines: DataFrame, edits: int, hot: int) -> np.ndarray:
    """Which slots hold segments that very many lines may share (SLOTS booleans). Tasks' counts are summed in parts; the driver gets their bits."""
    parts, schema = 16, "bucket int, payload binary"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_kept()
        counts = np.zeros(SLOTS, np.int64)
        for b in batches:
            texts = column(b, "line")
            for s, e in spans(texts):
                for *_, keys in Segments(texts[s:e], edits).indexed():
                    np.add.at(counts, slot_of(keys), 1)
        if counts.any():
            yield batch_of(["bucket", "payload"], [list(range(parts)), [p.tobytes() for p in counts.astype("<u4").reshape(parts, -1)]], [pa.int32(), pa.binary()])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for part, payload in zip(column(b, "bucket"), column(b, "payload"), strict=True):
                counts = np.frombuffer(payload, "<u4").astype(np.int64)
                sums[part] = sums[part] + counts if part in sums else counts
        for part, counts in sums.items():
            # the parts are slots dealt by a hash, so that each has the mean of all
            bits = np.packbits(counts > max(hot, HOT_LOAD * counts.mean()))
            yield batch_of(["bucket", "payload"], [[part], [bits.tobytes()]], [pa.int32(), pa.binary()])

    out = np.zeros((parts, SLOTS // parts), bool)
    for r in exchange(lines.select("line").mapInArrow(count, schema), parts).mapInArrow(total, schema).collect():
        out[r.bucket] = np.unpackbits(np.frombuffer(r.payload, np.uint8))
    return out.reshape(-1)


def edit_links(lines: DataFrame, edits: int = MAX_EDITS, hot: int = HOT) -> DataFrame:
    """lines(line_id long, line string), distinct lines longer than `edits`: edges (a, b) between lines within `edits` edits
    whose components are those of all such pairs. `hot` decides how segments are indexed, never what is found."""
    buckets = partitions(lines.sparkSession)
    crowded = lines.sparkSession.sparkContext.broadcast(np.packbits(hot_slots(lines, edits, hot)))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = np.unpackbits(crowded.value).astype(bool)
        some = slots.any()
        for b in batches:
            all_texts, all_ids = column(b, "line"), b.column(b.schema.get_field_index("line_id")).to_numpy()
            for s, e in spans(all_texts):
                yield entries(all_ids[s:e], all_texts[s:e], slots if some else None)

    def entries(ids: np.ndarray, texts: list[str], slots: np.ndarray | None) -> pa.RecordBatch:
        segments, parts = Segments(texts, edits), []

        def add(rows: np.ndarray, keys: np.ndarray, probe: int) -> None:
            part = np.empty(len(rows), RECORD)
            part["key"], part["line"], part["probe"] = keys, ids[rows], probe
            parts.append(part)

        for probe, found in ((0, segments.indexed()), (1, segments.probed())):
            for shorter, shift, rows, tag, keys in found:
                if slots is not None:
                    full = slots[slot_of(keys)]
                    for r, k in segments.refined(bool(probe), shorter, shift, rows[full], tag[full], keys[full]):
                        add(r, k, probe)
                    rows, keys = rows[~full], keys[~full]
                add(rows, keys, probe)
        records = np.concatenate(parts)
        return pack_by_bucket(records, (records["key"] % np.uint64(buckets)).astype(np.int64), buckets)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for groups, members in meetings(payloads(batches, RECORD)):
            for i in range(0, len(groups), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(groups[i : i + (1 << 16)]), pa.array(members[i : i + (1 << 16)])], names=["group", "line_id"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[int] = []
        ids: list[int] = []
        texts: list[str] = []
        held = 0

        def links(n: int) -> pa.RecordBatch | None:
            marks = np.array(group[:n], np.int64)
            starts = np.flatnonzero(np.concatenate([[True], marks[1:] != marks[:-1]]))
            a, b = group_links(np.diff(np.concatenate([starts, [n]])), texts[:n], edits)
            names = np.array(ids[:n], np.int64)
            del group[:n], ids[:n], texts[:n]
            return pa.RecordBatch.from_arrays([pa.array(names[a]), pa.array(names[b])], names=["a", "b"]) if len(a) else None

        for b in batches:
            for g, i, t in zip(column(b, "group"), column(b, "line_id"), column(b, "line"), strict=True):
                if held >= CHUNK and group[-1] != g:
                    if (out := links(len(group))) is not None:
                        yield out
                    held = 0
                group.append(g)
                ids.append(i)
                texts.append(t)
                held += len(t)
        if group and (out := links(len(group))) is not None:
            yield out

    found = exchange(lines.select("line_id", "line").mapInArrow(index, "bucket int, payload binary"), buckets).mapInArrow(meet, "group long, line_id long")
    found = written(found.distinct(), "line-groups")
    # few lines meet others: the rest needn't be shuffled to learn that
    some = maybe_in(lines.select("line_id", "line"), "line_id", bloom_filter(found.select("line_id")))
    groups = found.join(some, "line_id").select("group", "line_id", "line")
    return groups.repartition(buckets, "group").sortWithinPartitions("group", "line_id").mapInArrow(compare, "a long, b long")


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, text): rows are told apart by both, as a doc_id may be null or stand in several rows."""
    return bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"), F.col("text").cast("string").alias("text"))


def occurrences(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, pos, line, h1, h2) for every line with something but blanks in it."""
    split = docs.select("doc_id", "text_hash", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).where(F.col("line").rlike(r"[^\x20\x09-\x0D]"))
    return split.withColumn("h1", F.xxhash64("line")).withColumn("h2", F.xxhash64(F.lit("second"), "line"))


def duplicate_lines(docs: DataFrame, edits: int = MAX_EDITS, least: int = MIN_CHARS) -> DataFrame:
    """(doc_id, text_hash, pos, first_doc_id, first_pos) for every line of a class that an earlier line began.

    docs as `keyed` gives them. Lines of `least` code points and more are of a class if a chain of lines within `edits` edits
    connects them, shorter ones if they are equal. Earlier means a smaller doc_id (null last), then a smaller text_hash,
    then a smaller line number. Rows with equal doc_id and text are one document's.
    """
    every = occurrences(docs)
    distinct = every.groupBy("line", "h1", "h2").agg(F.count(F.lit(1)).alias("n"))
    lines = written(distinct.withColumn("line_id", F.monotonically_increasing_id()), "lines")
    components = connected_components(edit_links(lines.where(F.length("line") >= least), edits), "line-links")
    classed = lines.drop("line").join(components.withColumnRenamed("node", "line_id"), "line_id", "left").where("component is not null or n > 1")
    classed = classed.select("h1", "h2", F.coalesce("component", "line_id").alias("class"))
    found = written(every.select("doc_id", "text_hash", "pos", "h1", "h2").join(classed, ["h1", "h2"]).drop("h1", "h2"), "line-classes")
    # dealt anew, so that the join may split a class that very many lines belong to
    place = F.struct(F.isnull("doc_id"), "doc_id", "text_hash", "pos")
    origins = found.groupBy("class").agg(F.min(place).alias("first")).repartition(partitions(docs.sparkSession))
    known = found.join(origins, "class").where(~F.col("doc_id").eqNullSafe(F.col("first.doc_id")) | (F.col("text_hash") != F.col("first.text_hash")) | (F.col("pos") != F.col("first.pos")))
    return known.select("doc_id", "text_hash", "pos", F.col("first.doc_id").alias("first_doc_id"), F.col("first.pos").alias("first_pos"))


def by_document(duplicates: DataFrame) -> DataFrame:
    """(id, hash, found): the duplicates of each document, in order. No list is longer than the document has lines."""
    found = F.array_sort(F.collect_set(F.struct(F.col("pos").alias("line"), "first_doc_id", F.col("first_pos").alias("first_line"))))
    return duplicates.groupBy(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")).agg(found.alias("found"))


def line_report(docs: DataFrame, edits: int = MAX_EDITS, least: int = MIN_CHARS) -> DataFrame:
    """One row per row of docs(doc_id, text): n_lines, n_duplicates, and duplicates (line numbers from 0, with the first line
    of their class), which are the lines that `drop_lines` drops.

    Null and empty texts have no lines; lines of blanks alone are never duplicates. Rows with an equal doc_id and different texts, or
    without a doc_id, are documents of their own; rows with equal doc_id and text are one document's, and each gets its list.
    """
    docs = keyed(docs)
    found = by_document(duplicate_lines(docs, edits, least))
    n_lines = F.when(F.length("text") > 0, F.size(F.split("text", "\n", -1))).otherwise(0).cast("long")
    joined = docs.select("doc_id", "text_hash", n_lines.alias("n_lines")).join(found, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash")), "left")
    listed = F.coalesce("found", F.array().cast("array<struct<line:int,first_doc_id:bigint,first_line:int>>"))
    return joined.select("doc_id", "n_lines", F.size(listed).cast("long").alias("n_duplicates"), listed.alias("duplicates"))


def drop_lines(docs: DataFrame, edits: int = MAX_EDITS, least: int = MIN_CHARS) -> DataFrame:
    """docs without the lines that `line_report` lists; n_chars, where there is one, follows. All rows and columns stay, and so do
    texts without duplicates, null and empty ones among them; a text whose lines are all duplicates becomes empty."""
    names = [spare(docs, x) for x in ("dropped_id", "dropped_hash", "dropped_lines")]
    key, hashed, drop = names
    drops = by_document(duplicate_lines(keyed(docs), edits, least)).select(F.col("id").alias(key), F.col("hash").alias(hashed), F.transform("found", lambda x: x["line"]).alias(drop))
    joined = docs.join(drops, F.col("doc_id").cast("long").eqNullSafe(F.col(key)) & (F.xxhash64(F.col("text").cast("string")) == F.col(hashed)), "left")
    left = F.array_join(F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains(drop, i)), "\n")
    changed = {"text": F.when(F.col(drop).isNull(), F.col("text")).otherwise(left)}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col(drop).isNull(), F.col("n_chars")).otherwise(F.length(left)).cast(docs.schema["n_chars"].dataType)
    return joined.withColumns(changed).select(*docs.columns)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`line_report` of documents: a row per row, duplicates of any length. Null and empty texts have none; an empty table gives no row."""
    return line_report(table(spark, sf_dir, "documents"))
