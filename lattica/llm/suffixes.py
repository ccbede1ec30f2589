"""Repeated passages by sparse suffix arrays.

Suffixes are kept only where the content selects them: each window of MIN_WORDS words selects the least hashed run of
RUN words in it, its minimiser, so equal passages keep the same suffixes wherever they stand. A kept suffix travels with the
words that its windows span. It meets the suffixes with the same first words in one task, where they are sorted by the
words that follow and, once more, by the words that precede; the common prefixes of neighbours tell how far matches extend to the
right and to the left. Words themselves are compared, not hashes of them. Windows met twice in one flush of a task are
settled there, and one of them stands for all in the exchange, so that a passage of very many documents is sent once a flush.
"""

from __future__ import annotations

import itertools
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import batch_of, bounded, column, exchange, mix64, partitions, table
from .rolling import Rolling

MIN_WORDS = 50
RUN = 16
#: Words of a flush, and words whose hashes a worker keeps.
FLUSH = 1 << 19
CACHE = 1 << 19
#: Bits of a window's print, which only proposes equal windows.
PRINT = np.uint64((1 << 64) - 1)
#: Suffixes that are sorted at once; those with the same first words stay together.
SLICE = 1 << 14

#: A kept suffix: hash of its first RUN words, its document, the place of its start, and the windows that selected it.
HEAD = np.dtype([("first", "<u8"), ("doc", "<i8"), ("text", "<i8"), ("at", "<i4"), ("start", "<i4"), ("n", "<i4")])
#: A found stretch of a document, in words, and another document that has it.
SPAN = np.dtype([("doc", "<i8"), ("text", "<i8"), ("start", "<i4"), ("end", "<i4"), ("other", "<i8")])
NULL_ID = -(1 << 63)


def numbered(texts: list[str], cache: dict[bytes, int]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """All words, their numbers (equal words, equal numbers), their hashes, and how many each text has."""
    split = [t.encode("utf-8").split() for t in texts]
    counts = np.fromiter(map(len, split), np.int64, len(split))
    words = [w for own in split for w in own]
    number: defaultdict[bytes, int] = defaultdict(itertools.count().__next__)
    ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    if len(cache) > CACHE:
        cache.clear()
    for w in number.keys() - cache.keys():
        cache[w] = xxhash.xxh64_intdigest(w)
    hashes = np.fromiter(map(cache.__getitem__, number), np.uint64, len(number))
    return words, ids, hashes[ids] if len(ids) else np.empty(0, np.uint64), counts


def selections(hashes: np.ndarray, counts: np.ndarray, least: int, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For every window of `least` words within a text: its start, its print, the suffix it selects, that one's hash."""
    ends = np.cumsum(counts)
    inside = np.maximum(counts - least + 1, 0)
    firsts = np.repeat(ends - counts - np.concatenate([[0], np.cumsum(inside)[:-1]]), inside)
    starts = firsts + np.arange(len(firsts))
    if not len(starts):
        none = np.empty(0, np.int64)
        return none, np.empty(0, np.uint64), none, np.empty(0, np.uint64)
    rolling = Rolling(hashes)
    runs = mix64(rolling.windows(np.arange(len(hashes) - run + 1), run))
    width = least - run + 1
    views = np.lib.stride_tricks.sliding_window_view(runs, width)
    chosen = np.concatenate([starts[i : i + (1 << 16)] + views[starts[i : i + (1 << 16)]].argmin(axis=1) for i in range(0, len(starts), 1 << 16)])
    return starts, mix64(rolling.windows(starts, least)) & PRINT, chosen, runs[chosen]


def same_words(ids: np.ndarray, a: np.ndarray, b: np.ndarray, least: int) -> bool:
    """Whether every window at a has the words of the one at b. A window that the next pair continues needs its first word compared alone."""
    if not len(a):
        return True
    match = np.full(len(ids) + 1, -1, np.int64)
    match[a] = b
    if (ids[a] != ids[b]).any():
        return False
    last = match[a + 1] != b + 1
    a, b = a[last], b[last]
    steps = np.arange(least)
    return all((ids[a[i : i + 4096, None] + steps] == ids[b[i : i + 4096, None] + steps]).all() for i in range(0, len(a), 4096))


def window_ranks(ids: np.ndarray, starts: np.ndarray, least: int) -> np.ndarray:
    """Numbers that are equal for windows of equal words, by doubling the length of the ranked prefixes."""
    rank, length = np.unique(ids, return_inverse=True)[1], 1
    while 2 * length <= least:
        rank = np.unique(rank[:-length] * np.int64(len(ids) + 1) + rank[length:], return_inverse=True)[1]
        length *= 2
    return rank[starts] * np.int64(len(ids) + 1) + rank[starts + least - length]


def equal_runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order that sorts keys, where each run of equal ones starts in it, and the runs' sizes."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    begins = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(keys) else np.empty(0, np.int64)
    return order, begins, np.diff(np.concatenate([begins, [len(keys)]]))


def others(docs: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For rows in runs: the least document of the row's run, or for that one's own rows the greatest."""
    low, high = np.minimum.reduceat(docs, begins), np.maximum.reduceat(docs, begins)
    low, high = np.repeat(low, sizes), np.repeat(high, sizes)
    return np.where(docs == low, high, low)


def stretches(doc: np.ndarray, text: np.ndarray, start: np.ndarray, other: np.ndarray, least: int) -> np.ndarray:
    """Found windows as SPANs, windows that follow one another in one."""
    order = np.lexsort((start, text, doc))
    doc, text, start, other = doc[order], text[order], start[order], other[order]
    if not len(doc):
        return np.empty(0, SPAN)
    begins = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (text[1:] != text[:-1]) | (start[1:] > start[:-1] + 1)]))
    out = np.empty(len(begins), SPAN)
    out["doc"], out["text"], out["start"] = doc[begins], text[begins], start[begins]
    out["end"] = start[np.concatenate([begins[1:] - 1, [len(doc) - 1]])] + least
    out["other"] = np.minimum.reduceat(other, begins)
    return out


PACKED = "bucket int, heads binary, words binary, spans binary"


def repeated_passages(docs: DataFrame, least: int = MIN_WORDS, run: int = RUN) -> DataFrame:
    """(doc_id, start_word, end_word, n_words, with_doc_id): every longest stretch of a text whose windows of `least` words
    all stand elsewhere too, in another document or in another place of the same one (then with_doc_id may be its own).

    Words are runs between ASCII blanks; start is counted from 0, end is exclusive. Texts that are null, empty or shorter
    than `least` words have none. Rows with an equal doc_id and different texts, or without a doc_id, are documents of their own; a repeated row
    makes its whole text a repeat, listed once. with_doc_id is one document that has part of the passage, null for one without doc_id.
    """
    # words travel, so a bucket is smaller than elsewhere
    buckets, flush_at = 2 * partitions(docs.sparkSession), FLUSH
    keyed = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"), F.col("text").cast("string").alias("text"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[bytes, int] = {}
        ids: list[int | None] = []
        hashes: list[int] = []
        texts: list[str] = []
        held = 0
        for b in batches:
            for i, h, t in zip(column(b, "doc_id"), column(b, "text_hash"), column(b, "text"), strict=True):
                if not t:
                    continue
                ids.append(i)
                hashes.append(h)
                texts.append(t)
                held += len(t)
                if held >= 6 * flush_at:  # about as many words
                    yield flush(ids, hashes, texts, cache)
                    ids, hashes, texts, held = [], [], [], 0
        if ids:
            yield flush(ids, hashes, texts, cache)

    def flush(ids: list[int | None], text_hashes: list[int], texts: list[str], cache: dict[bytes, int]) -> pa.RecordBatch:
        words, number, hashes, counts = numbered(texts, cache)
        starts, prints, chosen, first = selections(hashes, counts, least, run)
        ends = np.cumsum(counts)
        row = np.searchsorted(ends, starts, side="right")
        doc = np.array([NULL_ID if i is None else i for i in ids], np.int64)[row]
        text = np.array(text_hashes, np.int64)[row]
        begin = (ends - counts)[row]
        # settled here: windows that this flush holds twice; the first of them goes on for all
        order, begins, sizes = equal_runs(prints)
        later = np.ones(len(order), bool)
        later[begins] = False
        if not same_words(number, starts[order[later]], starts[np.repeat(order[begins], sizes)[later]], least):
            order, begins, sizes = equal_runs(window_ranks(number, starts, least))
        again = order[np.repeat(sizes > 1, sizes)]
        found = stretches(doc[again], text[again], (starts - begin)[again], others(doc[again], *_compact(sizes)), least) if len(again) else np.empty(0, SPAN)
        stay = np.sort(order[begins])
        starts, chosen, first, doc, text, begin = (x[stay] for x in (starts, chosen, first, doc, text, begin))
        new = np.flatnonzero(np.concatenate([[True], (chosen[1:] != chosen[:-1]) | (starts[1:] != starts[:-1] + 1)])) if len(starts) else np.empty(0, np.int64)
        heads = np.empty(len(new), HEAD)
        heads["first"], heads["doc"], heads["text"], heads["at"], heads["start"] = first[new], doc[new], text[new], (chosen - begin)[new], (starts - begin)[new]
        heads["n"] = n = np.diff(np.concatenate([new, [len(starts)]]))
        # the words of a suffix's windows, as bytes of all words with a space after each
        joined = b" ".join(words)
        upto = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        low = starts[new]
        left, right = (upto[low] - np.fromiter((len(words[i]) + 1 for i in low.tolist()), np.int64, len(low))).tolist(), (upto[low + n - 1 + least - 1] - 1).tolist()
        bucket = (heads["first"] % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
        home = (mix64((found["doc"] ^ found["text"]).view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        found = found[np.argsort(home, kind="stable")]
        marks = np.searchsorted(np.sort(home), np.arange(buckets + 1))
        used = [k for k in range(buckets) if cuts[k] < cuts[k + 1] or marks[k] < marks[k + 1]]
        press = zstandard.ZstdCompressor(level=1).compress
        payload = [press(b"\n".join([joined[left[i] : right[i]] for i in order[cuts[k] : cuts[k + 1]].tolist()])) for k in used]
        return batch_of(
            ["bucket", "heads", "words", "spans"],
            [used, [heads[order[cuts[k] : cuts[k + 1]]].tobytes() for k in used], payload, [found[marks[k] : marks[k + 1]].tobytes() for k in used]],
            [pa.int32(), pa.binary(), pa.binary(), pa.binary()],
        )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads, packed = [], []
        for b in batches:
            heads += [np.frombuffer(x, HEAD) for x in column(b, "heads")]
            packed += column(b, "words")
            if len(spans := np.concatenate([np.empty(0, SPAN), *(np.frombuffer(x, SPAN) for x in column(b, "spans"))])):
                yield as_batch(spans)
        for some, words in met(heads, packed):
            if len(spans := neighbours(some, words, least, run)):
                yield as_batch(spans)

    spans = exchange(keyed.mapInArrow(keep, PACKED), buckets).mapInArrow(compare, "doc_id long, text_hash long, start_word int, end_word int, with_doc_id long")
    own = W.partitionBy("doc_id", "text_hash").orderBy("start_word", "end_word")
    before = F.max("end_word").over(own.rowsBetween(W.unboundedPreceding, -1))
    # stretches that share or meet at windows are one: the next starts no later than one window after the last one's start
    island = F.sum(F.when(F.col("start_word") <= F.col("reach") - least + 1, 0).otherwise(1)).over(own.rowsBetween(W.unboundedPreceding, 0))
    whole = spans.withColumn("reach", before).withColumn("island", island).groupBy("doc_id", "text_hash", "island").agg(F.min("start_word").alias("start_word"), F.max("end_word").alias("end_word"), F.min("with_doc_id").alias("with_doc_id"))
    return whole.select("doc_id", F.col("start_word").cast("long").alias("start_word"), F.col("end_word").cast("long").alias("end_word"), (F.col("end_word") - F.col("start_word")).cast("long").alias("n_words"), "with_doc_id")


def _compact(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of the runs of over one, once the others are gone."""
    sizes = sizes[sizes > 1]
    return np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64), sizes


def met(heads: list[np.ndarray], packed: list[bytes]) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """Suffixes that share their first words' hash with others, and their words, some at a time."""
    every = np.concatenate([np.empty(0, HEAD), *heads])
    order, _, sizes = equal_runs(every["first"])
    some = order[np.repeat(sizes > 1, sizes)]
    if not len(some):
        return
    wanted = np.zeros(len(every), bool)
    wanted[some] = True
    words: dict[int, bytes] = {}
    inflate, at = zstandard.ZstdDecompressor().decompress, 0
    for own, data in zip(heads, packed, strict=True):
        if len(hits := np.flatnonzero(wanted[at : at + len(own)])):
            lines = inflate(data).split(b"\n")
            words.update((at + i, lines[i]) for i in hits.tolist())
        at += len(own)
    sizes = sizes[sizes > 1]
    starts = np.cumsum(sizes) - sizes
    cut = np.flatnonzero(np.diff(starts // SLICE, prepend=-1))  # slices begin with a run
    for s, e in zip(starts[cut].tolist(), [*starts[cut][1:].tolist(), len(some)], strict=True):
        yield every[some[s:e]], [words[i] for i in some[s:e].tolist()]


def sorted_prefixes(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order that sorts the rows, and how long a prefix each shares with the one before it (0 for the first)."""
    order = np.argsort(np.ascontiguousarray(rows.astype(">u4")).view(np.dtype((np.void, 4 * rows.shape[1]))).ravel(), kind="stable")
    differ = rows[order[1:]] != rows[order[:-1]]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return order, np.concatenate([[0], common])


def neighbours(heads: np.ndarray, words: list[bytes], least: int, run: int) -> np.ndarray:
    """SPANs of the windows that stand at several of these suffixes.

    A window that begins l words before its suffix stands at another one if the two share least - l words to the right and l to
    the left: if they are in one interval of either sorted order whose neighbours share as many.
    """
    number: defaultdict[bytes, int] = defaultdict(itertools.count(1).__next__)
    numbers, ends = array("I"), []
    for w in words:
        numbers.extend(map(number.__getitem__, w.split(b" ")))
        ends.append(len(numbers))
    flat, sizes = np.frombuffer(numbers, np.uint32), np.diff(np.array(ends, np.int64), prepend=0)
    lefts = (heads["at"] - heads["start"]).astype(np.int64)
    pivot = np.cumsum(sizes) - sizes + lefts
    padded = np.concatenate([flat, np.zeros(1, np.uint32)])

    def side(width: int, sign: int, there: np.ndarray) -> np.ndarray:
        steps = np.arange(width)
        at = pivot[:, None] + steps if sign > 0 else pivot[:, None] - 1 - steps
        return padded[np.where(steps < there[:, None], at, len(flat))]

    right_order, right = sorted_prefixes(side(least, 1, sizes - lefts))
    left_order, left = sorted_prefixes(side(max(least - run, 1), -1, lefts))
    docs, texts, starts, theirs = ([np.empty(0, np.int64)] for _ in range(4))
    interval, mirrored = np.empty(len(heads), np.int64), np.empty(len(heads), np.int64)
    for ahead in range(least - run + 1):
        start = heads["at"] - ahead
        chosen = np.flatnonzero((start >= heads["start"]) & (start < heads["start"] + heads["n"]))
        if len(chosen) < 2:
            continue
        interval[right_order] = np.cumsum(right < least - ahead)
        mirrored[left_order] = np.cumsum(left < ahead)
        order, _, runs = equal_runs(interval[chosen] * np.int64(len(heads) + 1) + mirrored[chosen])
        again = chosen[order[np.repeat(runs > 1, runs)]]
        if len(again):
            docs.append(heads["doc"][again])
            texts.append(heads["text"][again])
            starts.append(start[again].astype(np.int64))
            theirs.append(others(heads["doc"][again], *_compact(runs)))
    return stretches(*(np.concatenate(x) for x in (docs, texts, starts, theirs)), least)


def as_batch(spans: np.ndarray) -> pa.RecordBatch:
    def ids(x: np.ndarray) -> pa.Array:
        return pa.array(np.ascontiguousarray(x), mask=x == NULL_ID)

    return pa.RecordBatch.from_arrays([ids(spans["doc"]), pa.array(np.ascontiguousarray(spans["text"])), pa.array(np.ascontiguousarray(spans["start"])), pa.array(np.ascontiguousarray(spans["end"])), ids(spans["other"])], names=["doc_id", "text_hash", "start_word", "end_word", "with_doc_id"])


def op6_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`repeated_passages` of documents, of 50 words and more. Null, empty and short texts have no row; nor has an empty table."""
    return repeated_passages(table(spark, sf_dir, "documents"))
