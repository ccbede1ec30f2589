"""SentencePiece encoding of merge-type vocabularies by a score-ordered agenda, and decoding.

A text's symbols are its characters; the agenda holds every pair of neighbours whose union is a piece, best score
first, leftmost on ties; merging a pair puts its new neighbours' pairs on the agenda. Pieces have the space sign only at
their start, so a run of space signs always begins a segment that merges by itself: each distinct segment is encoded
once per cache. Every newly encoded segment of a batch is checked against the sentencepiece library, whose ids count; how many
had to be corrected is told.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import batch_of, column, documents, kept_by_worker, table
from .wordcache import CACHE_BYTES, Cache, gathered

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: A space at an end or before another one, or a space sign.
ODD = re.compile(f"^ |  | $|{SPACE}")
SEGMENT = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


def fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a protocol-buffer message: varints as int, fixed 32 bits and lengths as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield key >> 3, data[at : at + size]
            at += size


class Vocabulary:
    """Pieces, scores and normalizer switches of a .model file whose normalization is the identity."""

    def __init__(self, path: str):
        self.score: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.bytes: list[int] = [-1] * 256
        self.unknown = 0
        self.dummy_prefix = True
        n = 0
        with open(path, "rb") as f:
            data = f.read()
        for number, value in fields(data):
            if number == 1:
                piece = dict(fields(value))
                text, kind = piece[1].decode("utf-8"), piece.get(3, NORMAL)
                if kind in (NORMAL, UNUSED):
                    self.ids[text] = n
                    self.score[text] = float(np.frombuffer(piece.get(2, bytes(4)), "<f4")[0])
                elif kind == BYTE:
                    self.bytes[int(text[3:5], 16)] = n
                elif kind == UNKNOWN:
                    self.unknown = n
                elif kind == USER:
                    raise ValueError("user-defined pieces are not supported")
                if kind == UNUSED:
                    raise ValueError("unused pieces are not supported")
                n += 1
            elif number == 2 and dict(fields(value)).get(3, 1) != 2:
                raise ValueError("not a merge-type vocabulary")
            elif number == 3:
                switches = dict(fields(value))
                self.dummy_prefix = bool(switches.get(3, 1))
                if switches.get(4, 1) or not switches.get(5, 1) or switches.get(2):
                    raise ValueError("only the identity normalization is supported")
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece has a space sign after its start")

    def merge(self, segment: str) -> list[str]:
        score = self.score
        if segment in score and len(segment) < 3:
            return [segment]
        symbols = list(segment)
        n = len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = []
        for i in range(n - 1):
            both = symbols[i] + symbols[i + 1]
            if both in score:
                agenda.append((-score[both], i, both))
        heapify(agenda)
        while agenda:
            _, i, both = heappop(agenda)
            left = symbols[i]
            if not left:
                continue
            j = after[i]
            # stale: the pair that stands here now is another one
            if j >= n or len(left) + len(symbols[j]) != len(both) or left + symbols[j] != both:
                continue
            symbols[i], symbols[j] = both, ""
            k = after[j]
            after[i] = k
            if k < n:
                before[k] = i
                pair = both + symbols[k]
                if pair in score:
                    heappush(agenda, (-score[pair], i, pair))
            h = before[i]
            if h >= 0:
                pair = symbols[h] + both
                if pair in score:
                    heappush(agenda, (-score[pair], h, pair))
        return [s for s in symbols if s]

    def encode(self, segment: str) -> list[int]:
        out: list[int] = []
        for s in self.merge(segment):
            i = self.ids.get(s)
            if i is not None:
                out.append(i)
            elif self.bytes[0] >= 0:
                out += [self.bytes[b] for b in s.encode("utf-8")]
            else:
                out.append(self.unknown)
        return out


class PieceEncoder:
    """Texts to ids, with the agenda; `limit`: bytes of each generation of the cache."""

    def __init__(self, path: str, limit: int = CACHE_BYTES):
        import sentencepiece

        self.vocabulary = Vocabulary(path)
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.begin, self.end = self.library.bos_id(), self.library.eos_id()
        self.cache = Cache(limit)
        self.corrected = 0

    def learn(self, segments: list[str]) -> list[bytes]:
        """ids of segments by the agenda, checked."""
        own = [self.vocabulary.encode(s) for s in segments]
        # the library puts a space sign before a text, so it's given the segment without its first one
        asked = [i for i, s in enumerate(segments) if len(s) > 1 and s[0] == SPACE]
        for i, ids in zip(asked, self.library.encode([segments[i][1:] for i in asked], num_threads=1), strict=True):
            if ids != own[i]:
                self.corrected += 1
                own[i] = ids
        return [array("I", ids).tobytes() for ids in own]

    def encode(self, texts: list[str]) -> list[bytes]:
        """ids with begin and end as little-endian uint32 bytes."""
        begin, end = (array("I", [i]).tobytes() for i in (self.begin, self.end))
        out = [b""] * len(texts)
        # with single spaces between visible characters, each part is a segment but for its space sign
        plain = [i for i, t in enumerate(texts) if t and not ODD.search(t)] if self.vocabulary.dummy_prefix else []
        for i, ids in zip(plain, gathered([texts[i] for i in plain], lambda words: self.cached([SPACE + w for w in words])) if plain else [], strict=True):
            out[i] = ids
        prefix = SPACE if self.vocabulary.dummy_prefix else ""
        for i in set(range(len(texts))).difference(plain):
            if texts[i]:
                out[i] = b"".join(self.cached(SEGMENT.findall(prefix + texts[i].replace(" ", SPACE))))
        return [begin + x + end for x in out]

    def cached(self, segments: list[str]) -> list[bytes]:
        return self.cache.values(segments, self.learn)

    def decode(self, ids: list[bytes]) -> list[str]:
        return [self.library.decode(np.frombuffer(x, "<u4").tolist()) for x in ids]


@kept_by_worker
def piece_encoder(path: str) -> PieceEncoder:
    """One for each worker process, kept from task to task."""
    return PieceEncoder(path)


NAMES = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_corrected"]
TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]


def piece_digests(docs: DataFrame, model_path: str) -> DataFrame:
    """Per row: number of ids, digest of the ids, digest of the decoded text. Null is the empty text: begin and end only.

    One narrow pass; nothing depends on doc_id, and repeated rows give repeated results. n_corrected, on the first row of a batch, is how many new
    segments of the batch the library gave other ids than the agenda: 0, unless the agenda is at fault.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = piece_encoder(model_path)
        for b in batches:
            keys, texts = column(b, "doc_id"), column(b, "text")
            before = encoder.corrected
            ids = encoder.encode([t or "" for t in texts])
            back = encoder.decode(ids)
            corrected = [encoder.corrected - before, *[0] * (len(ids) - 1)][: len(ids)]
            yield batch_of(NAMES, [keys, [len(x) // 4 for x in ids], [hashlib.sha256(x).hexdigest() for x in ids], [hashlib.sha256(t.encode("utf-8")).hexdigest() for t in back], corrected], TYPES)

    return documents(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_corrected long")


def piece_ids(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, ids array<int>) with begin and end ids, per row; null is the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = piece_encoder(model_path)
        for b in batches:
            ids = encoder.encode([t or "" for t in column(b, "text")])
            yield batch_of(["doc_id", "ids"], [column(b, "doc_id"), [np.frombuffer(x, "<u4").tolist() for x in ids]], [pa.int64(), pa.list_(pa.int32())])

    return documents(docs).mapInArrow(run, "doc_id long, ids array<int>")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`piece_digests` of documents: a row per row. Null is the empty text; an empty table gives no row."""
    import public_tokenizers

    return piece_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
