"""Ogg columns: pages with checksums, packets from lacing values, logical streams, times from granule positions.

`mux` writes packets of several logical streams as interleaved pages; `demux` verifies each page's checksum, follows
page sequence numbers and continued packets, and gives each stream's packets with their end times. `probe` describes a
column of Ogg files. Damaged or foreign bytes raise `OggError`; the column operators turn that into an `error` value.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_of, column, documents, table

CAPTURE = b"OggS"
CONTINUED, FIRST, LAST = 1, 2, 4
HEADER = struct.Struct("<4sBBqIIIB")
#: No packet ends on the page.
NO_GRANULE = -1
MOST_SEGMENTS = 255
REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


class OggError(ValueError):
    pass


def checksum(page: bytes) -> int:
    """CRC-32 with polynomial 0x04C11DB7, most significant bit first, from 0, not inverted.

    zlib's CRC is the same one with bits mirrored and inverted, so it gives ours from mirrored bytes.
    """
    mirrored = zlib.crc32(page.translate(REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(REVERSED), "big")


@dataclass
class Stream:
    """packets: (bytes, granule position at the packet's end)."""

    serial: int
    packets: list[tuple[bytes, int]] = field(default_factory=list)
    pages: int = 0


def page(serial: int, sequence: int, flags: int, granule: int, lacing: bytes, body: bytes) -> bytes:
    head = HEADER.pack(CAPTURE, 0, flags, granule, serial, sequence, 0, len(lacing)) + lacing
    crc = checksum(head + body)
    return head[:22] + crc.to_bytes(4, "little") + head[26:] + body


def stream_pages(stream: Stream, segments: int = MOST_SEGMENTS) -> Iterator[tuple[int, bytes]]:
    """(granule, page) in order. The first packet has a page to itself; a packet may run over many pages."""
    sequence, flags = 0, FIRST
    lacing, body, granule, ends = bytearray(), bytearray(), NO_GRANULE, False
    reached = 0
    last = len(stream.packets) - 1
    for n, (packet, at) in enumerate(stream.packets):
        values = b"\xff" * (len(packet) // 255) + bytes([len(packet) % 255])
        offset = 0
        while values:
            take = values[: segments - len(lacing)]
            size = sum(take)
            lacing += take
            body += packet[offset : offset + size]
            offset += size
            values = values[len(take) :]
            if not values:
                granule, ends = at, True
                reached = at
            if len(lacing) == segments or (not values and (n == 0 or n == last)):
                over = not values and n == last
                yield reached, page(stream.serial, sequence, flags | (LAST if over else 0), granule if ends else NO_GRANULE, bytes(lacing), bytes(body))
                sequence += 1
                flags = CONTINUED if values else 0
                lacing, body, granule, ends = bytearray(), bytearray(), NO_GRANULE, False


def mux(streams: list[Stream], segments: int = MOST_SEGMENTS) -> bytes:
    """Pages of all streams: first pages first, then by time, then in the order of the streams."""
    pages = [(k > 0, at if k else 0, i, k, p) for i, s in enumerate(streams) for k, (at, p) in enumerate(stream_pages(s, segments))]
    return b"".join(p for *_, p in sorted(pages, key=lambda x: x[:4]))


def demux(data: bytes) -> dict[int, Stream]:
    """Streams by serial, in the order in which they begin. Packets that end within a page get times only at the page's
    end, so all but a page's last packet take NO_GRANULE, as the format has it."""
    streams: dict[int, Stream] = {}
    partial: dict[int, bytearray | None] = {}
    expected: dict[int, int] = {}
    over: set[int] = set()
    at = 0
    while at < len(data):
        if len(data) - at < HEADER.size:
            raise OggError(f"truncated header at {at}")
        capture, version, flags, granule, serial, sequence, crc, n = HEADER.unpack_from(data, at)
        if capture != CAPTURE or version != 0:
            raise OggError(f"no page at {at}")
        lacing = data[at + HEADER.size : at + HEADER.size + n]
        start = at + HEADER.size + n
        end = start + sum(lacing)
        if len(lacing) < n or end > len(data):
            raise OggError(f"truncated page at {at}")
        if checksum(data[at : at + 22] + bytes(4) + data[at + 26 : end]) != crc:
            raise OggError(f"checksum of page at {at}")
        if flags & FIRST:
            if serial in streams:
                raise OggError(f"stream {serial} begins twice")
            streams[serial], partial[serial], expected[serial] = Stream(serial), None, 0
        if serial not in streams or serial in over:
            raise OggError(f"page of no open stream {serial} at {at}")
        if sequence != expected[serial]:
            raise OggError(f"page {expected[serial]} of stream {serial} is missing")
        expected[serial] += 1
        streams[serial].pages += 1
        if bool(flags & CONTINUED) != (partial[serial] is not None):
            raise OggError(f"broken packet at {at}")
        open_packet, offset, ended = partial[serial], start, []
        for value in lacing:
            if open_packet is None:
                open_packet = bytearray()
            open_packet += data[offset : offset + value]
            offset += value
            if value < 255:
                ended.append(bytes(open_packet))
                open_packet = None
        partial[serial] = open_packet
        streams[serial].packets += [(p, granule if k == len(ended) - 1 else NO_GRANULE) for k, p in enumerate(ended)]
        if flags & LAST:
            over.add(serial)
        at = end
    if any(p is not None for p in partial.values()):
        raise OggError("a packet has no end")
    if len(over) < len(streams):
        raise OggError("a stream has no end")
    return streams


def times(stream: Stream, samples: list[int], rate: int) -> list[float]:
    """Seconds at which each packet ends, from granule positions where a page has one, else counted back from the next."""
    ends: list[int] = [0] * len(stream.packets)
    known: int | None = None
    for k in range(len(stream.packets) - 1, -1, -1):
        g = stream.packets[k][1]
        known = g if g != NO_GRANULE else (None if known is None else known - samples[k + 1])
        ends[k] = known if known is not None else 0
    return [e / rate for e in ends]


# --- 8-bit samples as Ogg --------------------------------------------------------------------------------------------
RATE = 8000
FRAME = 32
PACKET = 1024
IDENT = struct.Struct("<8sBBIHQ")
MAGIC = b"PCM8\x00\x00\x00\x01"


def store(payload: bytes, rate: int = RATE, channels: int = 2) -> bytes:
    """Samples as `channels` logical streams: frames of FRAME samples go to the streams in turn."""
    size = FRAME * channels
    if len(payload) % size:
        raise ValueError(f"payload must be a multiple of {size}")
    lanes = np.frombuffer(payload, np.uint8).reshape(-1, channels, FRAME).transpose(1, 0, 2)
    seed = zlib.crc32(payload)
    streams = []
    for c in range(channels):
        lane = lanes[c].tobytes()
        packets = [(IDENT.pack(MAGIC, c, channels, rate, FRAME, len(lane)), 0)]
        packets += [(lane[i : i + PACKET], min(i + PACKET, len(lane))) for i in range(0, len(lane), PACKET)]
        streams.append(Stream((seed + c) & 0xFFFFFFFF, packets))
    return mux(streams)


def restore(data: bytes) -> tuple[bytes, list[list[float]], int]:
    """Samples, the end times of each channel's packets, and the number of pages."""
    lanes: dict[int, bytes] = {}
    ends, rate = [], RATE
    channels = pages = 0
    for s in demux(data).values():
        pages += s.pages
        if not s.packets or len(s.packets[0][0]) != IDENT.size:
            raise OggError("not a stream of 8-bit samples")
        magic, c, channels, rate, frame, length = IDENT.unpack(s.packets[0][0])
        if magic != MAGIC or frame != FRAME or not rate or length % FRAME:
            raise OggError("not a stream of 8-bit samples")
        lanes[c] = b"".join(p for p, _ in s.packets[1:])
        if len(lanes[c]) != length:
            raise OggError("samples are missing")
        body = Stream(s.serial, s.packets[1:])
        ends.append(times(body, [len(p) for p, _ in body.packets], rate))
    if not lanes or sorted(lanes) != list(range(channels)) or len({*map(len, lanes.values())}) > 1:
        raise OggError("a channel is missing")
    arrays = np.stack([np.frombuffer(lanes[c], np.uint8).reshape(-1, FRAME) for c in range(channels)], axis=1)
    return arrays.tobytes(), ends, pages


def feature(samples: bytes, ends: list[list[float]]) -> str:
    """Seconds, mean, deviation, peak from the middle line and crossings of it."""
    x = np.frombuffer(samples, np.uint8).astype(np.int64) - 128
    mean = x.sum() / len(x)
    var = max(0.0, (x * x).sum() / len(x) - mean * mean)
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return f"sec={max(e[-1] for e in ends):.6f};mean={mean:.4f};std={var**0.5:.4f};peak={int(np.abs(x).max())};zc={crossings}"


NAMES = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def text_media(docs: DataFrame) -> DataFrame:
    """Each text's bytes stored as Ogg, read back, described. Null is the empty text; that one's payload is 64 zeros.

    One narrow pass over the rows; repeated rows give repeated results. Nothing depends on doc_id.
    """

    def row(text: str | None) -> tuple:
        raw = (text or "").encode("utf-8")
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        media = store(payload)
        back, ends, _ = restore(media)
        return len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(back, ends)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [row(t) for t in column(b, "text")]
            yield batch_of(NAMES, [column(b, "doc_id"), *(zip(*rows, strict=True) if rows else [[]] * 7)], TYPES)

    return documents(docs).mapInArrow(run, SCHEMA)


def encode_column(docs: DataFrame) -> DataFrame:
    """(doc_id, media binary) for later reading by `probe`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raws = [(t or "").encode("utf-8") for t in column(b, "text")]
            yield batch_of(["doc_id", "media"], [column(b, "doc_id"), [store(r + bytes(-len(r) % 64 if r else 64)) for r in raws]], [pa.int64(), pa.binary()])

    return documents(docs).mapInArrow(run, "doc_id long, media binary")


def probe(files: DataFrame, id_column: str, media_column: str) -> DataFrame:
    """One row per logical stream of each file: serial, packets, bytes, last granule; a row with `error` for a bad file.

    Null media give one row with error `null`; an empty file has no streams and gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, data in zip(column(b, "id"), column(b, "media"), strict=True):
                if data is None:
                    rows.append((i, None, None, None, None, "null"))
                    continue
                try:
                    rows += [(i, s.serial, len(s.packets), sum(len(p) for p, _ in s.packets), max([g for _, g in s.packets], default=NO_GRANULE), None) for s in demux(data).values()]
                except OggError as e:
                    rows.append((i, None, None, None, None, str(e)))
            yield batch_of(["id", "serial", "packets", "bytes", "granule", "error"], [*(zip(*rows, strict=True) if rows else [[]] * 6)], [pa.int64()] * 5 + [pa.string()])

    return files.select(F.col(id_column).cast("long").alias("id"), F.col(media_column).alias("media")).mapInArrow(run, "id long, serial long, packets long, bytes long, granule long, error string")


def op7_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`text_media` of documents: a row per row, equal texts give equal values. Null is the empty text; an empty table gives no row."""
    return text_media(table(spark, sf_dir, "documents"))
