"""Tokens of whole texts through a cache of the tokens of their space-led segments.

The vocabularies of the `tokenizers` library that are used here split a text at white space before any merge, so no token
crosses a space that stands before a visible character. A segment that isn't cached is split by the vocabulary's own
pattern and merged by the library's model; segments with characters beyond Latin letters and ASCII, and texts with
any other kind of space, or with the string of an added token, are given to the library whole.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Callable
from sys import getsizeof

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from .common import kept_by_worker, single_threaded

#: A space before anything but a plainly visible character: such texts aren't cut.
ODD = re.compile(" (?![!-~¡-ᙿ])")
#: What is split here: ASCII without blanks but the line end and the space, and precomposed Latin letters and marks.
PLAIN = re.compile("[\n -~¡-¬®-ɏ]*")
BYTE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Marks that are parts of their own between a letter and a space.
MARKS = frozenset(".,;:!?")
NOTHING = b""
#: Bytes of a generation of a worker's cache.
CACHE_BYTES = 112 << 20


def byte_letters() -> dict[int, int]:
    """The fixed table of byte-level vocabularies: visible bytes stand for themselves, others for letters from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in visible]
    return {b: 256 + i for i, b in enumerate(others)}


class SegmentEncoder:
    """ids of texts as little-endian uint32 bytes, as the library gives them: the string of an added token in a text gets that token's id.
    `limit`: bytes of each generation of each cache."""

    def __init__(self, path: str, limit: int = CACHE_BYTES):
        single_threaded()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cache, self.parts = Cache(limit), Cache(limit // 2)
        with open(path) as f:
            config = json.load(f)
        self.split = self.splitter(config)
        # normalizers may change case before added tokens are looked for; what has no case tells quickly where none is
        added = [t["content"] for t in config.get("added_tokens", ())]
        self.marks = {max(re.split(r"[^\W\d_]+", t), key=len) for t in added}
        self.added = re.compile("|".join(map(re.escape, added)) or r"(?!)", re.IGNORECASE)

    def is_odd(self, text: str) -> bool:
        return bool(ODD.search(text) or any(m in text for m in self.marks) and self.added.search(text))

    @staticmethod
    def splitter(config: dict) -> tuple[Callable[[str], list[str]], bool] | None:
        """The vocabulary's split of PLAIN segments, and whether it lowers case and drops white space before; None if it's
        of a kind not known here."""
        byte_level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True}
        if config["normalizer"] is None and config["pre_tokenizer"] == byte_level | {"use_regex": True}:
            return regex.compile(BYTE_PATTERN).findall, False
        steps = [n["type"] for n in (config["normalizer"] or {}).get("normalizers", [])]
        parts = (config["pre_tokenizer"] or {}).get("pretokenizers", [])
        if steps == ["NFC", "Replace", "Lowercase"] and len(parts) == 2 and parts[1] == byte_level | {"use_regex": False} and parts[0].get("behavior") == "Removed" and parts[0].get("invert"):
            return regex.compile(parts[0]["pattern"]["Regex"]).findall, True
        return None

    def library(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def segments(self, found: list[str], lead: str = "") -> list[bytes]:
        """ids of segments, each encoded by itself, with `lead` before it."""
        if self.split is None:
            return self.library([lead + s for s in found])
        split, lower = self.split
        lead_kept = "" if lower else lead
        # what follows `lead` is known as a segment, if the segments that are kept are led alike
        words = self.cache if lower or lead else Cache(0)
        parts, learn, merged = self.parts.new, self.part, self.merged
        out: list[bytes] = []
        others = []
        for i, segment in enumerate(found):
            if not (segment.isascii() and segment.isprintable() or PLAIN.fullmatch(segment)):
                others.append(i)
                out.append(NOTHING)
                continue
            if lower:
                segment = segment.lower()
            # letters alone are one part, and so is a mark after them: no pattern needed
            if segment.isalpha():
                out.append(words.get(segment) or merged(lead_kept + segment))
                continue
            if segment[-1:] in MARKS and segment[:-1].isalpha():
                if (word := words.get(segment[:-1])) is None:
                    word = merged(lead_kept + segment[:-1])
                    if words is self.cache:
                        words.put(segment[:-1], word)
                out.append(word + (parts.get(segment[-1]) or learn(segment[-1])))
            else:
                out.append(b"".join([parts.get(p) or learn(p) for p in split(lead_kept + segment)]))
            parts = self.parts.new
        if others:
            for i, ids in zip(others, self.library([lead + found[i] for i in others]), strict=True):
                out[i] = ids
        return out

    def merged(self, part: str) -> bytes:
        spelt = part.replace(" ", SPACE).replace("\n", LINE) if part.isascii() else part.encode("utf-8").decode("latin-1").translate(BYTE_LETTERS)
        return array("I", [t.id for t in self.tokenizer.model.tokenize(spelt)]).tobytes()

    def part(self, part: str) -> bytes:
        ids = self.parts.old.get(part) or self.merged(part)
        return self.parts.put(part, ids)

    def encode(self, texts: list[str]) -> list[bytes]:
        """A text's first segment is encoded as it stands, each later one with the space before it."""
        out: list[bytes] = [NOTHING] * len(texts)
        odd = [i for i, t in enumerate(texts) if t and self.is_odd(t)]
        known = {*odd}
        plain = [i for i, t in enumerate(texts) if t and i not in known]
        for some, ids in ((odd, self.library), (plain, self.by_segments)):
            for i, x in zip(some, ids([texts[i] for i in some]) if some else [], strict=True):
                out[i] = x
        return out

    def by_segments(self, texts: list[str]) -> list[bytes]:
        return gathered(texts, self.cached, self.segments)

    def cached(self, words: list[str]) -> list[bytes]:
        """ids of segments, given without the space before them."""
        return self.cache.values(words, lambda fresh: self.segments(fresh, " "))


class Cache:
    """Values of strings in two generations of `limit` bytes each: what a full one holds stays until the next one is full."""

    #: Bytes of an entry's place in a dictionary.
    PLACE = 100
    #: Entries that are added before the limit is looked at again.
    STEP = 4096

    def __init__(self, limit: int):
        self.limit, self.held = limit, 0
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def get(self, word: str) -> bytes | None:
        return self.old.get(word) if (value := self.new.get(word)) is None else value

    def put(self, word: str, value: bytes) -> bytes:
        if self.held > self.limit:
            self.old, self.new, self.held = self.new, {}, 0
        self.new[word] = value
        self.held += getsizeof(word) + getsizeof(value) + self.PLACE
        return value

    def add(self, words: list[str], values: list[bytes]) -> None:
        for i in range(0, len(words), self.STEP):
            if self.held > self.limit:
                self.old, self.new, self.held = self.new, {}, 0
            some, theirs = words[i : i + self.STEP], values[i : i + self.STEP]
            self.new.update(zip(some, theirs, strict=True))
            self.held += sum(map(getsizeof, some)) + sum(map(getsizeof, theirs)) + len(some) * self.PLACE

    def values(self, words: list[str], learn: Callable[[list[str]], list[bytes]]) -> list[bytes]:
        """Values of different words; learn gives those of new ones."""
        found = list(map(self.new.get, words))
        missed = [k for k, ids in enumerate(found) if ids is None]
        lost = [words[k] for k in missed]
        values = list(map(self.old.get, lost))
        fresh = [j for j, ids in enumerate(values) if ids is None]
        if fresh:
            for j, ids in zip(fresh, learn([lost[j] for j in fresh]), strict=True):
                values[j] = ids
        for k, ids in zip(missed, values, strict=True):
            found[k] = ids
        self.add(lost, values)
        return found


def gathered(texts: list[str], ids_of: Callable[[list[str]], list[bytes]], ids_of_heads: Callable[[list[str]], list[bytes]] | None = None) -> list[bytes]:
    """ids of texts, cut at each space, from those of their distinct segments; first segments may be taken otherwise.

    Arrow splits the texts and numbers the segments; ids are gathered by their numbers.
    """
    cut = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
    offsets = cut.offsets.to_numpy()
    numbered = cut.flatten().dictionary_encode()
    numbers = numbered.indices.to_numpy().astype(np.int64)
    ids = ids_of(numbered.dictionary.to_numpy(zero_copy_only=False).tolist())
    if ids_of_heads is not None:
        heads = offsets[:-1]
        first = numbered.dictionary.take(pa.array(numbers[heads])).to_pylist()
        numbers[heads] = len(ids) + np.arange(len(heads))
        ids = ids + ids_of_heads(first)
    sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
    starts = np.cumsum(sizes) - sizes
    flat = np.frombuffer(b"".join(ids), "<u4")
    lengths = sizes[numbers]
    upto = np.concatenate([[0], np.cumsum(lengths)])
    out = flat[np.repeat(starts[numbers] - upto[:-1], lengths) + np.arange(upto[-1])]
    ends = upto[offsets].tolist()
    return [out[s:e].tobytes() for s, e in zip(ends, ends[1:])]


BYTE_LETTERS = byte_letters()
SPACE, LINE = (chr(BYTE_LETTERS[ord(c)]) for c in " \n")


@kept_by_worker
def segment_encoder(path: str) -> SegmentEncoder:
    """One for each worker process, kept from task to task."""
    return SegmentEncoder(path)
