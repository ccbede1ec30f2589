"""Token operators: 4, 5 and 8."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from lattica.llm import bitplanes, packing, pieces, wordcache

from .helpers import ODD_TEXTS, documents, prose

BYTE, WORD, PIECE = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
TEXTS = [t or "" for t in ODD_TEXTS] + [" a", "a ", "a  b", "x \n y", "\t", "don't I'll 'S X's 't", "ab c d", "Σας ΣΑΣ", "a.b, c! (d)\n\ne", "▁▁ a▁b", "１２ ³"]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_segments_equal_whole_texts(path):
    whole = Tokenizer.from_file(path)
    encoder = wordcache.SegmentEncoder(path, limit=5000)
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(TEXTS)] == [whole.encode(t, add_special_tokens=False).ids for t in TEXTS]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_operators_give_added_tokens_their_ids(spark, path):
    whole = Tokenizer.from_file(path)
    added = [t.content for t in whole.get_added_tokens_decoder().values()]
    texts = [*TEXTS, "end of page <|endoftext|> next page", *(f"a {t} b{t}c\n{t}" for t in added), *(f"x {t.upper()}y" for t in added), "<|startoftext|>a<|endoftext|>"]
    expected = [whole.encode(t, add_special_tokens=False).ids for t in texts]
    assert whole.token_to_id("<|endoftext|>") in expected[len(TEXTS)]
    encoder = wordcache.segment_encoder(path)
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == expected
    docs, end = documents(spark, texts), 0 if path == BYTE else 2
    crcs = [zlib.crc32(np.array([*ids, end], "<u4").tobytes()) for ids in expected]
    if path == BYTE:
        rows = bitplanes.read_shards(bitplanes.write_shards(docs, path)).collect()
        assert [r.ids_crc32 for r in sorted(rows, key=lambda r: r.doc_id)] == crcs
    else:
        check_pieces(packing.pack_documents(docs, path).collect(), {i: np.array([*ids, end], "<u4") for i, ids in enumerate(expected)})


def test_agenda_equals_library():
    encoder = pieces.PieceEncoder(PIECE, limit=5000)
    expected = encoder.library.encode(TEXTS, add_bos=True, add_eos=True)
    for _ in range(2):
        got = encoder.encode(TEXTS)
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == expected
    assert encoder.corrected == 0
    assert encoder.decode(got) == [encoder.library.decode(x) for x in expected]


def test_piece_query(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    for r in pieces.piece_digests(documents(spark, ODD_TEXTS), PIECE).collect():
        ids = library.encode(ODD_TEXTS[r.doc_id] or "", add_bos=True, add_eos=True)
        assert r.n_corrected == 0 and (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


@pytest.mark.parametrize("planes", [bitplanes.BYTE_PLANES, bitplanes.BIT_PLANES])
@pytest.mark.parametrize("n", [0, 1, 7, 64, 1000])
def test_shard_round_trip(planes, n):
    ids = np.random.default_rng(n).integers(0, 1 << 32, n, dtype=np.uint32)
    shard = bitplanes.Shard(bitplanes.write_shard([5, None], [n, 0], ids, block=64, planes=planes))
    assert np.array_equal(shard.ids(), ids) and np.array_equal(shard.ids(n // 3, n // 2), ids[n // 3 : n // 2])
    keys, lengths = shard.documents()
    assert keys == [5, None] and lengths.tolist() == [n, 0]


def test_shards_of_a_table(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(bitplanes, "SHARD_IDS", 300)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    texts = [prose(i, 40 + i) for i in range(30)] + [None]
    docs = documents(spark, texts, [97 * i % 31 for i in range(31)]).repartition(5)
    shards = bitplanes.write_shards(docs, BYTE)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert shards.select("part").distinct().count() > 2
    whole, start = Tokenizer.from_file(BYTE), 0
    for r in sorted(bitplanes.read_shards(shards).collect(), key=lambda r: r.doc_id):
        text = next(t for i, t in enumerate(texts) if 97 * i % 31 == r.doc_id)
        ids = np.array(whole.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    names = bitplanes.export_shards(shards, str(tmp_path)).collect()
    assert len(names) > 5
    data = [bitplanes.Shard((tmp_path / r.name).read_bytes()) for r in sorted(names)]
    assert sum(s.n_ids for s in data) == start


def check_pieces(rows, ids_of, sizes=None):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for doc, found in by_doc.items():
        ids, at = ids_of[doc], 0
        for r in sorted(found, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    assert set(by_doc) == set(ids_of)
    for found in by_sequence.values():
        at = 0
        for r in sorted(found, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= 4096 and at & (at - 1) == 0  # full windows, and tails in powers of two


def test_packing(spark):
    texts = [prose(i, n) for i, n in enumerate([1, 3, 50, 100, 500, 511, 512, 900, 2000, 2048, 3000, 4095, 4096, 5000, 9000] * 3)] + [None, ""]
    whole = Tokenizer.from_file(WORD)
    ids = {i: np.array(whole.encode(t or "", add_special_tokens=False).ids + [2], "<u4") for i, t in enumerate(texts)}
    rows = packing.pack_documents(documents(spark, texts), WORD, with_ids=True).collect()
    check_pieces(rows, ids)
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in rows)
    assert {r.tier for r in rows} >= {1024, 4096}


def test_packer_by_itself():
    packer, out = packing.Packer(flush=2000), []
    rng = np.random.default_rng(1)
    for i, n in enumerate(rng.integers(1, 9000, 300).tolist()):
        out += packer.add((i, b"", n))
    out += packer.close()
    covered = {}
    for size, parts in out:
        assert sum(p.length for p in parts) == size
        for p in parts:
            covered.setdefault(p.doc, []).append((p.start, p.length))
    for (_, _, n), parts in covered.items():
        at = 0
        for s, k in sorted(parts):
            assert s == at
            at += k
        assert at == n
    assert len(covered) == 300


def test_step_groups_are_even():
    sizes = [4096] * 40 + [2048] * 31 + [512] * 77
    loads = {}
    for s, g in zip(sizes, packing.step_groups(sizes), strict=True):
        loads[g] = loads.get(g, 0) + s
    assert max(loads.values()) - min(loads.values()) <= 512


def test_cache_forgets_by_bytes():
    cache, asked = wordcache.Cache(3000), []

    def learn(words):
        asked.extend(words)
        return [w.encode() for w in words]

    for _ in range(3):
        for k in range(40):
            assert cache.values([f"w{k}", "often"], learn) == [f"w{k}".encode(), b"often"]
            assert cache.held <= 3000 + 2 * 220 and len(cache.new) + len(cache.old) < 35
    assert asked.count("often") == 1 and asked.count("w1") == 3
    assert cache.values(["x" * 5000, "y"], learn) == [b"x" * 5000, b"y"] and cache.values(["z"], learn) == [b"z"] and "y" in cache.new | cache.old


def test_corrections_are_counted(spark, monkeypatch):
    encoder = pieces.PieceEncoder(PIECE)
    monkeypatch.setattr(encoder.vocabulary, "encode", lambda s: [5])
    expected = encoder.library.encode("wrong agenda", add_bos=True, add_eos=True)
    assert np.frombuffer(encoder.encode(["wrong agenda"])[0], "<u4").tolist() == expected and encoder.corrected == 2
