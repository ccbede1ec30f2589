"""Line dedup, repeated passages and SimHash, against brute force."""

import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from lattica.llm import lines, simhash, suffixes
from lattica.llm.components import connected_components, local_roots

from .helpers import documents, prose


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def classes(n, links):
    up = list(range(n))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return [root(x) for x in range(n)]


def near_lines(seed, n, alphabet="abcé日"):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        s = [r.choice(alphabet) for _ in range(r.randint(4, 24))]
        for _ in range(r.randint(1, 4)):
            t = list(s)
            for _ in range(r.randint(0, 4)):
                k = r.randrange(len(t))
                t[k : k + r.randint(0, 1)] = [r.choice(alphabet)] * r.randint(0, 1)
                t = t or ["a"]
            out.append("".join(t))
    return out


@pytest.mark.parametrize("most", [1, 2, 3])
def test_edit_distance_and_index(most):
    texts = sorted({t for t in near_lines(most, 40) if len(t) > most})
    points, length = lines.code_points(texts)
    begin = np.cumsum(length) - length
    n = len(texts)
    a, b = np.repeat(np.arange(n), n), np.tile(np.arange(n), n)
    near = lines.within(a, b, points, begin, length, most).reshape(n, n)
    truth = np.array([[edits(x, y) <= most for y in texts] for x in texts])
    assert (near == truth).all() and truth.sum() > n
    index = defaultdict(set)
    for rows, start, size, tag in lines.index_entries(length, most):
        for r, s, z, t in zip(rows, start, size, tag, strict=True):
            index[t, texts[r][s : s + z]].add(r)
    met = {(min(r, o), max(r, o)) for rows, start, size, tag in lines.selections(length, most) for r, s, z, t in zip(rows, start, size, tag, strict=True) for o in index.get((t, texts[r][s : s + z]), ())}
    assert all((i, j) in met for i in range(n) for j in range(i + 1, n) if truth[i, j])


@pytest.mark.parametrize("most", [0, 1, 2, 3])
def test_index_with_a_further_part(most):
    """With every segment refined, all near pairs still meet."""
    texts = sorted({t for t in near_lines(20 + most, 60) if len(t) > most})
    segments = lines.Segments(texts, most)
    index = defaultdict(set)
    for shorter, shift, rows, tag, keys in segments.indexed():
        for r, k in segments.refined(False, shorter, shift, rows, tag, keys):
            for row, key in zip(r.tolist(), k.tolist(), strict=True):
                index[key].add(row)
    met = set()
    for shorter, shift, rows, tag, keys in segments.probed():
        for r, k in segments.refined(True, shorter, shift, rows, tag, keys):
            met |= {(min(row, o), max(row, o)) for row, key in zip(r.tolist(), k.tolist(), strict=True) for o in index.get(key, ())}
    n = len(texts)
    near = [(i, j) for i in range(n) for j in range(i + 1, n) if edits(texts[i], texts[j]) <= most]
    assert all(p in met for p in near)
    assert most == 0 or (len(near) > 20 and len(met) < n * (n - 1) // 2)


@pytest.mark.parametrize("hot", [0, 2, 1 << 40])
def test_crowded_segments(spark, hot):
    """Lines that share a segment and little else, some of them near copies: the same classes however segments are indexed."""
    r = random.Random(4)
    pool = [f"{a}{b}{c}" for a in ("https://exam", "catalogue ", "") for b in near_lines(5, 20, "abcdefg") for c in ("ple.com/page", " no. 12 of 40")]
    texts = sorted({t for t in pool + [t[:3] + "#" + t[4:-2] + t[-1] for t in r.sample(pool, 30)] if len(t) >= 5})
    frame = spark.createDataFrame(list(enumerate(texts)), "line_id long, line string").repartition(3)
    found = {(x.node, x.component) for x in connected_components(lines.edit_links(frame, 2, hot)).collect()}
    of = classes(len(texts), [(i, j) for i in range(len(texts)) for j in range(i) if edits(texts[i], texts[j]) <= 2])
    groups = defaultdict(set)
    for i, c in enumerate(of):
        groups[c].add(i)
    assert found == {(i, min(g)) for g in groups.values() if len(g) > 1 for i in g}
    assert len(found) > 40


def plain_duplicates(docs, most, least):
    """docs: (doc_id, text). Per document, as told apart by both: {line: (first doc_id, first line)}."""
    docs = sorted({d for d in docs if d[1]}, key=lambda d: (d[0] is None, d[0] or 0, signed(xxhash.xxh64_intdigest(d[1].encode(), 42))))
    first, places = {}, []
    for k, (_, t) in enumerate(docs):
        for p, x in enumerate(t.split("\n")):
            if x.strip(" \t\n\v\f\r"):
                places.append((k, p, x))
                first.setdefault(x, (k, p))
    distinct = list(first)
    near = [(i, j) for i in range(len(distinct)) for j in range(i) if min(len(distinct[i]), len(distinct[j])) >= least and abs(len(distinct[i]) - len(distinct[j])) <= most and edits(distinct[i], distinct[j]) <= most]
    of = classes(len(distinct), near)
    origin = {}
    for k, x in zip(of, distinct, strict=True):
        origin[k] = min(origin.get(k, first[x]), first[x])
    number = {x: k for x, k in zip(distinct, of, strict=True)}
    out = {d: {} for d in docs}
    for k, p, x in places:
        if (o := origin[number[x]]) != (k, p):
            out[docs[k]][p] = (docs[o[0]][0], o[1])
    return out


def signed(x):
    return x - (x >> 63 << 64)


def check_lines(spark, docs, ids, most=2, least=16, table=None):
    expected = plain_duplicates([*zip(ids, docs, strict=True)], most, least)
    table = documents(spark, docs, ids) if table is None else table
    rows = lines.line_report(table.repartition(3), most, least).collect()
    got = sorted((repr(r.doc_id), r.n_lines, r.n_duplicates, [tuple(x) for x in r.duplicates]) for r in rows)
    want = [(i, t, expected.get((i, t), {})) for i, t in zip(ids, docs, strict=True)]
    assert got == sorted((repr(i), len(t.split("\n")) if t else 0, len(e), [(p, *e[p]) for p in sorted(e)]) for i, t, e in want)
    out = lines.drop_lines(table.repartition(3), most, least).collect()
    kept = [(i, t if not e else "\n".join(x for p, x in enumerate(t.split("\n")) if p not in e)) for i, t, e in want]
    assert sorted(map(repr, ((r.doc_id, r.text) for r in out))) == sorted(map(repr, kept))
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in out)
    return expected


@pytest.mark.parametrize("block", [3, 1024])
def test_duplicate_lines(spark, monkeypatch, block):
    monkeypatch.setattr(lines, "BLOCK", block)
    monkeypatch.setattr(lines, "CHUNK", 400)
    pool = near_lines(9, 40)
    r = random.Random(1)
    texts = ["\n".join(r.choice([*pool, "", " "]) for _ in range(r.randint(0, 6))) for _ in range(40)] + [None, ""]
    ids = [*range(30), *(r.choice([3, 4, None]) for _ in range(len(texts) - 30))]  # ids that several texts have, and none
    found = check_lines(spark, [*texts, *texts[:3]], [*ids, *ids[:3]], 2, 5)
    assert sum(map(len, found.values())) > 40


def test_rows_with_one_id_are_documents_of_their_own(spark):
    shared = "a line of boilerplate that stands in many documents"
    alone = "this line stands only in this very document, nowhere else"
    texts = [f"{shared}\nend", f"x\n{shared}", f"{alone}\n{shared}", f"{shared}\n{alone[:-1]}?\nend", None]
    found = check_lines(spark, texts, [1, 7, 7, None, None])
    assert sum(map(len, found.values())) == 5


def test_large_group_is_blocked_without_loss():
    rng = np.random.default_rng(0)
    members = rng.choice(1 << 40, 50, replace=False).astype(np.int64)
    records = np.empty(100, lines.RECORD)
    records["key"], records["line"], records["probe"] = 7, np.tile(members, 2), np.repeat([0, 1], 50)
    groups, found = map(np.concatenate, zip(*lines.meetings(records, block=8), strict=True))
    by = defaultdict(set)
    for g, m in zip(groups.tolist(), found.tolist(), strict=True):
        by[g].add(m)
    assert max(map(len, by.values())) < 40
    pairs = {(a, b) for s in by.values() for a in s for b in s}
    assert all((a, b) in pairs for a in members.tolist() for b in members.tolist())


def test_lines_dropped(spark):
    shared = "a line of boilerplate that stands in many documents"
    nearly = shared.replace("many", "mony")
    texts = [f"{prose(1, 30)}\n{shared}", f"{prose(2, 30)}\n{nearly}\nend", f"{prose(1, 30)}\n{shared}", "\n".join([shared] * 9), "Read more\nこれは同じ文です。\nこれは同じ文です。\nRead more\nRead mare\n \n "]
    check_lines(spark, texts, range(5))
    rows = {r.doc_id: r for r in lines.drop_lines(documents(spark, texts)).collect()}
    assert [rows[k].text for k in range(5)] == [texts[0], f"{prose(2, 30)}\nend", "", "", "Read more\nこれは同じ文です。\nRead mare\n \n "]


def plain_passages(texts, least):
    where = defaultdict(list)
    for d, t in enumerate(texts):
        w = (t or "").encode().split()
        for s in range(len(w) - least + 1):
            where[tuple(w[s : s + least])].append((d, s))
    starts = defaultdict(set)
    for places in where.values():
        if len(places) > 1:
            for d, s in places:
                starts[d].add(s)
    out = []
    for d, found in starts.items():
        first = last = None
        for s in sorted(found):
            if last is None or s > last + 1:
                if first is not None:
                    out.append((d, first, last + least))
                first = s
            last = s
        out.append((d, first, last + least))
    return sorted(out)


@pytest.mark.parametrize(("least", "run", "bits"), [(10, 4, 64), (12, 12, 8), (50, 16, 64), (10, 4, 3)])
def test_passages(spark, monkeypatch, least, run, bits):
    monkeypatch.setattr(suffixes, "FLUSH", 400)
    monkeypatch.setattr(suffixes, "SLICE", 50)
    monkeypatch.setattr(suffixes, "PRINT", np.uint64((1 << bits) - 1))  # prints of a few bits collide: words must be compared
    r = random.Random(least)
    shared = [prose(100 + k, r.randint(least, 3 * least)) for k in range(4)]
    texts = [" ".join(x for k in range(3) for x in (prose(1000 * i + k, r.randint(0, 40)), r.choice(shared) if r.random() < 0.6 else "")) for i in range(30)]
    texts += [None, "", texts[3], "same " * 40, prose(7, 3 * least) + " " + prose(7, 3 * least)]
    got = suffixes.repeated_passages(documents(spark, texts).repartition(3), least, run).collect()
    assert sorted((x.doc_id, x.start_word, x.end_word) for x in got) == plain_passages(texts, least)
    assert all(x.n_words == x.end_word - x.start_word >= least for x in got)


def test_passages_of_rows_with_one_id(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "SLICE", 10)
    a, b, c = (prose(k, 60) for k in (31, 32, 33))
    texts = [f"{a} {prose(41, 40)}", f"{prose(42, 30)} {b}", a, b, f"{prose(43, 9)} {c}", f"{c} {prose(44, 9)}", prose(45, 99), prose(45, 99)]
    ids = [7, 7, 1, 2, None, None, 3, 3]
    got = sorted((-1 if x.doc_id is None else x.doc_id, x.start_word, x.end_word, x.with_doc_id) for x in suffixes.repeated_passages(documents(spark, texts, ids).repartition(3)).collect())
    assert got == [(-1, 0, 60, None), (-1, 9, 69, None), (1, 0, 60, 7), (2, 0, 60, 7), (3, 0, 99, 3), (7, 0, 60, 1), (7, 30, 90, 2)]


def test_windows_by_rank():
    rng = np.random.default_rng(5)
    for least in (3, 8, 13):
        ids = rng.integers(0, 2, 400)
        starts = np.arange(400 - least + 1)
        ranks = suffixes.window_ranks(ids, starts, least)
        windows = [tuple(ids[s : s + least].tolist()) for s in starts]
        assert len({*ranks.tolist()}) == len({*windows}) == len({*zip(ranks.tolist(), windows, strict=True)})


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate(dict.fromkeys(range(9, 14), " ")).split(" ")
    words = [w for w in words if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints():
    for t in [None, "", " \n", "One", "A b\tC", "É é A B c d", prose(1, 50), prose(2, 300) + " " + prose(2, 300)]:
        assert simhash.fingerprint(t) == plain_fingerprint(t)


def test_position_sets():
    from itertools import combinations

    for size, n in ((3, 20), (4, 70)):
        sets = simhash.position_sets(size)
        assert len(sets) == n and all(any(set(s) <= set(four) for s in sets) for four in combinations(range(8), 4))


@pytest.mark.parametrize(("key_bytes", "block"), [(3, 1 << 15), (3, 7), (4, 1 << 15)])
def test_links(spark, monkeypatch, key_bytes, block):
    monkeypatch.setattr(simhash, "LONG_LIST", 6)
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = np.random.default_rng(3)
    fps = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    for _ in range(3):  # chains of near ones, and a dense group
        flips = np.array([np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, rng.integers(1, 6), replace=False).astype(np.uint64)) for _ in range(80)], np.uint64)
        fps = np.unique(np.concatenate([fps, rng.choice(fps, 80) ^ flips]))
    fps = np.unique(np.concatenate([fps, fps[0] ^ (np.uint64(1) << np.arange(40, dtype=np.uint64))]))
    expected = classes(len(fps), [(i, int(j)) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(fps[i] ^ fps) <= 4)])
    table = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long").repartition(3)
    got = dict((r.node, r.component) for r in connected_components(simhash.fingerprint_links(table, key_bytes)).collect())
    label = [got.get(int(x), int(x)) for x in fps.view(np.int64)]
    assert len(set(zip(label, expected, strict=True))) == len(set(label)) == len(set(expected))


def test_near_duplicates(spark):
    a, b = prose(1, 400), prose(2, 400)
    near = a.split()
    near[200] = "changed"
    texts = [b, a, " ".join(near), a.upper(), None, "", " \n", "x"]
    rows = {r.doc_id: r for r in simhash.near_duplicates(documents(spark, texts)).collect()}
    prints = [plain_fingerprint(t) for t in texts]
    assert [rows[k].fingerprint for k in range(8)] == [f"{p:016x}" for p in prints]
    assert [rows[k].component_id for k in range(8)] == classes(8, [(i, j) for i in range(8) for j in range(8) if (prints[i] ^ prints[j]).bit_count() <= 4])


def test_one_row_of_each_group_stays(spark):
    a, b = prose(1, 400), prose(2, 400)
    near = a.split()
    near[200] = "changed"
    rows = [(None, a, 1), (7, " ".join(near), 2), (7, b, 3), (5, b, 4), (5, b, 4), (5, b, 5), (None, None, 6), (None, "", 7), (9, "alone in the table by itself", 8), (None, "x y z", 9), (None, "x y z", 10)]
    table = spark.createDataFrame(rows, "doc_id long, text string, kept_id int").repartition(3)
    got = sorted(map(repr, map(tuple, simhash.one_of_each(table).collect())))
    prints = [plain_fingerprint(r[1]) for r in rows]
    of = classes(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4])
    groups = defaultdict(list)
    for k, r in zip(of, rows, strict=True):
        groups[k].append(r)
    assert len(got) == len(groups) == 5 and len({*got}) == 5
    for g in groups.values():
        least = min((r[0] is None, r[0] or 0) for r in g)
        assert sum(repr(r) in got for r in {*g}) == 1 and any(repr(r) in got for r in g if (r[0] is None, r[0] or 0) == least)
    assert sorted(map(repr, map(tuple, simhash.one_of_each(table.repartition(1)).collect()))) == got


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(300, 340)] + [(500, k) for k in range(501, 560)]
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(edges, "a long, b long").repartition(4)).collect()}
    of = classes(600, edges)
    assert got == {x: of[x] for e in edges for x in e if e[0] != e[1]}
    nodes, roots = local_roots(*np.array(edges).T)
    assert dict(zip(nodes.tolist(), roots.tolist(), strict=True)) == {x: of[x] for e in edges for x in e}
