"""Quality rules and language identification."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from lattica.llm import langid, quality

from .helpers import WORDS, documents, prose

GERMAN = "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei prozent hatte kann gegen vom können schon wenn habe seine mark ihre dann unter wir soll ich eines jahr zwei jahren diese dieser wieder keine seiner worden will zwischen".split()


def plain_features(text):
    words = (text or "").encode().split()
    repeated = set()
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    for i in range(len(words) - 2):
        if windows[tuple(words[i : i + 3])] > 1:
            repeated |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for x in (text or "").split("\n"):
        if x.strip(" \t\n\v\f\r"):
            dup += x in seen
            seen.add(x)
    return len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text or ""), dup, len(repeated)


def test_base_features():
    r = random.Random(0)
    texts = [None, "", " \n \n", "a b c a b c a", "a b c d a b c", "x\nx\n x\nx", "é|é <b>  y z"]
    texts += ["".join(r.choice(["a", "b", " ", "\n", "#", "é"]) for _ in range(80)) for _ in range(40)]
    for t in texts:
        assert quality.base_features(t) == plain_features(t)


def folded(text):
    return "".join("0" if c in "0123456789" else c for c in text.lower())


def grams_of(text):
    t = "\0" * 4 + folded(text)
    return [t[i : i + 5] for i in range(len(t) - 4)]


def plain_table(texts):
    """{gram: [occurrences, documents]}"""
    out = {}
    for t in texts:
        own = Counter(grams_of(t))
        for g, n in own.items():
            x = out.setdefault(g, [0, 0])
            x[0] += n
            x[1] += 1
    return out


def plain_model(table, below):
    """Modified Kneser-Ney from dictionaries, after Chen and Goodman; n-grams of a single document are unseen. `below` gives what stands below all orders."""
    counts = {5: {g: n for g, (n, _) in table.items()}}
    seen = {5: {g for g, (_, df) in table.items() if df >= 2}}
    for k in (4, 3, 2, 1):
        counts[k] = Counter(g[1:] for g in seen[k + 1])
        seen[k] = {*counts[k]}
    ds = {}
    for k, c in counts.items():
        n1, n2, n3, n4 = (sum(x == i for x in c.values()) for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 else 0.5
        ds[k] = [0] + [min(max(i - (i + 1) * y * b / a, 0.1), i - 0.05) if a else 0.5 for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    total, given = defaultdict(float), defaultdict(float)
    for k, c in counts.items():
        for g, n in c.items():
            total[g[:-1]] += n
            if g in seen[k]:
                given[g[:-1]] += n - ds[k][min(n, 3)]

    def p(g, s):
        if not s:
            return below(g)
        k, ctx = len(s), s[:-1]
        if not total[ctx]:
            return p(g, s[1:])
        c = counts[k].get(s, 0)
        direct = (c - ds[k][min(c, 3)]) / total[ctx] if s in seen[k] else 0
        return direct + (1 - given[ctx] / total[ctx]) * p(g, s[1:])

    return lambda g: p(g, g)


def plain_quality(rows):
    """rows: (text, lang). Per row: log_perplexity, band_low, band_high, kept."""
    by = defaultdict(list)
    for t, lang in rows:
        if t:
            by[lang].append(t)
    every = plain_table([t for own in by.values() for t in own])
    pooled = plain_model(every, lambda g: 1 / (len({x[-1] for x in every}) + 1))
    models = {lang: plain_model(plain_table(own), pooled) for lang, own in by.items()}
    known, score, features = {}, [], [plain_features(t) for t, _ in rows]
    for t, lang in rows:
        if not t:
            score.append(None)
            continue
        low = folded(t)
        runs = sum(c.isalnum() and not (i and low[i - 1].isalnum()) for i, c in enumerate(low))
        for g in {*grams_of(t)} - {g for k, g in known if k == lang}:
            known[lang, g] = math.log(models[lang](g))
        score.append(-sum(known[lang, g] for g in grams_of(t)) / max(runs, 1))
    failed = [f[0] < 50 or 100 * f[4] > 50 * f[0] for f in features]
    xs = defaultdict(list)
    for (_, lang), s, f in zip(rows, score, failed, strict=True):
        if s is not None and not f:
            xs[lang].append(round(s / quality.STEP) * quality.STEP)
    middle = {k: np.median(v) for k, v in xs.items()}
    off = {k: [abs(x - middle[k]) for x in v] for k, v in xs.items()}
    all_middle, all_spread = (np.median([x for v in y.values() for x in v]) for y in (xs, off))
    bands = {}
    for k, v in xs.items():
        m, s = ((len(v) * a + quality.SHRINKAGE * b) / (len(v) + quality.SHRINKAGE) for a, b in ((middle[k], all_middle), (np.median(off[k]), all_spread)))
        w = max(quality.LEAST_BAND, quality.BAND_WIDTH * 1.4826 * s)
        bands[k] = m - w, m + w
    return [(s, *bands.get(lang, (None, None)), not f and lang in bands and bands[lang][0] <= s <= bands[lang][1]) for (_, lang), s, f in zip(rows, score, failed, strict=True)]


def two_languages():
    r = random.Random(2)
    junk = [" ".join(w + r.choice(["&&&", "***", "%%%", "|"]) for w in prose(600 + k, 90, v).split()) for k, v in enumerate((WORDS, GERMAN))]
    rows = [(prose(k, 60 + k % 50), "en") for k in range(60)] + [(prose(k, 70, GERMAN), "de") for k in range(100, 112)]
    rows += [(junk[0], "en"), (junk[1], "de"), (prose(3, 10), "en"), (None, "en"), ("", "de"), ("word and word again " * 30, "en"), (prose(700, 90), None), (rows[0][0], "en"), ("日本 語" * 20 + prose(5, 60), "ja")]
    rows += [(prose(800, 60) + " " + prose(801, 40, GERMAN), "en"), ("x" * 3000 + " 123 " + prose(9, 70), "en"), ("".join(r.choice("bcdfghjklmnpqrstvwxz ") for _ in range(600)), "en")]
    return rows


@pytest.mark.parametrize("shard", [1 << 22, 900])
def test_quality_against_dictionaries(spark, monkeypatch, shard):
    monkeypatch.setattr(quality, "SHARD_ENTRIES", shard)
    rows = two_languages()
    table = spark.createDataFrame([(k, t, lang, k) for k, (t, lang) in enumerate(rows)], "doc_id long, text string, lang string, n_words long").repartition(3)
    got = {r.doc_id: r for r in quality.quality(table).collect()}
    expected = plain_quality(rows)
    assert len(got) == len(rows)
    for k, (t, _) in enumerate(rows):
        assert (got[k].n_words, got[k].word_chars, got[k].n_symbols, got[k].n_dup_lines, got[k].n_repeat_words) == plain_features(t)
        s, low, high, kept = expected[k]
        assert got[k].kept == kept and (s is None) == (got[k].log_perplexity is None)
        assert s is None or np.allclose([got[k].log_perplexity], [s], atol=2e-3)
        assert low is None or np.allclose([got[k].band_low, got[k].band_high], [low, high], atol=2e-2)
    assert all(got[k].kept for k in (*range(72), 78, 79)) and not any(got[k].kept for k in (*range(72, 78), 82, 83))
    assert got[72].log_perplexity > got[72].band_high and got[73].log_perplexity > got[73].band_high and not got[73].base_failed
    kept = quality.keep_good(table).collect()
    assert sorted(map(repr, map(tuple, kept))) == sorted(repr((k, *rows[k], k)) for k in got if got[k].kept)


@pytest.mark.parametrize("words", [WORDS, ["".join(chr(c) for c in range(0x4E00 + 7 * k, 0x4E00 + 7 * k + 5)) for k in range(2900)]])
def test_counts(words):
    texts = [prose(k, 50, words) for k in range(40)]  # the second alphabet is too large to be packed
    codes, n, df, characters = quality.counted(texts)
    plain = plain_table(texts)
    assert {"".join(map(chr, g)): [a, b] for g, a, b in zip(characters.tolist(), n.tolist(), df.tolist(), strict=True)} == plain
    assert (np.diff(codes.astype(object)) > 0).all() and (codes == quality.hashes_of(["".join(map(chr, g)) for g in characters.tolist()])).all()
    halves = quality.added(quality.counted(texts[:15]), quality.counted(texts[15:]))
    assert all((x == y).all() for x, y in zip(halves, (codes, n, df, characters), strict=True))


def test_lookup():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 1 << 63, 5000, dtype=np.uint64) * np.uint64(2))
    values = rng.random(len(keys)).astype("f4")
    find = quality.Lookup(keys, values)
    order = rng.permutation(len(keys))
    assert (find(keys[order]) == values[order]).all() and find(keys[-1:])[0] == values[-1]
    for wrong in (keys[:1] + np.uint64(1), np.array([2**64 - 1], np.uint64)):
        with pytest.raises(RuntimeError):
            find(wrong)


def language_docs(spark, n=160):
    texts = [prose(k, 30 + k % 40, GERMAN if k % 2 else WORDS) for k in range(n)]
    return documents(spark, texts).selectExpr("doc_id", "text", "case when doc_id % 2 = 1 then 'de' else 'en' end as lang", "source", "n_chars")


def test_languages(spark, tmp_path):
    docs = language_docs(spark).unionByName(documents(spark, [None, "", "12 ... 34", "½ ² Ⅷ ① _"], [1000, 1001, 1002, 1003], lang=None))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in langid.op3_language_id(spark, str(tmp_path)).collect()}
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 4 == 2) for k, r in rows.items())
    held = [r for k, r in rows.items() if k < 1000 and r.held_out]
    assert len(held) > 20 and all(r.lang_pred == ("de" if r.doc_id % 2 else "en") and 0 <= r.score <= 1 for r in held)
    assert [(rows[k].lang_pred, rows[k].score) for k in (1000, 1001, 1002, 1003)] == [("und", 0.0)] * 4


def test_held_out_rows_teach_nothing(spark, tmp_path):
    docs = language_docs(spark, 60)
    flipped = docs.withColumn("lang", langid.F.when(langid.held_out(docs), "zz").otherwise(langid.F.col("lang")))
    out = []
    for k, d in enumerate((docs, flipped)):
        d.repartition(1).sortWithinPartitions("doc_id").write.parquet(f"{tmp_path}/{k}/documents.parquet")
        out.append(sorted(map(tuple, langid.op3_language_id(spark, f"{tmp_path}/{k}").collect())))
    assert out[0] == out[1]


def test_sparse_counts():
    doc, bucket, count = langid.sparse_counts(["abab", "x"])
    assert count[doc == 0].sum() == (6 - 1) + (6 - 2) and count[doc == 1].sum() == 2 + 1
    again = langid.sparse_counts(["x", "ABAB"])
    assert again[1][again[0] == 1].tolist() == bucket[doc == 0].tolist()


def plain_buckets(text):
    """Hashed 2- and 3-grams of the text in lower case, a space around it, by numbers modulo 2**32."""
    t = [ord(c) for c in f" {text.lower()} "]
    out = Counter()
    for n, factors, more in ((2, (0x9E3779B1, 0x85EBCA77), 0), (3, (0xC2B2AE3D, 0x27D4EB2F, 0x165667B1), 1)):
        for i in range(len(t) - n + 1):
            h = (sum(a * b for a, b in zip(t[i : i + n], factors, strict=True)) + more) % 2**32
            out[((h ^ h >> 15) * 0x2C1B3C6D) % 2**32 >> 16] += 1
    return out


def test_classifier_against_dictionaries(spark):
    """TF-IDF and follow-the-regularised-leader with elastic-net penalties, coordinate by coordinate."""
    texts = [(prose(k, 12, GERMAN if k % 2 else WORDS), k % 2) for k in range(24)]
    df, n = langid.document_frequencies(documents(spark, [t for t, _ in texts]).repartition(3))
    plain_df = Counter(b for t, _ in texts for b in plain_buckets(t))
    assert n == 24 and {b: int(x) for b, x in enumerate(df) if x} == plain_df
    rows = []
    for t, k in texts:
        x = {b: (1 + math.log(c)) * (math.log((1 + 24) / (1 + plain_df[b])) + 1) for b, c in plain_buckets(t).items()}
        norm = math.sqrt(sum(v * v for v in x.values()))
        rows.append((k, {b: v / norm for b, v in x.items()} | {langid.BUCKETS: 1.0}))
    z, squares = defaultdict(float), defaultdict(float)

    def weight(b, k):
        v = z[b, k]
        return 0.0 if abs(v) <= langid.L1 else -(v - math.copysign(langid.L1, v)) / ((langid.BETA + math.sqrt(squares[b, k])) / langid.ALPHA + langid.L2)

    order = np.random.default_rng(0)
    for _ in range(langid.EPOCHS):
        for i in order.permutation(len(rows)):
            lang, x = rows[i]
            w = {(b, k): weight(b, k) for b in x for k in (0, 1)}
            s = [sum(v * w[b, k] for b, v in x.items()) for k in (0, 1)]
            p = [1 / (1 + math.exp(s[1 - k] - s[k])) for k in (0, 1)]
            for b, v in x.items():
                for k in (0, 1):
                    g = (p[k] - (k == lang)) * v
                    z[b, k] += g - (math.sqrt(squares[b, k] + g * g) - math.sqrt(squares[b, k])) / langid.ALPHA * w[b, k]
                    squares[b, k] += g * g
    idf = np.log((1 + n) / (1 + df)) + 1
    doc, bucket, count = langid.sparse_counts([t for t, _ in texts])
    x = langid.weights(doc, bucket, count, idf, len(texts))
    model = langid.Classifier(["en", "de"], idf)
    model.fit([(k, bucket[doc == i], x[doc == i]) for i, (_, k) in enumerate(texts)])
    assert all(abs(model.w[b, k] - weight(b, k)) < 1e-4 for b in [*plain_df, langid.BUCKETS] for k in (0, 1))
    assert 0 < np.count_nonzero(model.w) < 2 * len(plain_df)  # the first penalty leaves some at zero
    langs, scores = model.predict([t for t, _ in texts])
    for i, (_, x) in enumerate(rows):
        s = [sum(v * weight(b, k) for b, v in x.items()) for k in (0, 1)]
        p = [1 / (1 + math.exp((s[1 - k] - s[k]) / model.temperature)) for k in (0, 1)]
        assert abs(scores[i] - max(p)) < 1e-4 and langs[i] == ("de" if p[1] > p[0] else "en")


def test_sample_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE", 40)
    rows = [(None, "the same text", "en")] * 3000 + [(k, prose(k, 5), "en") for k in range(600)] + [(k, prose(k, 5, GERMAN), "de") for k in range(30)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.sample(table, {"en": 3600, "de": 30}).collect()
    assert sum(r.lang == "de" for r in got) == 30 and sum(r.lang == "en" for r in got) < 120
    monkeypatch.setattr(langid, "SAMPLE_IN_ALL", 20)
    assert len(langid.sample(table, {"en": 3600, "de": 30}).collect()) < 40


def test_calibration_lowers_loss():
    rng = np.random.default_rng(0)
    model = langid.Classifier(["a", "b"], np.ones(langid.BUCKETS))
    data = [(k % 2, np.array([k % 2 * 10 + int(rng.random() < 0.2)]), np.array([1.0])) for k in range(200)]
    model.fit(data)
    model.w *= 20  # overconfident
    model.calibrate(data)
    assert model.temperature > 1.2
    model.w *= 4
    before = model.temperature
    model.calibrate(data)
    assert abs(model.temperature / before - 4) < 0.1
