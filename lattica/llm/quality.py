"""Quality rules with n-gram perplexity.

A modified Kneser-Ney model of the characters of order 5 is counted by Spark over all documents, for each language and for all
languages together. What it keeps grows with the corpus: counts are rows, estimated by joins and aggregations, and the
probabilities are stored as sorted hash arrays, shard by shard, so that a worker holds one shard at a time. A language's
model backs off to the model of all languages, so that quotations and rare languages are judged by that one. A document is
scored as if it weren't in the corpus: n-grams that it alone has count as unseen. It is rejected by its language's
lower and upper perplexity bands, which follow from the median and spread over all the language's documents.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import batch_of, bounded, column, forget_kept, mix64, spare, table, written

ORDER = 5
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\v\f\r"
#: An n-gram is known if so many documents have it.
LEAST_DOCUMENTS = 2
#: Robust standard deviations from a language's median log-perplexity to its bands.
BAND_WIDTH = 7.0
#: No band is nearer to the median than this.
LEAST_BAND = 1.0
#: A language's median and spread are drawn to those of all documents, which count like so many of its own.
SHRINKAGE = 5
#: Log-perplexities are counted in steps of this size for medians.
STEP = 1 / 128
#: Characters of a batch that are coded at once.
FLUSH = 1 << 21
#: Entries of a shard of the model (12 bytes each): what is broadcast at once. Each further shard is a further pass.
SHARD_ENTRIES = 1 << 22
#: The key of the model of all languages; a language's key is "=" and the language, or "" for null.
POOLED = "*"
#: Bands are broadcast up to so many languages.
MANY_LANGUAGES = 10_000
FACTORS = mix64(np.arange(1, ORDER + 1, dtype=np.uint64)) | np.uint64(1)


@functools.cache
def letters_and_digits() -> np.ndarray:
    return np.array([chr(c).isalnum() for c in range(0x110000)])


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts, in lower case with digits as 0, each text padded at its start; where their n-grams end
    in them, text after text, and where each text starts among those. No text may be empty."""
    pad = "\0" * (ORDER - 1)
    low = [t.lower() for t in texts]
    raw = np.frombuffer(pad.join(["", *low]).encode("utf-32-le", "surrogatepass"), "<u4").copy()
    raw[(raw >= 48) & (raw <= 57)] = 48
    lengths = np.fromiter(map(len, low), np.int64, len(low))
    starts = np.cumsum(lengths) - lengths
    at = np.arange(lengths.sum()) + np.repeat((np.arange(len(low)) + 1) * (ORDER - 1), lengths)
    return raw, at, starts


def coded(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hashes of the n-grams that end at these places."""
    wide = raw.astype(np.uint64)
    sums = wide[: len(wide) - ORDER + 1] * FACTORS[0]
    for k in range(1, ORDER):
        sums += wide[k : len(wide) - ORDER + 1 + k] * FACTORS[k]
    return mix64(sums[at - ORDER + 1])


def hashes_of(grams: list[str]) -> np.ndarray:
    raw = np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), "<u4")
    return coded(raw, np.arange(ORDER - 1, len(raw), ORDER))


def language_keys(lang: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), lang.cast("string")), F.lit(""))


def by_language(keys: list[str], texts: list[str | None]) -> dict[str, list[int]]:
    """Rows that have text, by language."""
    found: dict[str, list[int]] = {}
    for i, (key, text) in enumerate(zip(keys, texts, strict=True)):
        if text:
            found.setdefault(key, []).append(i)
    return found


def cuts(rows: list[int], texts: list[str]) -> Iterator[list[int]]:
    held, size = [], 0
    for i in rows:
        held.append(i)
        size += len(texts[i])
        if size >= FLUSH:
            yield held
            held, size = [], 0
    if held:
        yield held


Counts = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]  # hashes in order, occurrences, documents, characters


def counted(texts: list[str]) -> Counts:
    raw, at, starts = code_points(texts)
    doc = np.repeat(np.arange(len(starts), dtype=np.uint64), np.diff(np.concatenate([starts, [len(at)]])))
    alphabet = np.flatnonzero(np.bincount(raw))
    bits = max(1, int(len(alphabet) - 1).bit_length())
    docs = max(1, int(len(starts) - 1).bit_length())
    if ORDER * bits + docs <= 64:  # n-gram and document in one number, which sorts fastest
        number = np.zeros(int(alphabet[-1]) + 1, np.uint64)
        number[alphabet] = np.arange(len(alphabet))
        wide = number[raw]
        packed = wide[: len(wide) - ORDER + 1].copy()
        for k in range(1, ORDER):
            packed = packed << np.uint64(bits) | wide[k : len(wide) - ORDER + 1 + k]
        packed = np.sort(packed[at - ORDER + 1] << np.uint64(docs) | doc)
        grams = packed >> np.uint64(docs)
        other = np.concatenate([[True], packed[1:] != packed[:-1]])
        begins = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
        found = grams[begins, None] >> (np.uint64(bits) * np.arange(ORDER - 1, -1, -1, dtype=np.uint64)) & np.uint64((1 << bits) - 1)
        characters = alphabet[found.astype(np.int64)].astype("<u4")
        codes = coded(characters.ravel(), np.arange(ORDER - 1, characters.size, ORDER))
    else:
        hashes = coded(raw, at)
        order = np.argsort(hashes, kind="stable")
        ordered, doc = hashes[order], doc[order]
        new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
        other = new | np.concatenate([[True], doc[1:] != doc[:-1]])
        begins = np.flatnonzero(new)
        characters, codes = raw[at[order[begins], None] + np.arange(1 - ORDER, 1)], ordered[begins]
    n = np.diff(np.concatenate([begins, [len(at)]]))
    df = np.add.reduceat(other.astype(np.int64), begins)
    order = np.argsort(codes)
    return codes[order], n[order], df[order], characters[order]


def added(a: Counts, b: Counts) -> Counts:
    codes = np.concatenate([a[0], b[0]])
    order = np.argsort(codes, kind="stable")
    codes = codes[order]
    begins = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    n, df = (np.add.reduceat(np.concatenate([a[k], b[k]])[order], begins) for k in (1, 2))
    return codes[begins], n, df, np.concatenate([a[3], b[3]])[order[begins]]


def count_ngrams(docs: DataFrame) -> DataFrame:
    """docs(lang_key, text): (lang_key, gram, n, df) for every n-gram of every language and of all: occurrences, and documents with it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_kept()
        sums: dict[str, Counts] = {}
        for b in batches:
            texts = column(b, "text")
            for key, rows in by_language(column(b, "lang_key"), texts).items():
                for some in cuts(rows, texts):
                    new = counted([texts[i] for i in some])
                    sums[key] = added(sums[key], new) if key in sums else new
        for key, (_, n, df, raw) in sums.items():
            for i in range(0, len(n), 1 << 16):
                part = raw[i : i + (1 << 16)]
                text = part.tobytes().decode("utf-32-le", "surrogatepass")
                grams = [text[k : k + ORDER] for k in range(0, len(text), ORDER)]
                yield batch_of(["lang_key", "gram", "n", "df"], [[key] * len(grams), grams, n[i : i + (1 << 16)], df[i : i + (1 << 16)]], [pa.string(), pa.string(), pa.int64(), pa.int64()])

    own = docs.select("lang_key", "text").mapInArrow(count, "lang_key string, gram string, n long, df long").groupBy("lang_key", "gram").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    own = written(own, "ngrams")
    return own.unionByName(own.groupBy("gram").agg(F.sum("n").alias("n"), F.sum("df").alias("df")).withColumn("lang_key", F.lit(POOLED)))


def suffix(gram: str, k: int, of: int) -> Column:
    """The last k of an n-gram's `of` characters."""
    return F.substring(gram, of - k + 1, k)


def levels(grams: DataFrame) -> DataFrame:
    """grams(lang_key, gram, n, df): (lang_key, k, s, c, seen) for the last k characters s of all n-grams, k from 1 to ORDER.

    c counts occurrences at the highest order and, below, by how many different characters known n-grams are preceded. An n-gram that
    fewer than LEAST_DOCUMENTS documents have counts as unseen, though its occurrences stay in its context's sum.
    """
    top = grams.select("lang_key", F.lit(ORDER).alias("k"), F.col("gram").alias("s"), F.col("n").alias("c"), (F.col("df") >= LEAST_DOCUMENTS).alias("seen"))
    longer = F.inline(F.array(*(F.struct(F.lit(k).alias("k"), suffix("s", k + 1, ORDER).alias("longer")) for k in range(1, ORDER))))
    distinct = top.select("lang_key", "seen", longer).groupBy("lang_key", "k", "longer").agg(F.max("seen").alias("seen"))
    below = distinct.groupBy("lang_key", "k", F.substr("longer", F.lit(2)).alias("s")).agg(F.count_if("seen").alias("c"))
    return top.unionByName(below.withColumn("seen", F.col("c") > 0))


def discounts(counts: DataFrame) -> DataFrame:
    """By language and k: d1, d2, d3, from how many n-grams have which count, after Chen and Goodman."""
    found = counts.where("c > 0").groupBy("lang_key", "k").agg(*(F.count_if(F.col("c") == k).cast("double").alias(f"n{k}") for k in (1, 2, 3, 4)))
    y = F.when(F.col("n1") > 0, F.col("n1") / (F.col("n1") + 2 * F.col("n2"))).otherwise(0.5)
    d = [F.when(F.col(f"n{k}") > 0, F.least(F.greatest(k - (k + 1) * y * F.col(f"n{k + 1}") / F.col(f"n{k}"), F.lit(0.1)), F.lit(k - 0.05))).otherwise(0.5).alias(f"d{k}") for k in (1, 2, 3)]
    return found.select("lang_key", "k", *d)


def estimated(grams: DataFrame) -> DataFrame:
    """(lang_key, gram, known, left) for every n-gram, of interpolated modified Kneser-Ney: its probability in the language is
    known + left * (its probability below all orders)."""
    every = written(levels(grams), "kn-levels")
    taken = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
    rates = discounts(every)
    every = every.join(F.broadcast(rates) if rates.count() <= ORDER * MANY_LANGUAGES else rates, ["lang_key", "k"], "left").withColumn("rest", F.when(F.col("seen"), F.col("c") - taken).otherwise(0.0))
    # a context is followed by no more n-grams than there are characters
    context = W.partitionBy("lang_key", "k", F.substr("s", F.lit(1), F.col("k") - 1))
    total, given = F.sum("c").over(context), F.sum("rest").over(context)
    every = every.select("lang_key", "k", "s", *(F.when(total > 0, x).otherwise(y).alias(name) for x, y, name in ((F.col("rest") / total, 0.0, "direct"), (1 - given / total, 1.0, "gamma"))))
    every = written(every, "kn-rates")
    out = every.where(F.col("k") == ORDER).select("lang_key", F.col("s").alias("gram"), F.col("direct").alias("known"), F.col("gamma").alias("left"))
    for k in range(ORDER - 1, 0, -1):
        lower = every.where(F.col("k") == k).select("lang_key", F.col("s").alias("shorter"), "direct", "gamma")
        joined = out.withColumn("shorter", suffix("gram", k, ORDER)).join(lower, ["lang_key", "shorter"])
        out = joined.select("lang_key", "gram", (F.col("known") + F.col("left") * F.col("direct")).alias("known"), (F.col("left") * F.col("gamma")).alias("left"))
    return written(out, "kn-backed")


def log_probabilities(grams: DataFrame) -> DataFrame:
    """(lang_key, gram, logp): each language's model, with the model of all languages below it, and all characters alike below that one."""
    found = estimated(grams)
    own, pooled = found.where(F.col("lang_key") != POOLED), found.where(F.col("lang_key") == POOLED)
    characters = grams.where(F.col("lang_key") == POOLED).select(suffix("gram", 1, ORDER)).distinct().count() + 1
    base = pooled.select("gram", (F.col("known") + F.col("left") / characters).alias("base"))
    return own.join(base, "gram").select("lang_key", "gram", F.log(F.col("known") + F.col("left") * F.col("base")).alias("logp"))


Arrays = dict[str, tuple[np.ndarray, np.ndarray]]  # by lang_key: hashes in order, log-probabilities


class Lookup:
    """A sorted hash array with a directory of the hashes' upper bits: from there a hash is a step or two away."""

    def __init__(self, hashes: np.ndarray, logps: np.ndarray):
        self.bits = np.uint64(64 - min(26, 2 + int(len(hashes)).bit_length()))
        self.first = np.searchsorted(hashes, np.arange(1 << (64 - int(self.bits)), dtype=np.uint64) << self.bits)
        self.hashes, self.logps = hashes, logps

    def __call__(self, asked: np.ndarray) -> np.ndarray:
        last = len(self.hashes) - 1
        at = np.minimum(self.first[(asked >> self.bits).astype(np.int64)], last)
        wrong = np.flatnonzero(self.hashes[at] != asked)
        while len(wrong):
            if ((self.hashes[at[wrong]] > asked[wrong]) | (at[wrong] == last)).any():
                raise RuntimeError("a text has n-grams that weren't counted: the table has changed")
            at[wrong] += 1
            wrong = wrong[self.hashes[at[wrong]] != asked[wrong]]
        return self.logps[at]


SHARDS = "shard int, lang_key string, hashes binary, logps binary"


def sorted_arrays(model: DataFrame, shards: int) -> DataFrame:
    """model(lang_key, gram, logp) as rows of sorted hash arrays, one or more for each shard and language."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                h = hashes_of(column(b, "gram"))
                logp = b.column(b.schema.get_field_index("logp"))
                yield pa.RecordBatch.from_arrays([pa.array(shard_of(h, shards)), b.column(b.schema.get_field_index("lang_key")), pa.array(h.view(np.int64)), logp], names=["shard", "lang_key", "hash", "logp"])

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[tuple[int, str], list[tuple[np.ndarray, np.ndarray]]] = {}
        for b in batches:
            shard, keys = (np.array(column(b, c)) for c in ("shard", "lang_key"))
            h, logp = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("hash", "logp"))
            for s in np.unique(shard):
                for key in np.unique(keys[shard == s]):
                    own = (shard == s) & (keys == key)
                    parts.setdefault((int(s), str(key)), []).append((h[own], logp[own]))
        for (s, key), own in parts.items():
            h, logp = (np.concatenate([x[k] for x in own]) for k in (0, 1))
            h = h.view(np.uint64)
            order = np.argsort(h)
            yield batch_of(["shard", "lang_key", "hashes", "logps"], [[s], [key], [h[order].tobytes()], [logp[order].astype("<f4").tobytes()]], [pa.int32(), pa.string(), pa.binary(), pa.binary()])

    rows = model.mapInArrow(hashed, "shard int, lang_key string, hash long, logp double")
    return written(rows.repartition("shard", "lang_key").mapInArrow(stored, SHARDS), "kn-arrays")


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    return ((h >> np.uint64(32)) % np.uint64(shards)).astype(np.int32)


def read_shard(arrays: DataFrame, shard: int) -> Arrays:
    """A shard's arrays, at most about SHARD_ENTRIES entries in all."""
    out: Arrays = {}
    for r in arrays.where(F.col("shard") == shard).collect():
        h, logp = np.frombuffer(r.hashes, "<u8"), np.frombuffer(r.logps, "<f4")
        if r.lang_key in out:
            h, logp = np.concatenate([out[r.lang_key][0], h]), np.concatenate([out[r.lang_key][1], logp])
            order = np.argsort(h)
            h, logp = h[order], logp[order]
        out[r.lang_key] = h, logp
    return out


def sums_of(texts: list[str], lookup: Lookup | None, shard: int, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each text, the sum of the log-probabilities that this shard has, and its runs of letters and digits."""
    raw, at, starts = code_points(texts)
    alnum = letters_and_digits()[raw]
    begun = alnum.copy()
    begun[1:] &= ~alnum[:-1]
    codes = coded(raw, at)
    here = slice(None) if shards == 1 else shard_of(codes, shards) == shard
    logp = np.zeros(len(codes))
    if len(asked := codes[here]):
        if lookup is None:
            raise RuntimeError("a text has n-grams that weren't counted: the table has changed")
        logp[here] = lookup(asked)
    return np.add.reduceat(logp, starts), np.add.reduceat(begun[at], starts, dtype=np.int64)


def base_features(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode("utf-8").split()
    windows = [*zip(words, words[1:], words[2:], strict=False)]
    repeated = 0
    if len(set(windows)) < len(windows):
        often = Counter(windows)
        upto = 0
        for i, w in enumerate(windows):
            if often[w] > 1:
                repeated += i + 3 - max(i, upto)
                upto = i + 3
    lines = text.split("\n")
    dup = 0
    if len(set(lines)) < len(lines):
        lines = [x for x in lines if x.strip(BLANKS)]
        dup = len(lines) - len(set(lines))
    return len(words), len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)), dup, repeated


FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def scored(docs: DataFrame, text: str, key: str, names: dict[str, str], carried: list[str], arrays: Arrays, shard: int, shards: int) -> DataFrame:
    """The carried columns of docs with base features and the sum of log-probabilities and the runs of letters and digits (null without text) as
    further columns; names tells what they are called."""
    shared = docs.sparkSession.sparkContext.broadcast(arrays)
    out = [names[x] for x in (*FEATURES, "logp", "runs")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookups: dict[str, Lookup] = {}
        for b in batches:
            texts = column(b, text)
            logps: list[float | None] = [None] * len(texts)
            runs: list[int | None] = [None] * len(texts)
            for lang, rows in by_language(column(b, key), texts).items():
                if lang not in lookups and lang in shared.value:
                    lookups[lang] = Lookup(*shared.value[lang])
                for some in cuts(rows, texts):
                    found = sums_of([texts[i] for i in some], lookups.get(lang), shard, shards)
                    for i, p, r in zip(some, *(x.tolist() for x in found), strict=True):
                        logps[i], runs[i] = p, r
            features = np.array([base_features(t) for t in texts], np.int64).reshape(-1, 5) if shard == 0 else np.zeros((len(texts), 5), np.int64)
            kept = [b.column(b.schema.get_field_index(c)) for c in carried]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(x) for x in features.T), pa.array(logps, pa.float64()), pa.array(runs, pa.int64())], names=[*carried, *out])

    schema = StructType([docs.schema[c] for c in carried])
    for name in out:
        schema = schema.add(name, "double" if name == names["logp"] else "long")
    return docs.mapInArrow(run, schema)


def all_scores(docs: DataFrame, names: dict[str, str], text: str, key: str, carried: list[str]) -> DataFrame:
    """The carried columns of docs with features, log-probability and runs. Where the model has several shards, every one is a pass over the rows, and the
    rows' sums are added up by row number."""
    grams = count_ngrams(docs.select(F.col(key).alias("lang_key"), F.col(text).alias("text")))
    model = written(log_probabilities(grams), "kn-model")
    shards = max(1, -(-model.count() // SHARD_ENTRIES))
    arrays = sorted_arrays(model, shards)
    if shards == 1:
        return written(scored(docs, text, key, names, carried, read_shard(arrays, 0), 0, 1), "quality")
    row, more = spare(docs, "scored_row"), spare(docs, "scored_more")
    docs = written(docs.withColumn(row, F.monotonically_increasing_id()), "quality-rows")
    out = written(scored(docs, text, key, names, [*carried, row], read_shard(arrays, 0), 0, shards), "quality")
    sums = None
    for k in range(1, shards):
        part = written(scored(docs.select(row, text, key), text, key, names, [row], read_shard(arrays, k), k, shards).select(row, F.col(names["logp"]).alias(more)), "quality")
        sums = part if sums is None else sums.unionByName(part)
    total = F.col(names["logp"]) + F.col(more)
    return out.join(sums.groupBy(row).agg(F.sum(more).alias(more)), row).withColumn(names["logp"], total).drop(row, more)


def bands(scores: DataFrame) -> DataFrame:
    """scores(lang_key, score), null scores aside: (lang_key, low, high), a row for each language.

    The middle is the median, the width a multiple of the median deviation from it (at least LEAST_BAND), both drawn to those of all documents.
    """
    known = scores.where("score is not null").select("lang_key", (F.round(F.col("score") / STEP) * STEP).alias("x"))
    median = written(known.groupBy("lang_key").agg(F.percentile("x", 0.5).alias("middle"), F.count(F.lit(1)).alias("n")), "bands")
    off = known.join(F.broadcast(median) if median.count() <= MANY_LANGUAGES else median, "lang_key").select("lang_key", "x", F.abs(F.col("x") - F.col("middle")).alias("off"))
    spread = off.groupBy("lang_key").agg(F.percentile("off", 0.5).alias("spread"))
    every = off.agg(F.percentile("x", 0.5).alias("all_middle"), F.percentile("off", 0.5).alias("all_spread")).first()
    if every.all_middle is None:
        return median.select("lang_key", F.lit(0.0).alias("low"), F.lit(0.0).alias("high"))
    drawn = lambda c, to: (F.col("n") * F.col(c) + SHRINKAGE * to) / (F.col("n") + SHRINKAGE)
    width = F.greatest(F.lit(LEAST_BAND), BAND_WIDTH * 1.4826 * drawn("spread", every.all_spread))
    return written(median.join(spread, "lang_key").select("lang_key", (drawn("middle", every.all_middle) - width).alias("low"), (drawn("middle", every.all_middle) + width).alias("high")), "bands")


VERDICT = ("base_failed", "kept", "log_perplexity", "band_low", "band_high")


def judged(docs: DataFrame, text: str, lang: str, carried: list[str]) -> tuple[DataFrame, dict[str, str]]:
    """The carried columns of docs with FEATURES and VERDICT as further columns, and what these are called, as docs may have such names itself."""
    names = {x: spare(docs, x) for x in (*FEATURES, *VERDICT, "logp", "runs")}
    key = spare(docs, "lang_key")
    scores = all_scores(bounded(docs).withColumn(key, language_keys(F.col(lang))), names, text, key, [*carried, key])
    name = {x: F.col(c) for x, c in names.items()}
    failed = (name["n_words"] < 50) | (100 * name["n_repeat_words"] > 50 * name["n_words"])
    scores = scores.withColumn(names["base_failed"], failed).withColumn(names["log_perplexity"], -name["logp"] / F.greatest(name["runs"], F.lit(1)))
    limits = bands(scores.where(~name["base_failed"]).select(F.col(key).alias("lang_key"), name["log_perplexity"].alias("score")))
    limits = limits.toDF(spare(scores, "key_of_bands"), names["band_low"], names["band_high"])
    joined = scores.join(F.broadcast(limits) if limits.count() <= MANY_LANGUAGES else limits, F.col(key) == F.col(limits.columns[0]), "left")
    inside = F.coalesce(name["log_perplexity"].between(name["band_low"], name["band_high"]), F.lit(False))
    return joined.withColumn(names["kept"], ~name["base_failed"] & inside), names


def quality(docs: DataFrame) -> DataFrame:
    """Per row of docs(doc_id, text, lang): base features, base_failed, kept, log_perplexity (negative log-probability in nats for each run
    of letters and digits, so that marks put onto words count against them) and its bands.

    Null and empty texts have no words and so fail the base rules; a null lang is a language. Nothing depends on doc_id, and repeated
    rows give repeated results.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows, _ = judged(docs, "text", "lang", ["doc_id"])
    return rows.select("doc_id", *FEATURES, "base_failed", "kept", "log_perplexity", "band_low", "band_high")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs(text, lang, ...) that `quality` keeps, each by its own text and lang; all columns stay."""
    text, lang = spare(docs, "judged_text"), spare(docs, "judged_lang")
    typed = docs
    for to, of in ((text, "text"), (lang, "lang")):
        typed = typed.withColumn(to, F.col(of).cast("string")) if docs.schema[of].dataType.simpleString() != "string" else typed
    text, lang = (to if to in typed.columns else of for to, of in ((text, "text"), (lang, "lang")))
    rows, names = judged(typed, text, lang, docs.columns)
    return rows.where(F.col(names["kept"])).select(*(F.col(f"`{c}`") for c in docs.columns))


def op2_perplexity_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`quality` of documents: a row per row. Null and empty texts fail the base rules; an empty table gives no row."""
    return quality(table(spark, sf_dir, "documents"))
