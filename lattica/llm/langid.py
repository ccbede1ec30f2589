"""Language identification.

Sparse multinomial logistic regression on TF-IDF character n-grams (2 and 3 characters, hashed), trained by
follow-the-regularised-leader with elastic-net penalties, followed by temperature calibration. Document frequencies
come from all learning documents; the classifier is fitted on a sample of at most SAMPLE documents a language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_of, bounded, column, exchange, table

BUCKETS = 1 << 16
#: Learning documents of each language that the classifier is fitted on, by a hash of the row: the bound.
SAMPLE = 600
#: Of all languages together, so many at most: with very many languages each has fewer.
SAMPLE_IN_ALL = 60_000
#: Of those, every so many-th calibrates the temperature and isn't trained on.
CALIBRATION = 5
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.02
UNDETERMINED = "und"
LETTER = regex.compile(r"\p{L}")
SLOTS = 16
#: Characters of a batch whose n-grams are counted at once.
FLUSH = 1 << 20


def sparse_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, bucket, count) of the hashed n-grams of the texts in lower case, in order."""
    low = [t.lower() for t in texts]
    raw = np.frombuffer("".join(f" {t} " for t in low).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint32)
    doc = np.repeat(np.arange(len(low), dtype=np.uint32), np.fromiter(map(len, low), np.int64, len(low)) + 2)
    two = raw[:-1] * np.uint32(0x9E3779B1) + raw[1:] * np.uint32(0x85EBCA77)
    three = raw[:-2] * np.uint32(0xC2B2AE3D) + raw[1:-1] * np.uint32(0x27D4EB2F) + raw[2:] * np.uint32(0x165667B1) + np.uint32(1)
    keys = []
    for n, h in ((2, two), (3, three)):
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        same = doc[: len(h)] == doc[n - 1 :]
        keys.append((doc[: len(h)][same].astype(np.uint64) << np.uint64(16)) | (h[same] >> np.uint32(16)).astype(np.uint64))
    key = np.sort(np.concatenate(keys))
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    counts = np.diff(np.concatenate([starts, [len(key)]]))
    key = key[starts]
    return (key >> np.uint64(16)).astype(np.int64), (key & np.uint64(BUCKETS - 1)).astype(np.int64), counts


def chunks(texts: list[str | None]) -> Iterator[list[int]]:
    """Rows that have text, some at a time."""
    held, size = [], 0
    for i, t in enumerate(texts):
        if t:
            held.append(i)
            size += len(t)
            if size >= FLUSH:
                yield held
                held, size = [], 0
    if held:
        yield held


def weights(doc: np.ndarray, bucket: np.ndarray, count: np.ndarray, idf: np.ndarray, n: int) -> np.ndarray:
    """(1 + log tf) * idf, each document's at unit length."""
    x = (1 + np.log(count)) * idf[bucket]
    norm = np.sqrt(np.bincount(doc, x * x, minlength=n))
    return x / np.maximum(norm, 1e-12)[doc]


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """Documents with each bucket, and documents, over all rows of texts(text). The driver gets SLOTS rows."""
    width = BUCKETS // SLOTS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(BUCKETS, np.int64), 0
        for b in batches:
            rows = column(b, "text")
            n += len(rows)
            for some in chunks(rows):
                df += np.bincount(sparse_counts([rows[i] for i in some])[1], minlength=BUCKETS)
        if n:
            yield batch_of(["bucket", "n", "payload"], [list(range(SLOTS)), [n] + [0] * (SLOTS - 1), [df[s * width : (s + 1) * width].tobytes() for s in range(SLOTS)]], [pa.int32(), pa.int64(), pa.binary()])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        n: dict[int, int] = {}
        for b in batches:
            for slot, rows, payload in zip(column(b, "bucket"), column(b, "n"), column(b, "payload"), strict=True):
                sums[slot] = sums.get(slot, 0) + np.frombuffer(payload, np.int64)
                n[slot] = n.get(slot, 0) + rows
        if sums:
            yield batch_of(["bucket", "n", "payload"], [[*sums], [n[s] for s in sums], [x.tobytes() for x in sums.values()]], [pa.int32(), pa.int64(), pa.binary()])

    schema = "bucket int, n long, payload binary"
    df, n = np.zeros(BUCKETS, np.int64), 0
    for r in exchange(texts.select("text").mapInArrow(count, schema), SLOTS).mapInArrow(add, schema).collect():
        df[r.bucket * width : (r.bucket + 1) * width] = np.frombuffer(r.payload, np.int64)
        n += r.n
    return df, n


class Classifier:
    """One weight a bucket and language. `fit` runs FTRL-proximal over sparse documents one by one."""

    def __init__(self, langs: list[str], idf: np.ndarray):
        self.langs, self.idf = langs, idf
        self.z = np.zeros((BUCKETS + 1, len(langs)))  # the last row is the bias
        self.n = np.zeros_like(self.z)
        self.temperature = 1.0

    def proximal(self, rows: np.ndarray) -> np.ndarray:
        z, n = self.z[rows], self.n[rows]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - L1, 0)
        return -shrunk / ((BETA + np.sqrt(n)) / ALPHA + L2)

    def fit(self, documents: list[tuple[int, np.ndarray, np.ndarray]]) -> None:
        """documents: (index of the language, buckets, weights)."""
        rng = np.random.default_rng(0)
        for _ in range(EPOCHS):
            for i in rng.permutation(len(documents)):
                lang, bucket, x = documents[i]
                rows, x = np.append(bucket, BUCKETS), np.append(x, 1.0)
                w = self.proximal(rows)
                p = softmax(x @ w)
                p[lang] -= 1
                g = x[:, None] * p[None, :]
                n = self.n[rows]
                grown = n + g * g
                self.z[rows] += g - (np.sqrt(grown) - np.sqrt(n)) / ALPHA * w
                self.n[rows] = grown
        self.w = self.proximal(np.arange(BUCKETS + 1)).astype(np.float32)

    def calibrate(self, documents: list[tuple[int, np.ndarray, np.ndarray]]) -> None:
        """The temperature with the least log-loss, by golden-section search over its logarithm."""
        if not documents:
            return
        scores = np.array([x @ self.w[b] + self.w[BUCKETS] for _, b, x in documents], np.float64)
        truth = np.array([k for k, _, _ in documents])

        def loss(t: float) -> float:
            s = scores / np.exp(t)
            s -= s.max(axis=1, keepdims=True)
            return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(s)), truth]).mean())

        low, high, g = -3.0, 3.0, (5**0.5 - 1) / 2
        for _ in range(40):
            a, b = high - g * (high - low), low + g * (high - low)
            low, high = (low, b) if loss(a) < loss(b) else (a, high)
        self.temperature = float(np.exp((low + high) / 2))

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        doc, bucket, count = sparse_counts(texts)
        x = weights(doc, bucket, count, self.idf, len(texts))
        scores = np.stack([np.bincount(doc, x * self.w[bucket, k], minlength=len(texts)) for k in range(len(self.langs))], axis=1) + self.w[BUCKETS]
        p = softmax(scores / self.temperature)
        best = p.argmax(axis=1)
        return [self.langs[k] for k in best], p[np.arange(len(p)), best].tolist()


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def sample(learning: DataFrame, counts: dict[str, int]) -> DataFrame:
    """About SAMPLE rows of each language, by a hash of the row; the driver cuts what is over. Rows that are equal are one, so that
    neither copies nor missing ids gather more."""
    most = max(1, min(SAMPLE, SAMPLE_IN_ALL // len(counts)))
    rate = F.create_map(*(x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, most / n)))))
    place = F.pmod(F.xxhash64("doc_id", "text", "lang"), F.lit(1 << 40)) / float(1 << 40)
    return learning.where(place < F.element_at(rate, F.col("lang"))).withColumn("place", place).dropDuplicates(["lang", "place"])


def train(learning: DataFrame) -> Classifier | None:
    """learning(doc_id, text, lang): a calibrated classifier, or None without any labelled text."""
    learning = learning.where("lang is not null and text is not null and text <> ''")
    counts = {r.lang: r.n for r in learning.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    df, n = document_frequencies(learning)
    idf = np.log((1 + n) / (1 + df)) + 1

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, langs, places = column(b, "text"), column(b, "lang"), column(b, "place")
            for some in chunks(texts):
                doc, bucket, count = sparse_counts([texts[i] for i in some])
                x = weights(doc, bucket, count, idf, len(some)).astype(np.float32)
                ends = np.searchsorted(doc, np.arange(len(some)), side="right")
                at = np.concatenate([[0], ends[:-1]])
                cut = [(bucket[s:e].astype(np.uint16).tobytes(), x[s:e].tobytes()) for s, e in zip(at, ends, strict=True)]
                yield batch_of(["lang", "place", "buckets", "weights"], [[langs[i] for i in some], [places[i] for i in some], *zip(*cut, strict=True)], [pa.string(), pa.float64(), pa.binary(), pa.binary()])

    rows = sample(learning, counts).select("text", "lang", "place").mapInArrow(features, "lang string, place double, buckets binary, weights binary").collect()
    langs = sorted(counts)
    found: list[tuple[int, np.ndarray, np.ndarray]] = []
    for k, lang in enumerate(langs):
        own = sorted((r for r in rows if r.lang == lang), key=lambda r: (r.place, r.buckets))[:SAMPLE]
        found += [(k, np.frombuffer(r.buckets, np.uint16).astype(np.int64), np.frombuffer(r.weights, np.float32).astype(np.float64)) for r in own]
    held = [x for i, x in enumerate(found) if i % CALIBRATION == 0]
    out = Classifier(langs, idf)
    out.fit([x for i, x in enumerate(found) if i % CALIBRATION] or found)
    out.calibrate(held)
    return out


def identify(docs: DataFrame, learned: Classifier | None) -> DataFrame:
    """docs(doc_id, text): held_out, lang_pred and score per row. Null, empty and letterless texts are `und` with score 0, as are all
    texts where nothing was learned. The prediction is the text's alone, so repeated rows give repeated results; only held_out looks at
    doc_id, and a null one isn't held out."""
    state = None if learned is None else (learned.langs, learned.idf, learned.w, learned.temperature)
    shared = docs.sparkSession.sparkContext.broadcast(state)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        if shared.value is not None:
            model = Classifier.__new__(Classifier)
            model.langs, model.idf, model.w, model.temperature = shared.value
        for b in batches:
            texts = column(b, "text")
            lang, score = [UNDETERMINED] * len(texts), [0.0] * len(texts)
            if model is not None:
                for some in chunks([t if t and LETTER.search(t) else None for t in texts]):
                    for i, k, p in zip(some, *model.predict([texts[i] for i in some]), strict=True):
                        lang[i], score[i] = k, p
            yield batch_of(["doc_id", "held_out", "lang_pred", "score"], [column(b, "doc_id"), column(b, "held_out"), lang, score], [pa.int64(), pa.bool_(), pa.string(), pa.float64()])

    return docs.select("doc_id", "text", held_out(docs)).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def held_out(docs: DataFrame) -> Column:
    """crc32 of doc_id as text leaves 2 by 4; a null doc_id is not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False)).alias("held_out")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`identify` on all documents, by what those that aren't held out teach. Rows with a null lang teach nothing but are predicted; an
    empty table gives no row."""
    docs = bounded(table(spark, sf_dir, "documents")).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    return identify(docs.select("doc_id", "text"), train(docs.where(~held_out(docs))))
