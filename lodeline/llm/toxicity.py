"""Toxicity scores by FTRL-proximal logistic regression.

Features are the distinct word unigrams, bigrams and skip-grams (one word
skipped) of a whole text, hashed into 2**BITS buckets with value 1. Unigrams are
taken of whole words and of stems (first STEM code points; separate features for
stems that occur once, twice and three times), which covers inflected forms. FTRL keeps
per-coordinate learning rates and L1 sets most weights to exactly zero, so the
broadcast model is the nonzero weights, at most 2**BITS of 8 bytes.

Training reads a bounded sample: the SAMPLE labelled documents with the least
hash of their id, and of these as many as have SAMPLE_BYTES of features together
(documented bounds), featurised in parallel, in one task that makes EPOCHS passes
in that order. Scoring covers every row and needs no shuffle.

Defined cases: null and empty texts have only the bias. Repeated labels of a
document count once (toxic wins); labels that are null or neither 0 nor 1 are
not used. Of repeated rows of a labelled document the least text is trained on;
all are scored. With no usable label every score is 0.
Rows with a null doc_id are scored and not held out. Other columns, clashing
names among them, pass through drop_toxic() untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, lean, table, text_batches, worker_cache

BITS = 20
SAMPLE = 20_000
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.5, 1.0, 3.0, 0.1
FOLDS = 5
#: Words whose hashes a worker keeps, and the bytes of the longest.
CACHE, LONGEST = 200_000, 64
#: Bytes of features that are trained on; documents of the sample beyond them are left out.
SAMPLE_BYTES = 1 << 27

#: Code points of a stem, and how often a stem must occur for each of its features.
STEM = 5
TIMES = (1, 2, 3)

def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of each word and of its stem, A-Z lower-cased, without punctuation at the ends."""
    known, digest = worker_cache("toxicity", dict), xxhash.xxh64_intdigest
    if len(known) > CACHE:
        known.clear()
    out = []
    for w in data.lower().split():
        h = known.get(w)
        if h is None:
            bare = w.strip(b".,;:!?\"'()[]{}*#$%&<>|-") or w
            h = digest(bare), digest(bare.decode(errors="replace")[:STEM].encode(), 1)
            if len(w) <= LONGEST:
                known[w] = h
        out.append(h)
    both = np.array(out, dtype=np.uint64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def features(data: bytes, bits: int = BITS) -> np.ndarray:
    """Sorted distinct buckets of the unigrams (words, and stems by how often they occur), bigrams and skip-grams."""
    h, stems = word_hashes(data)
    down = np.uint64(64 - bits)
    first, second, skip = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
    parts = [h >> down]
    distinct, counts = np.unique(stems, return_counts=True)
    for times in TIMES:
        parts.append(distinct[counts >= times] * np.uint64(2 * times + 1) >> down)
    for gap, mix in ((1, second), (2, skip)):
        if len(h) > gap:
            x = (h[:-gap] * first) ^ (h[gap:] * mix)
            parts.append((x ^ (x >> np.uint64(29))) * first >> down)
    found = np.concatenate(parts).astype(np.uint32)
    found.sort()
    return found[np.r_[True, found[1:] != found[:-1]]] if len(found) else found


def train(rows: list[tuple[np.ndarray, int]], bits: int = BITS, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal over (features, label) rows -> nonzero (index, weight); the
    index 2**bits is the bias, which L1 does not touch."""
    size = 1 << bits
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    l1 = np.full(size + 1, L1)
    l1[size] = 0.0

    def weights(i):
        zi = z[i]
        w = -(zi - np.sign(zi) * l1[i]) / ((BETA + np.sqrt(n[i])) / ALPHA + L2)
        w[np.abs(zi) <= l1[i]] = 0.0
        return w

    for _ in range(epochs):
        for index, label in rows:
            i = np.append(index, size)
            w = weights(i)
            g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - label
            g2 = g * g
            sigma = (np.sqrt(n[i] + g2) - np.sqrt(n[i])) / ALPHA
            z[i] += g - sigma * w
            n[i] += g2
    every = np.arange(size + 1)
    w = weights(every)
    kept = np.flatnonzero(w)
    return kept.astype(np.int64), w[kept]


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The bounded sample: (data, toxic, rank, doc_id) of labelled documents outside the held-out fold, a row each."""
    usable = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where(f"toxic in (0, 1) and doc_id is not null and crc32(cast(cast(doc_id as string) as binary)) % {FOLDS} <> 0")
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .withColumn("rank", F.xxhash64("doc_id"))
    )
    chosen = usable.orderBy("rank", "doc_id").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), as_bytes().alias("data"))
    return texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic", "rank").agg(F.min("data").alias("data")).select("data", "toxic", "rank", "doc_id")  # broadcasts at most `sample` rows


@lean
def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [features(x.as_py()).tobytes() for x in batch.column(0)]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), *batch.columns[1:]], names=["found", "toxic", "rank", "doc_id"])


def bounded(batches: Iterator[pa.RecordBatch], most: int = SAMPLE_BYTES) -> list[tuple[np.ndarray, int]]:
    """(features, label) of the first rows that hold at most so many bytes together; the first row always."""
    rows, held = [], 0
    for batch in batches:
        for found, label in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            data = found.as_py()
            held += len(data)
            if rows and held > most:
                return rows
            rows.append((np.frombuffer(data, np.uint32), label))
    return rows


@lean
def _train_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = bounded(batches)
    for _ in batches:  # what is beyond the bound is read to the end
        pass
    if rows:
        index, weight = train(rows)
        yield pa.RecordBatch.from_arrays([pa.array(index), pa.array(weight)], names=["index", "weight"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict[str, np.ndarray]:
    """index and weight of the nonzero weights; empty if no label can be used."""
    rows = text_batches(training_rows(docs, labels, sample)).mapInArrow(_featurise, "found binary, toxic int, rank long, doc_id long")
    model = rows.repartition(1).sortWithinPartitions("rank", "doc_id").mapInArrow(_train_task, "index long, weight double").toArrow()  # at most 2**BITS + 1 rows
    return {"index": model["index"].to_numpy(), "weight": model["weight"].to_numpy()} if model.num_rows else {}


class Scorer:
    def __init__(self, model: dict[str, np.ndarray], bits: int = BITS) -> None:
        self.known = bool(model)
        weights = np.zeros((1 << bits) + 1, np.float32)
        if self.known:
            weights[model["index"]] = model["weight"]
        self.weights, self.bias = weights[:-1], float(weights[-1])

    def __call__(self, data: bytes | None) -> float:
        if not self.known:
            return 0.0
        total = self.bias + float(self.weights[features(data or b"")].sum(dtype=np.float64))
        return float(1.0 / (1.0 + np.exp(-np.clip(total, -35, 35))))


def scores(docs: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(shared.value)
        for batch in batches:
            found = [score(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.float64()), pa.array([int(s >= 0.5) for s in found], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    fold = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % FOLDS == 0
    rows = text_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold, F.lit(False)).alias("held_out"), as_bytes().alias("data"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows predicted toxic, all columns kept, without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    at = docs.columns.index("text")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(shared.value)
        for batch in batches:
            keep = [score((x.as_py() or "").encode()) < 0.5 for x in batch.column(at)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return text_batches(docs).mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scores(docs, fit(docs, table(spark, sf_dir, "labels")))
