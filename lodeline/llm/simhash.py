"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A fingerprint has 64 bits; bit i is set if bit i is set in over half of the
XXH64 hashes (seed 42) of the text's 4-word shingles. Equal fingerprints are
joined first, so that a group of copies counts once. See hamming for the balls of
all 64 bits; each meeting is verified, and components() takes the transitive closure.

Defined cases: null and empty texts and texts of white space have fingerprint
zero and link with each other; texts of fewer than four words have one shingle,
the whole sequence. Repeated rows each come back. Rows with a null doc_id come
back too but never name a component; a component without any doc_id is null.
Other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import FINGERPRINT_WORDS, as_bytes, checkpoint, lean, small, table, text_batches, worker_cache
from .components import components
from .hamming import ball_links

RADIUS = 4
SEED = 42
#: Shingles whose bits are summed at once.
CHUNK = 1 << 15


def shingles(data: bytes, n: int = FINGERPRINT_WORDS) -> list[bytes]:
    words = data.lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= n:
        return [joined]
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    return [joined[s : e - 1] for s, e in zip(starts, ends[n - 1 :])]


def fingerprint(data: bytes, n: int = FINGERPRINT_WORDS) -> int:
    """Unsigned 64-bit fingerprint of UTF-8 bytes."""
    parts = shingles(data, n)
    if not parts:
        return 0
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, len(parts), CHUNK):
        some = parts[at : at + CHUNK]
        hashes = np.fromiter((digest(s, SEED) for s in some), np.uint64, len(some))
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(counts * 2 > len(parts), bitorder="little").view(np.uint64)[0])


@lean
def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    worker_cache("simhash", dict)  # drops what earlier stages keep
    for batch in batches:
        found = np.fromiter((fingerprint(x.as_py()) for x in batch.column(1)), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp long) for every row."""
    return text_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), as_bytes().alias("data")).mapInArrow(_fingerprints, "doc_id long, fp long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs."""
    marked = checkpoint(fingerprints(docs))
    distinct = checkpoint(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    nodes = checkpoint(components(ball_links(distinct.select("fp"), radius, distinct.count())))
    linked = nodes.join(distinct.withColumnRenamed("fp", "node"), "node")
    names = linked.groupBy("component").agg(F.min("first").alias("name"))
    named = nodes.join(names, "component").select(F.col("node").alias("fp"), "name")
    firsts = distinct.join(small(named), "fp", "left").select("fp", F.coalesce("name", "first").alias("component_id"))
    return marked.join(firsts, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """docs without all but the first document of each near-duplicate component.

    Rows with a null doc_id can't be addressed and stay; of repeated rows with
    one doc_id one stays.
    """
    found = checkpoint(near_duplicates(docs, radius))
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct()
    kept = docs.join(small(gone), F.col("doc_id").cast("long") == F.col("__gone"), "left_anti")
    if found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count():
        named, unnamed = kept.where("doc_id is not null"), kept.where("doc_id is null")
        kept = named.dropDuplicates(["doc_id"]).unionByName(unnamed)
    return kept


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
