"""Token counts by heap-and-linked-list byte-pair merging.

A text's symbols form a linked list; a heap holds the adjacent pairs that the
vocabulary can join, lowest rank first and leftmost on ties. Each pop merges
one pair, so the count is the number of initial symbols minus the merges, and
no identifier is ever made. A character without a piece stays alone and counts
as its UTF-8 bytes. No piece has a space mark after another character, and
characters without a piece never merge, so texts are cut there first and counts
of the segments are kept in a bounded cache: whole texts, linear time.

Defined cases: null and empty texts have 0 bytes and 0 tokens; rows that repeat
each come back; doc_id may be null; other columns are not read.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, table, text_batches, worker_cache

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
#: Segments whose counts a worker keeps, and the code points of the longest; beyond it the cache starts again.
CACHE, LONGEST = 400_000, 63
MARK = "▁"
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class PairMerger:
    """Counts the tokens of a byte-fallback BPE model from its pieces' ranks."""

    def __init__(self, ranks: dict[str, float], dummy_prefix: bool = True) -> None:
        self.ranks, self.prefix = ranks, MARK if dummy_prefix else ""
        self.cache: dict[str, int] = {}
        if any(MARK in p.lstrip(MARK) for p in ranks):
            raise ValueError("the model joins pieces across space marks")
        self.cuts = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n")

    def merged(self, text: str) -> int:
        """Initial symbols minus merges."""
        ranks, n = self.ranks, len(text)
        symbols = [*text]
        count = sum(1 if c in ranks else len(c.encode()) for c in symbols)
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        heap = [(rank, i, text[i : i + 2]) for i in range(n - 1) if (rank := ranks.get(text[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i]
            if symbols[i] is None or j >= n or symbols[i] + symbols[j] != pair:
                continue
            symbols[i], symbols[j] = pair, None
            count -= 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (rank := ranks.get(new := pair + symbols[k])) is not None:
                    heapq.heappush(heap, (rank, i, new))
            if (h := before[i]) >= 0 and (rank := ranks.get(new := symbols[h] + pair)) is not None:
                heapq.heappush(heap, (rank, h, new))
        return count

    def count(self, text: str) -> int:
        if not text:
            return 0
        cache, total = self.cache, 0
        if len(cache) > CACHE:
            cache.clear()
        for part in self.cuts.findall(self.prefix + text.replace(" ", MARK)):
            n = cache.get(part)
            if n is None:
                n = self.merged(part)
                if len(part) <= LONGEST:
                    cache[part] = n
            total += n
        return total


def _load(path: str) -> PairMerger:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    usable = (i for i in range(model.get_piece_size()) if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i)))
    return PairMerger({model.id_to_piece(i): -model.get_score(i) for i in usable})


def merger(path: str) -> PairMerger:
    return worker_cache(f"tokens {path}", lambda: _load(path))


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of docs.

    path: the model's file, present on every executor; None: the public one.
    """

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = merger(path or public_path(MODEL)).count
        for batch in batches:
            sizes, counts = [], []
            for x in batch.column(1):
                text = x.as_py() or ""
                sizes.append(len(text.encode()))
                counts.append(count(text))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return text_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
