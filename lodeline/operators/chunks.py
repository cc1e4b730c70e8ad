"""Chunkers, document profiles and corpus audits."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeline.functions import text as T

SIZE, OVERLAP = 4000, 600


def chunks(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, start, end, chunk_id, text): fixed windows without white space at their ends; the id is of source, untrimmed start and text."""
    step = max(1, size - min(overlap, size // 4))
    rows = docs.where("length(text) > 0").select("doc_id", "text", F.explode(F.sequence(F.lit(0), F.length("text") - 1, F.lit(step))).alias("start"))
    part = T.strip(F.substr("text", F.col("start") + 1, F.lit(size)))
    end = F.least(F.length("text"), F.col("start") + size)
    rows = rows.select("doc_id", F.col("start").cast("long").alias("start"), end.cast("long").alias("end"), part.alias("text")).where("text <> ''")
    return rows.withColumn("chunk_id", F.substring(F.sha2(F.concat_ws(":", "doc_id", "start", "text"), 256), 1, 24))


def nearest_rank(values: Column, p: float) -> Column:
    """The element at round_half_even((n - 1) p) of the sorted values."""
    return F.element_at(F.sort_array(values), (F.bround((F.size(values) - 1) * p) + 1).cast("int"))


def profile(parts: DataFrame, by: str, oversized: int = SIZE) -> DataFrame:
    """Chunk counts and length statistics of each group. A group's lengths are kept as
    counts per length (at most `oversized` + 1 values), not as a list of rows."""
    sized = parts.select(by, "chunk_id", F.length("text").cast("long").alias("n"))
    counted = sized.groupBy(by, "n").agg(F.count(F.lit(1)).alias("c"))
    ranked = counted.groupBy(by).agg(F.sum("c").alias("chunks"), F.min("n").alias("shortest"), F.max("n").alias("longest"), F.sum(F.when(F.col("n") > oversized, F.col("c")).otherwise(0)).alias("oversized"), F.array_sort(F.collect_list(F.struct("n", "c"))).alias("h"))
    at = lambda p: F.aggregate(
        "h",
        F.struct(F.bround((F.col("chunks") - 1) * F.lit(p)).cast("long").alias("left"), F.lit(None).cast("long").alias("n")),
        lambda a, x: F.struct((a["left"] - x["c"]).alias("left"), F.when((a["left"] >= 0) & (a["left"] < x["c"]), x["n"]).otherwise(a["n"]).alias("n")),
        lambda a: a["n"],
    )
    ids = sized.groupBy(by, "chunk_id").count().groupBy(by).agg(F.sum(F.col("count") - 1).alias("duplicate_ids"))
    return ranked.select(by, "chunks", "shortest", at(0.5).alias("middle"), at(0.95).alias("p95"), "longest", "oversized").join(ids, by)


def sentence_boundaries(text: str) -> list[int]:
    """Places after which a sentence may begin; a full stop after an abbreviation, an initial or a numeral is none."""
    out = []
    for m in re.finditer(T.BREAK, text):
        if text[m.start()] != "." or not re.search(T.ABBREVIATED.replace(r"\z", r"\Z"), text[max(0, m.start() - 64) : m.start() + 1]):
            out.append(m.end())
    return out if out and out[-1] == len(text) else [*out, len(text)]


def sentence_windows(text: str, size: int = SIZE) -> Iterator[tuple[int, int, str]]:
    """Disjoint (start, end, fallback) that cover a section: up to the last boundary within the size if that is at
    least 65 % of it, else up to a boundary within 125 %, else a shorter cut, else one inside the sentence."""
    ends, start, least = sentence_boundaries(text), 0, 0.65 * size
    while start < len(text):
        cut, how = len(text), ""
        if cut - start > size:
            k = bisect_right(ends, start + size)
            before, after = ends[k - 1] if k else start, ends[k] if k < len(ends) else len(text)
            if before - start >= least and before > start:
                cut = before
            elif after - start <= 1.25 * size:
                cut = after
            elif before > start:
                cut = before
            else:
                inner = [m.end() for m in re.finditer(r"[;:,]\s+", text[start : start + size]) if m.end() >= least]
                space = text.rfind(" ", start + max(1, int(least)), start + size + 1)
                cut, how = (start + inner[-1], "secondary_punctuation") if inner else (space + 1 if space >= 0 else start + size, "raw")
        yield start, cut, how
        start = cut


def section_chunks(sections: DataFrame, size: int = SIZE, overlap: int = OVERLAP, by_sentence: bool = True) -> DataFrame:
    """(document_id, spine_item, section_index, start, end, chunk_id, fallback, text) of sections (document_id,
    spine_item, section_index, text): windows that never cross a section, in one pass without a shuffle."""
    step = max(1, size - min(overlap, size // 4))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for document, spine, section, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text = text or ""
                for start, end, how in sentence_windows(text, size) if by_sentence else ((i, i + size, "") for i in range(0, len(text), step)):
                    raw = text[start:end]
                    part = raw.strip()
                    if not part:
                        continue
                    first = start + (len(raw) - len(raw.lstrip()) if by_sentence else 0)
                    ident = f"{document}:{spine}:{section}:{first}:{first + len(part)}:{part}"
                    rows.append((document, spine, section, first, first + len(part), hashlib.sha256(ident.encode()).hexdigest()[:32], how, part))
            if rows:
                kinds = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["document_id", "spine_item", "section_index", "start", "end", "chunk_id", "fallback", "text"])

    found = sections.select(F.col("document_id").cast("string"), F.col("spine_item").cast("string"), F.col("section_index").cast("int"), "text")
    return found.mapInArrow(run, "document_id string, spine_item string, section_index int, start long, end long, chunk_id string, fallback string, text string")


def page_chunks(pages: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Fixed windows of cleaned pages (source_file, page_number, book, chapter, text); what isn't known is "unknown"."""
    known = lambda c: F.coalesce(F.col(c), F.lit("unknown")).alias(c)
    parts = chunks(pages.select(F.concat_ws("\t", "source_file", F.col("page_number").cast("string"), known("book"), known("chapter")).alias("doc_id"), T.clean(F.col("text")).alias("text")), size, overlap)
    at = F.split("doc_id", "\t")
    ident = F.substring(F.sha2(F.concat_ws(":", at[0], "start", "text"), 256), 1, 24)
    return parts.select(at[0].alias("source_file"), at[1].cast("int").alias("page_start"), at[1].cast("int").alias("page_end"), at[2].alias("book"), at[3].alias("chapter"), "start", ident.alias("chunk_id"), "text")
