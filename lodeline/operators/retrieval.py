"""Passages, inverted index, lexical and vector search, channel merge and selection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeline.functions import text as T

PASSAGE_LIMIT = 1200


#: Rows of a side that is broadcast, at most.
FEW = 100_000


def few(df: DataFrame, limit: int = FEW) -> DataFrame:
    """Hint a broadcast after counting up to the limit; beyond it the join shuffles."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def passages(docs: DataFrame, limit: int = PASSAGE_LIMIT) -> DataFrame:
    """(doc_id, idx, text): sentence idx with the one before it, alone if both are too long. A document's
    sentences stay in one array, so nothing is shuffled; explode(array(...)) computes the array once a row."""
    each = F.filter(F.transform(T.sentences(F.col("text")), lambda x, i: F.struct(i.alias("idx"), x.alias("s"))), lambda e: F.trim(e["s"]) != "")
    listed = docs.select("doc_id", F.explode(F.array(each)).alias("e"))

    def pair(e, j):
        both = F.concat(F.get("e", j - 1)["s"], e["s"])
        return F.struct(e["idx"].alias("idx"), F.when(F.length(both) <= limit, both).otherwise(e["s"]).alias("text"))

    return listed.select("doc_id", F.explode(F.transform("e", pair)).alias("p")).select("doc_id", "p.idx", "p.text")


def evidence(rows: DataFrame, locator: list[str], text, distance, needed: str, excerpt: int = 500) -> DataFrame:
    """rows with locator, excerpt and score = 1 / (1 + distance); rows without the needed column are skipped."""
    found = {"locator": F.concat_ws(", ", *locator), "excerpt": F.substring(text, 1, excerpt), "score": F.bround(1 / (1 + distance), 4)}
    return rows.where(F.col(needed).isNotNull()).withColumns(found)


def postings(rows: DataFrame) -> DataFrame:
    """(term, doc_id, idx), once per passage."""
    return rows.select("doc_id", "idx", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("term"))


def inverse_frequencies(hits: DataFrame, n: DataFrame) -> DataFrame:
    """(term, df, idf) with idf = ln(1 + (N + 0.5) / (df + 0.5)); n has one row, N."""
    return hits.groupBy("term").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(n)).select("term", "df", F.log1p((F.col("N") + 0.5) / (F.col("df") + 0.5)).alias("idf"))


def lexical_scores(rows: DataFrame, query_terms: DataFrame) -> DataFrame:
    """(query_id, doc_id, idx, score): sum of weight x idf over the query's terms in a passage.

    query_terms (query_id, term, weight) is broadcast if it is few() rows; postings of
    other terms then never leave the scan."""
    hits = postings(rows).join(few(query_terms.select("term").distinct()), "term", "left_semi")
    idf = inverse_frequencies(hits, rows.agg(F.count(F.lit(1)).alias("N")))
    found = hits.join(few(query_terms.join(idf, "term")), "term")
    return found.groupBy("query_id", "doc_id", "idx").agg(F.round(F.sum(F.col("weight") * F.col("idf")), 6).alias("score"))


def top_k(rows: DataFrame, by: str, order: list, k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each group in a total order."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(by).orderBy(*order)).cast("long")).where(F.col(name) <= k)


def vector_top_k(vectors: DataFrame, queries: DataFrame, k: int, block: int = 512) -> DataFrame:
    """(query_id, vec_id, distance, rank): exact squared-L2 neighbours of each query.

    Both sides are packed into blocks; every pair of a query block and a vector
    block is one matrix product that returns k rows per query at most."""

    def packed(df, name, id_column):
        numbered = df.select(F.col(id_column).cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
        grouped = numbered.groupBy(F.pmod(F.xxhash64("id"), F.greatest(F.lit(1), F.ceil(F.lit(df.count() / block)).cast("int"))).alias("b"))
        return grouped.agg(F.collect_list(F.struct("id", "v")).alias(name)).drop("b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                q, v = batch.column(0)[i].values, batch.column(1)[i].values
                unpack = lambda x: (x.field(0).to_numpy(), np.stack(x.field(1).to_numpy(zero_copy_only=False)))
                (qi, qv), (vi, vv) = unpack(q), unpack(v)
                rows_q, rows_v, rows_d = [], [], []
                for j in range(len(qi)):
                    d = np.round(((vv - qv[j]) ** 2).sum(axis=1), 6)
                    d[vi == qi[j]] = np.inf
                    best = np.lexsort((vi, d))[:k]
                    best = best[np.isfinite(d[best])]
                    rows_q.append(np.full(len(best), qi[j]))
                    rows_v.append(vi[best])
                    rows_d.append(d[best])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (rows_q, rows_v, rows_d)], names=["query_id", "vec_id", "distance"])

    pairs = packed(queries, "q", "vec_id").crossJoin(packed(vectors, "v", "vec_id"))
    return top_k(pairs.mapInArrow(run, "query_id long, vec_id long, distance double"), "query_id", ["distance", "vec_id"], k)


def index_vectors(vectors: DataFrame, cells: int = 64, sample: int = 20_000, rounds: int = 8, seed: int = 3) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, embedding, cell) of every vector, and the centres of the cells. The centres are fitted by k-means to a
    bounded sample, the `sample` vectors with the least hash of their id; every row is assigned to its nearest centre."""
    taken = vectors.select("vec_id", "embedding").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toArrow()
    rows = np.array(taken["embedding"].to_pylist(), float)
    centres = rows[np.random.default_rng(seed).permutation(len(rows))[: min(cells, len(rows))]] if len(rows) else np.zeros((0, 0))
    for _ in range(rounds if len(rows) else 0):
        mine = np.argmin((rows**2).sum(1)[:, None] - 2 * rows @ centres.T + (centres**2).sum(1), axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, mine, rows)
        n = np.bincount(mine, minlength=len(centres))[:, None]
        centres = np.where(n > 0, sums / np.maximum(n, 1), centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), float).reshape(batch.num_rows, -1)
            near = np.argmin((x**2).sum(1)[:, None] - 2 * x @ centres.T + (centres**2).sum(1), axis=1) if batch.num_rows else np.empty(0, int)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near.astype(np.int32))], names=["vec_id", "embedding", "cell"])

    typed = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    return typed.mapInArrow(run, "vec_id long, embedding array<double>, cell int"), centres


def probe_index(index: DataFrame, centres: np.ndarray, queries: DataFrame, k: int, probes: int = 40) -> DataFrame:
    """(query_id, vec_id, distance, rank): the nearest vectors in the `probes` cells nearest to each query. A join on
    the cell, split further by a hash of the vectors, so cost grows with a cell's share and no cell is one task."""

    def cells_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), float).reshape(batch.num_rows, -1)
            if batch.num_rows:
                order = np.argsort((x**2).sum(1)[:, None] - 2 * x @ centres.T + (centres**2).sum(1), axis=1, kind="stable")[:, :probes]
                rows = pa.array(np.repeat(np.arange(batch.num_rows), order.shape[1]))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(order.reshape(-1).astype(np.int32))], names=["query_id", "q", "cell"])

    asked = queries.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).mapInArrow(cells_of, "query_id long, q array<double>, cell int")
    distance = F.aggregate(F.zip_with("q", "embedding", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, b: a + b)
    met = asked.join(index, "cell").where("vec_id <> query_id").select("query_id", "vec_id", F.round(distance, 6).alias("distance"))
    return top_k(met, "query_id", ["distance", "vec_id"], k)


def merge_channels(semantic: DataFrame, lexical: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer merge: semantic rows first in their order, then lexical ones; ranks from 1."""
    both = semantic.join(lexical, keys, "full_outer")
    order = [F.col("vector_rank").asc_nulls_last(), F.col("lexical_rank").asc_nulls_last(), *keys[1:]]
    return both.withColumn("merged_rank", F.row_number().over(Window.partitionBy(keys[0]).orderBy(*order)).cast("long"))


def pool_lexical(rows: DataFrame) -> DataFrame:
    """Pool-relative lexical strength: 0.6 s / (s + median) + 0.4 rank percentile, ties sharing the best rank."""
    pool = Window.partitionBy("query_id")
    ranked = rows.withColumn("rank", F.rank().over(pool.orderBy(F.desc("score"))).cast("long"))
    percent = (F.count(F.lit(1)).over(pool) - F.col("rank") + 1) / F.count(F.lit(1)).over(pool)
    middle = F.median("score").over(pool)
    return ranked.select("*", F.round(0.6 * F.col("score") / (F.col("score") + middle) + 0.4 * percent, 6).alias("strength"))


def diversify(rows: DataFrame, family: str) -> DataFrame:
    """The best of each family first, then the rest, each in rank order."""
    first = F.row_number().over(Window.partitionBy("query_id", family).orderBy("rank")) == 1
    marked = rows.withColumn("pass", F.when(first, 1).otherwise(2))
    return marked.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("pass", "rank")).cast("long"))


def select_spans(rows: DataFrame, k: int) -> DataFrame:
    """Greedy selection in rank order with a reason for each candidate: a pool has at
    most a few hundred rows, so each query is one pandas group.

    rows: (query_id, source, start, stop, score, rank)."""

    def run(pool: pd.DataFrame) -> pd.DataFrame:
        pool = pool.sort_values("rank").reset_index(drop=True)
        seen, taken, reasons = set(), [], []
        for r in pool.itertuples():
            if (r.source, r.start, r.stop) in seen:
                reasons.append("EXACT_DUPLICATE")
                continue
            seen.add((r.source, r.start, r.stop))
            if r.score <= 0:
                reasons.append("LOW_RERANK_SCORE")
            elif any(s == r.source and max(a, r.start) < min(b, r.stop) for s, a, b in taken):
                reasons.append("OVERLAP_EVICTION")
            elif len(taken) >= k:
                reasons.append("TOP_K_TRUNCATION")
            else:
                taken.append((r.source, r.start, r.stop))
                reasons.append("SELECTED")
        return pool.assign(reason=reasons)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", reason string"
    return rows.groupBy("query_id").applyInPandas(run, schema)
