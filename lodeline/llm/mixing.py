"""Mixing sources to target weights by blocks, multinomial draws and permutations.

The words of each source form one stream (documents ordered by hash bucket and
id) that is cut into blocks of BLOCK words. The mix is a row of output shards of
SHARD slots. Source counts are drawn from multinomials over what the sources'
quotas still hold, halving the row down to single shards, so quotas are met exactly. The k-th slot
of a source in pass e (k divided by the number of its blocks) takes the block at
place k of that pass's pseudorandom permutation of the source's block numbers;
slots and documents meet in a join on (source, block). Quotas are in words: a
source gets as many slots as its target needs, its last block's length counted
where it falls, and of its last slot only the words still missing.

Prefix sums are taken per (source, hash bucket) and then over the buckets'
totals, and the join key holds the block, so a source with most rows is spread.
The driver sees one row per source (about 100 bytes each), no documents; each task
draws the counts of its own shards.

Defined cases: a null or empty text has size 0 and takes nothing; a null source
is a source of its own, last; a null doc_id orders first; repeated rows are
documents of their own; a table without words has all targets 0.
Other columns are not read, and mix() carries them, clashing names included.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, checkpoint, lean, small, table, text_batches, worker_cache

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
BLOCK = 128
SHARD = 65_536
BUCKETS = 1024
SEED = 7
ROUNDS = 6


def targets(sizes: list[int], share: float = SHARE, most: float = MOST) -> list[float]:
    """Words for each source: share of all words by weight, none above most times
    its size, the excess reshared by weight among the others."""
    weights = [WEIGHTS[i % len(WEIGHTS)] for i in range(len(sizes))]
    out, left, free = [0.0] * len(sizes), share * sum(sizes), [*range(len(sizes))]
    while free:
        unit = left / sum(weights[i] for i in free)
        full = [i for i in free if weights[i] * unit > most * sizes[i]]
        if not full:
            for i in free:
                out[i] = weights[i] * unit
            break
        for i in full:
            out[i] = most * sizes[i]
            left -= out[i]
        free = [i for i in free if i not in full]
    return out


def _mixed(right: np.ndarray, key: np.uint64, mask: np.uint64) -> np.ndarray:
    mixed = (right + (key >> np.uint64(7))) * key
    return (mixed ^ (mixed >> np.uint64(31))) & mask


def _network(n: int, seed: int) -> tuple[np.uint64, np.uint64, np.ndarray]:
    half = np.uint64(max(1, ((n - 1).bit_length() + 1) // 2))
    return half, np.uint64((1 << int(half)) - 1), np.random.default_rng(seed).integers(1, 1 << 63, ROUNDS, dtype=np.uint64) | np.uint64(1)


def permute(k: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Places k of a pseudorandom permutation of range(n): a Feistel network with cycle walking."""
    half, mask, keys = _network(n, seed)
    out, todo = np.array(k, np.uint64), np.arange(len(k))
    while len(todo):
        x = out[todo]
        left, right = x >> half, x & mask
        for key in keys:
            left, right = right, left ^ _mixed(right, key, mask)
        out[todo] = (left << half) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def place_of(value: int, n: int, seed: int) -> int:
    """The place k at which permute() has the value: the network backwards."""
    half, mask, keys = _network(n, seed)
    x = np.array([value], np.uint64)
    while True:
        left, right = x >> half, x & mask
        for key in keys[::-1]:
            left, right = right ^ _mixed(left, key, mask), left
        x = (left << half) | right
        if x[0] < n:
            return int(x[0])


def quota(words: int, size: int, block: int, source: int, seed: int = SEED) -> tuple[int, int]:
    """(slots, words to leave of the last slot's block) with which a source of `size` words gives `words`."""
    if not words:
        return 0, 0
    n = -(-size // block)
    turn, rest = divmod(words, size)
    if not rest:
        return turn * n, 0
    lacks, at = n * block - size, place_of(n - 1, n, (seed, source, turn))
    held = lambda m: m * block - (lacks if at < m else 0)
    slots = -(-rest // block)
    if held(slots) < rest:
        slots += 1
    return turn * n + slots, held(slots) - rest


def split(left: np.ndarray, take: int, rng: np.random.Generator) -> np.ndarray:
    """`take` slots out of `left` by source: multinomial, none overdrawn."""
    got = np.zeros_like(left)
    while (need := take - got.sum()) > 0:
        room = left - got
        got += np.minimum(rng.multinomial(need, room / room.sum()), room)
    return got


def draws(quotas: list[int], first: int, last: int, shard: int = SHARD, seed: int = SEED) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(slots before, slots) by source for the output shards first to last - 1.

    The quotas are halved down a binary tree over the shards, every node with a seed
    of its own, so any task draws any range of shards in the tree's depth."""
    every = np.array(quotas, np.int64)

    def walk(a: int, b: int, left: np.ndarray, before: np.ndarray):
        if b <= first or a >= last:
            return
        if b - a == 1:
            yield before, left
            return
        mid = (a + b) // 2
        got = split(left, (mid - a) * shard, np.random.default_rng((seed, a, b)))
        yield from walk(a, mid, got, before)
        yield from walk(mid, b, left - got, before + got)

    yield from walk(0, shards(quotas, shard), every, np.zeros_like(every))


def shards(quotas: list[int], shard: int = SHARD) -> int:
    return -(-sum(quotas) // shard)


def draw(quotas: list[int], shard: int = SHARD, seed: int = SEED) -> np.ndarray:
    """Source counts of every output shard."""
    rows = [got for _, got in draws(quotas, 0, shards(quotas, shard), shard, seed)] if sum(quotas) else []
    return np.array(rows, np.int64).reshape(len(rows), len(quotas))


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, key, source, size) for every row of docs."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64("text").alias("key"),
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )


def _slots(given: list[tuple[int, int]], blocks: list[int], shard: int = SHARD):
    """The slots of the shards whose numbers come in: (source_no, block, turn, leaves)."""
    quotas = [slots for slots, _ in given]

    def of(source: int, first: int, count: int) -> Iterator[pa.RecordBatch]:
        (slots, leaves), n = given[source], blocks[source]
        k = np.arange(first, first + count, dtype=np.int64)
        for turn in np.unique(k // n):
            some = k[k // n == turn] % n
            found = permute(some, n, (SEED, source, int(turn)))
            left = np.where((some == (slots - 1) % n) & (turn == (slots - 1) // n), leaves, 0)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), source, np.int32)), pa.array(found), pa.array(np.full(len(found), turn, np.int32)), pa.array(left)], names=["source_no", "block", "turn", "leaves"])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("mixing", dict)  # drops what earlier stages keep
        for batch in batches:
            numbers = batch.column(0).to_numpy()
            for run_of in np.split(numbers, np.flatnonzero(np.diff(numbers) != 1) + 1):
                if len(run_of):
                    for before, got in draws(quotas, int(run_of[0]), int(run_of[-1]) + 1, shard):
                        for source in np.flatnonzero(got).tolist():
                            yield from of(source, int(before[source]), int(got[source]))

    return run


def plan(docs: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(rows, takes). rows: every row of docs with row, source_size and target;
    takes: (row, turn, first, last), the word spans of a document that the mix holds."""
    spark = docs.sparkSession
    held = checkpoint(sizes(docs)).withColumn("row", F.monotonically_increasing_id())
    found = held.groupBy("source").agg(F.sum("size").alias("size")).collect()  # one row per source
    found.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    source_sizes = [r["size"] for r in found]
    goal = targets(source_sizes)
    blocks = [-(-n // block) for n in source_sizes]
    given = [quota(min(round(t), int(MOST * n)), n, block, i) for i, (t, n) in enumerate(zip(goal, source_sizes, strict=True))]
    info = spark.createDataFrame([(r["source"], i, r["size"], float(t)) for i, (r, t) in enumerate(zip(found, goal, strict=True))], "source string, source_no int, source_size long, target double")
    number = shards([slots for slots, _ in given])
    slots = spark.range(0, number, 1, max(1, min(number, spark.sparkContext.defaultParallelism * 8))).mapInArrow(_slots(given, blocks), "source_no int, block long, turn int, leaves long")

    rows = held.join(small(info), held["source"].eqNullSafe(info["source"])).drop(info["source"])
    spread = rows.where("size > 0").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "key"), F.lit(BUCKETS)))
    totals = spread.groupBy("source_no", "bucket").agg(F.sum("size").alias("words"))
    upto = Window.partitionBy("source_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("source_no", "bucket", F.coalesce(F.sum("words").over(upto), F.lit(0)).alias("base"))
    within = Window.partitionBy("source_no", "bucket").orderBy("doc_id", "key", "row").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        spread.withColumn("start", F.coalesce(F.sum("size").over(within), F.lit(0)))
        .join(small(bases), ["source_no", "bucket"])
        .select("row", "source_no", "source_size", "size", (F.col("start") + F.col("base")).alias("start"))
    )
    parts = placed.withColumn("block", F.explode(F.expr(f"sequence(start div {block}, (start + size - 1) div {block})")))
    # The slots come from a range of shard numbers, so their size is underestimated: never broadcast them.
    # A source's last block ends with its words, so the words to leave are counted from there.
    parts = parts.withColumn("end", F.least(F.col("source_size"), (F.col("block") + 1) * block))
    takes = parts.join(slots.hint("merge"), ["source_no", "block"]).select(
        "row",
        "turn",
        F.greatest(F.lit(0), F.col("block") * block - F.col("start")).cast("long").alias("first"),
        F.least(F.col("size"), F.col("end") - F.col("leaves") - F.col("start")).alias("last"),
    )
    takes = takes.where("last > first")
    return rows, takes


def taken(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row of docs."""
    rows, takes = plan(docs, block)
    sums = takes.groupBy("row").agg(F.sum(F.col("last") - F.col("first")).alias("taken"))
    out = rows.join(sums, "row", "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


_word = re.compile("[^\x20\x09-\x0d]+")


def cut(text: str, spans: list[tuple[int, int]], size: int) -> str:
    """The words of the spans (sorted, of word numbers) with the white space inside each run of them."""
    runs: list[list[int]] = []
    for a, b in spans:
        if runs and runs[-1][1] == a:
            runs[-1][1] = b
        else:
            runs.append([a, b])
    if runs == [[0, size]]:
        return text
    at = [m.span() for m in _word.finditer(text)]
    return "\n".join(text[at[a][0] : at[b - 1][1]] for a, b in runs)


def mix(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The mixed documents with the columns of docs: a row per document and pass
    that takes words of it, its text the words taken, n_chars set anew."""
    rows, takes = plan(docs, block)
    spans = takes.groupBy("row").agg(F.collect_list(F.struct("turn", "first", "last")).alias("spans"))
    by_key = rows.join(spans, "row").groupBy("doc_id", "key").agg(F.collect_list(F.struct("row", "size", "spans")).alias("copies"))
    copies = by_key.select(F.col("doc_id").alias("__id"), F.col("key").alias("__key"), F.array_sort("copies").alias("__copies"))
    named = docs.select(F.struct("*").alias("__doc"), F.col("doc_id").cast("long").alias("__my"), F.xxhash64("text").alias("__mine"))
    joined = named.join(copies, F.col("__my").eqNullSafe(F.col("__id")) & (F.col("__mine") == F.col("__key")))
    if rows.groupBy("doc_id", "key").count().where("count > 1").limit(1).count():
        turn = Window.partitionBy("__my", "__mine").orderBy(F.xxhash64("__doc"))
        copy = F.try_element_at("__copies", F.row_number().over(turn))
    else:
        copy = F.element_at("__copies", 1)
    flat = joined.withColumn("__copy", copy).select("__doc.*", F.col("__copy.size").alias("__size"), F.col("__copy.spans").alias("__spans"))
    names, schema = docs.columns, docs.schema

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch_names = batch.schema.names
            texts = batch.column(names.index("text"))
            places, out = [], []
            for i in range(batch.num_rows):
                size = batch.column(len(names))[i].as_py()
                if size is None:
                    continue
                turns: dict[int, list] = {}
                for s in batch.column(len(names) + 1)[i].as_py():
                    turns.setdefault(s["turn"], []).append((s["first"], s["last"]))
                text = texts[i].as_py()
                for turn in sorted(turns):
                    places.append(i)
                    out.append(cut(text, sorted(turns[turn]), size))
            kept = batch.take(pa.array(places, pa.int64()))
            columns = [kept.column(i) for i in range(len(names))]
            columns[names.index("text")] = pa.array(out, texts.type)
            if "n_chars" in names:
                at = names.index("n_chars")
                columns[at] = pa.array([len(x) for x in out], pa.int64()).cast(kept.column(at).type)
            yield pa.RecordBatch.from_arrays(columns, names=batch_names[: len(names)])

    return text_batches(flat).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken(table(spark, sf_dir, "documents"))
