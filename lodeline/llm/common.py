"""Helpers that the training-data operators share.

Nothing outside this subpackage imports it, and it imports nothing from the
rest of the library.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only up to this many rows of at most 64 bytes (32 MB).
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 1 << 25

#: Whitespace of the word pattern [^\x20\x09-\x0D]+; bytes.split() uses the same six bytes.
SPACES = b" \t\n\r\x0b\x0c"
WORD = "[^\\x20\\x09-\\x0D]+"

FINGERPRINT_WORDS = 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared folder; make one only for a local session that has none."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    shared = context.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="lodeline-checkpoint-")
    context.setCheckpointDir(shared)


def checkpoint(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and cut its lineage there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small(df: DataFrame, limit: int = BROADCAST_ROWS, unique: bool = False) -> DataFrame:
    """Hint a broadcast after counting df; beyond the limit the join shuffles. `unique`: df has few bytes
    and one row for each key, so that its partitions are held in hash tables and the other side isn't sorted."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df.hint("shuffle_hash") if unique else df


def small_arrays(df: DataFrame, array: str, each: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """small() for rows with an array: by the bytes of the rows, 24 besides the array, `each` an element."""
    size = df.agg(F.sum(24 + F.size(array) * each)).first()[0] or 0
    return F.broadcast(df) if size <= limit else df


_live: dict[str, object] = {}


def worker_cache(name: str, make: Callable[[], object]):
    """What the named operator keeps in this Python worker. Workers are reused from stage to
    stage: another operator's cache is dropped first, so that a worker never holds two."""
    if name not in _live:
        _live.clear()
        gc.collect()
        release()
        _live[name] = make()
    return _live[name]


def release() -> None:
    """Give memory that is free in this process back to the machine."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def lean(run: Callable) -> Callable:
    """A function over record batches whose worker gives its free memory back when the task ends:
    workers outlive their tasks, and several share an executor."""

    @wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def text_batches(df: DataFrame, rows: int = 500) -> DataFrame:
    """df, whose session passes texts to Python in batches of so many rows unless it has a setting of its own."""
    name, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession.conf
    if conf.get(name) == "10000":  # Spark's default
        conf.set(name, str(rows))
    return df


def as_bytes(text: str = "text"):
    """The whole text as UTF-8 bytes, empty for null."""
    return F.coalesce(F.col(text).cast("binary"), F.lit(b""))
