"""Resumable micro-batch ingestion, document states and event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: A document's states and the states that may follow each; None: it is new.
ALLOWED = {
    None: ("pending",),
    "pending": ("in_progress", "failed", "stopped"),
    "in_progress": ("completed", "failed", "stopped"),
    "stopped": ("in_progress", "failed"),
    "failed": ("in_progress",),
    "completed": (),
}


def upsert_stream(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, key: str = "id", files_per_batch: int = 1) -> StreamingQuery:
    """Ingest new JSON files once each. A batch is written under its own number, so a
    batch that runs again after a failure overwrites itself; read with latest()."""

    def write(batch: DataFrame, number: int) -> None:
        last = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(F.xxhash64(F.struct("*")))))  # of rows with one key the same one in every run
        rows = batch.withColumn("__n", last).where("__n = 1").drop("__n")
        path = f"{target}/batch={number}"
        rows.write.mode("overwrite").parquet(path)
        written = batch.sparkSession.read.schema(rows.schema).parquet(path)
        if rows.select(key).join(written, key, "left_anti").limit(1).count():
            raise RuntimeError(f"batch {number}: ids are missing after the write")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(source)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, target: str, key: str = "id") -> DataFrame:
    """The rows of the target, for each key those of its last batch."""
    w = Window.partitionBy(key).orderBy(F.desc("batch"))
    return spark.read.parquet(target).withColumn("n", F.row_number().over(w)).where("n = 1").drop("n", "batch")


def illegal_changes(states: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Rows (key, state) whose state may not follow the one before."""
    before = F.lag("state").over(Window.partitionBy(key).orderBy(*order))
    known = [f"{a or ''}>{b}" for a, after in ALLOWED.items() for b in after]
    return states.withColumn("before", before).where(~F.concat(F.coalesce("before", F.lit("")), F.lit(">"), "state").isin(known))


def pending_ids(expected: DataFrame, stored: DataFrame, journal: DataFrame, key: str = "id") -> DataFrame:
    """Ids still to ingest. The journal's ids must be those of the store; anything else is an error."""
    a, b = journal.select(key).distinct(), stored.select(key).distinct()
    if a.exceptAll(b).limit(1).count() or b.exceptAll(a).limit(1).count():
        raise RuntimeError("progress_collection_mismatch")
    return expected.select(key).distinct().join(b, key, "left_anti")


def accumulate(seen: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Evidence by id, of which the new rows win; what is derived from it is derived anew."""
    return seen.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def windowed_counts(events: DataFrame, late: str = "1 hour", size: str = "1 hour") -> DataFrame:
    """Tumbling counts and sums by type with a watermark; works on streams and tables."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
