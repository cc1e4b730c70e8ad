"""Sinks. Spark's committer makes a folder of files appear whole or not at all; readers look for its _SUCCESS."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_json_lines(pages: DataFrame, chunks: DataFrame, folder: str) -> None:
    """pages, chunks and metadata (their counts) as JSON lines."""
    counts = pages.agg(F.count(F.lit(1)).alias("pages")).crossJoin(chunks.agg(F.count(F.lit(1)).alias("chunks")))  # one row each
    for name, rows in (("pages", pages), ("chunks", chunks), ("metadata", counts)):
        rows.write.mode("overwrite").json(f"{folder}/{name}")


def replace_all(rows: DataFrame, path: str) -> None:
    """The target holds these rows and no others."""
    rows.write.mode("overwrite").parquet(path)


def write_registry(records: DataFrame, folder: str, source: str = "source_id") -> None:
    """Records, and a manifest with the records and blocks of each source."""
    records.write.mode("overwrite").json(f"{folder}/records")
    manifest = records.groupBy(source).agg(F.count(F.lit(1)).alias("records"), F.count_distinct("source_locator").alias("blocks"))
    manifest.write.mode("overwrite").json(f"{folder}/source_manifest")


def write_features(features: DataFrame, path: str) -> None:
    """(feature) rows as newline-delimited GeoJSON, which needs no single writer."""
    features.select("feature").write.mode("overwrite").text(path)


def replace_folder(rows: DataFrame, path: str) -> None:
    """Write beside the target, then rename: readers see the old rows or the new ones, never a part."""
    spark = rows.sparkSession
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    made, target = fs_path(f"{path}.tmp"), fs_path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    rows.write.mode("overwrite").parquet(made.toString())
    files.delete(target, True)
    if not files.rename(made, target):
        raise RuntimeError(f"{path} could not be replaced")


def upsert(rows: DataFrame, path: str, key: str) -> DataFrame:
    """Rows win over those with their key; read back, and every id must be there. One writer at a time."""
    spark = rows.sparkSession
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    exists = fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path)
    merged = rows if not exists else spark.read.schema(rows.schema).parquet(path).join(rows.select(key).distinct(), key, "left_anti").unionByName(rows)
    replace_folder(merged, path)
    stored = spark.read.parquet(path)
    if rows.select(key).join(stored, key, "left_anti").limit(1).count():
        raise RuntimeError("ids are missing after the write")
    return stored
