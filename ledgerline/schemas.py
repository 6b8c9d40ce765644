"""Schemas of the stored tables, and an empty table for each that is missing."""

from __future__ import annotations

from pyspark.sql import SparkSession

FILES = "path string, root string, parent string, name string, size long, mtime double, content binary"
LEDGER = "run_id string, seq int, source string, destination string"
TABLES = {
    "ledger": LEDGER,
    "undone": "run_id string",
    "hash_cache": "path string, kind string, mtime double, size long, value string",
    "thumbnail_cache": "path string, mtime double, size long, b64 string",
    "trash_index": "path string, origin string",
    "history": "run_id string, run_day string, n_entries long, is_undone boolean",
}


def bootstrap(spark: SparkSession, root: str) -> dict[str, str]:
    """Paths of the stored tables under ``root``; those that are missing are created empty."""
    paths = {name: f"{root.rstrip('/')}/{name}" for name in TABLES}
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for name, path in paths.items():
        place = hadoop(path)
        if not place.getFileSystem(conf).exists(place):
            spark.createDataFrame([], TABLES[name]).write.parquet(path)
    return paths
