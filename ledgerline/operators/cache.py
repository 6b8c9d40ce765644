"""Caches keyed by (path, kind, mtime, size), kind only where the cache has one: look up, upsert, prune, keep results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

KEY = ["path", "kind", "mtime", "size"]


def hits(cache: DataFrame, keys: DataFrame) -> DataFrame:
    """Cached rows of the asked keys, with all key columns."""
    key = [c for c in KEY if c in cache.columns]
    return cache.join(keys.select(*key).distinct(), key, "left_semi")


def misses(cache: DataFrame, keys: DataFrame) -> DataFrame:
    """Asked keys that the cache does not hold; a changed time or size is a miss."""
    key = [c for c in KEY if c in cache.columns]
    return keys.join(cache.select(*key), key, "left_anti")


def upsert(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """The cache with ``fresh`` rows in place of those of the same key; an aggregation, so no key is sorted whole.

    Of several fresh rows of a key, the one with the greatest values is taken, whole.
    """
    both = cache.withColumn("__age", F.lit(0)).unionByName(fresh.withColumn("__age", F.lit(1)))
    keys = [c for c in KEY if c in cache.columns]
    rest = [c for c in cache.columns if c not in keys]
    return both.groupBy(*keys).agg(F.max(F.struct("__age", *rest)).alias("__row")).select(*keys, *[F.col(f"__row.{c}") for c in rest])


def prune(cache: DataFrame, valid: DataFrame) -> DataFrame:
    """Cached rows whose (path, mtime, size) is still valid."""
    return cache.join(valid.select("path", "mtime", "size").distinct(), ["path", "mtime", "size"], "left_semi")


def load(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stored cache."""
    return spark.read.schema(schema).parquet(path)


class Results:
    """Results kept between questions, by name and parameters.

    Moving or renaming files keeps what depends on their content alone; a change
    of content drops everything.
    """

    CONTENT_ONLY = ("duplicates", "similar")

    def __init__(self) -> None:
        self.held: dict[tuple, DataFrame] = {}

    def get(self, name: str, make: Callable[[], DataFrame], *parameters) -> DataFrame:
        key = (name, *parameters)
        if key not in self.held:
            self.held[key] = make().persist()
        return self.held[key]

    def _drop(self, keys: list[tuple]) -> None:
        for key in keys:
            self.held.pop(key).unpersist()

    def files_moved(self) -> None:
        self._drop([k for k in self.held if k[0] not in self.CONTENT_ONLY])

    def content_changed(self) -> None:
        self._drop(list(self.held))
