"""Folders that hold no file at any depth."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ledgerline.functions import names


def empty_folders(folders: DataFrame) -> DataFrame:
    """(path, depth) of folders (path, has_file) with no file in them or below.

    A folder is not empty exactly when it is an ancestor of one with a file, so
    one explode over ancestors replaces the walk from the leaves up.
    """
    parts = F.split("path", "/")
    ups = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda n: F.concat_ws("/", F.slice(parts, 1, n)))
    full = folders.filter("has_file").select(F.explode(ups).alias("path")).distinct()
    return folders.join(full, "path", "left_anti").select("path", (F.size(parts) - 1).alias("depth"))


def vacuum_plan(empty: DataFrame) -> DataFrame:
    """The topmost empty folders: those below travel with them."""
    parts = F.split("path", "/")
    above = F.concat_ws("/", F.slice(parts, F.lit(1), F.size(parts) - 1))
    return empty.join(empty.select(F.col("path").alias("__up")), above == F.col("__up"), "left_anti").select("path", "depth")


def to_trash(topmost: DataFrame, trash: str, batch: str) -> DataFrame:
    """(step, source, destination): folders (path, depth) moved into a batch, shallow ones first, names made unique."""
    name = names.base_name(F.col("path"))
    order = ["depth", "path"]
    nth = F.row_number().over(Window.partitionBy(name).orderBy(*order)) - 1
    unique = F.concat(name, F.when(nth > 0, F.concat(F.lit("_"), nth.cast("string"))).otherwise(""))
    step = F.row_number().over(Window.partitionBy("depth").orderBy("path"))
    return topmost.select("depth", step.alias("step"), F.col("path").alias("source"), F.concat_ws("/", F.lit(trash), F.lit(batch), unique).alias("destination"))
