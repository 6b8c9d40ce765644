"""Bulk renames within folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ledgerline.functions import names
from ledgerline.plans.organize import unique_names


def rename_plan(files: DataFrame, rule: tuple) -> DataFrame:
    """(source, destination, changed) of files (path, parent, name) under a rule of ``names.renamed``.

    A file that keeps its name keeps it; every other takes the first free name,
    where all present names of the folder count as taken.
    """
    wanted = files.select("path", F.col("parent").alias("folder"), F.col("name").alias("__old"), names.renamed(F.col("name"), rule).alias("name"))
    still = wanted.filter(F.col("name") == F.col("__old"))
    moving = wanted.filter(F.col("name") != F.col("__old")).withColumnRenamed("path", "source").drop("__old")
    taken = files.select(F.col("parent").alias("folder"), "name")
    moved = unique_names(moving, taken).select("source", F.concat_ws("/", "folder", "new_name").alias("destination"))
    kept = still.select(F.col("path").alias("source"), F.col("path").alias("destination"))
    return moved.unionByName(kept).withColumn("changed", F.col("source") != F.col("destination"))


def preview(plan: DataFrame, most: int = 50) -> DataFrame:
    """(position, source, destination) of the first files, by path, whose name changes."""
    shown = plan.filter("changed").orderBy("source").limit(most).select("source", "destination")
    return shown.withColumn("position", F.row_number().over(Window.orderBy("source")))
