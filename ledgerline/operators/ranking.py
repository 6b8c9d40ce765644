"""Numbering rows within groups of any size, a group of all rows included."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerline.sources.scratch import Scratch


def numbered(scratch: Scratch, rows: DataFrame, keys: list[str], order: list[str | Column], name: str) -> DataFrame:
    """``rows`` with ``name``: 1, 2, ... within equal ``keys`` by ``order``, which has to tell a group's rows apart.

    Rows are dealt by ranges of keys and order, so a hot group lies in many
    partitions; each is numbered on its own and gets what the ones before it
    hold as offset.  Only such counts, one per group and partition, are in one
    window.
    """
    by = [F.col(o) if isinstance(o, str) else o for o in order]
    dealt = rows.repartitionByRange(*[F.col(k) for k in keys], *by).withColumn("__part", F.spark_partition_id())
    held = scratch.save(dealt, "ranges")
    inside = F.row_number().over(Window.partitionBy("__part", *keys).orderBy(*by))
    counts = held.groupBy(*keys, "__part").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*keys).orderBy("__part")) - F.col("__n")
    offsets = counts.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__part").alias("__p"), before.alias("__before"))
    same = F.col("__part") == F.col("__p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    joined = held.withColumn("__inside", inside).join(offsets, same)
    return joined.withColumn(name, F.col("__before") + F.col("__inside")).select(*rows.columns, name)
