"""Byte-identical files: sizes, then prefixes of 8192 bytes, then whole digests.

Digests are taken where a file is read, so bytes never move; what is shuffled is
a path, a size and two digests.  Every grouping is a partial aggregation and a
join on its key, so a hot group of copies is one row per task before the
shuffle, and its members are split by adaptive execution after it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ledgerline.functions import names
from ledgerline.operators.ranking import numbered
from ledgerline.sources.scratch import Scratch

PREFIX_BYTES = 8192


def digested(files: DataFrame) -> DataFrame:
    """(path, size, prefix, digest) of files that are not empty; both digests null where a file cannot be read."""
    content = F.col("content").cast("binary")
    prefix = F.md5(F.substring(content, 1, PREFIX_BYTES))
    return files.filter("size > 0").select("path", "size", prefix.alias("prefix"), F.sha2(content, 256).alias("digest"))


def unreadable(files: DataFrame, most: int = 10) -> DataFrame:
    """(position, path) of the first files, by path, whose size or bytes cannot be read."""
    lost = files.filter(F.col("size").isNull() | F.col("content").isNull()).select("path").orderBy("path").limit(most)
    return lost.withColumn("position", F.row_number().over(Window.orderBy("path")))


def _repeated(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows whose keys occur more than once, with how often (``n``)."""
    many = rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")
    return rows.join(many, list(keys))


def size_candidates(files: DataFrame) -> DataFrame:
    """(size, n): sizes that several files have."""
    return files.filter("size > 0").groupBy("size").agg(F.count("*").alias("n")).filter("n > 1")


def prefix_candidates(files: DataFrame) -> DataFrame:
    """(size, prefix, n): beginnings that several files of a size have."""
    return digested(files).groupBy("size", "prefix").agg(F.count("*").alias("n")).filter("n > 1 and prefix is not null")


def exact_duplicates(files: DataFrame) -> DataFrame:
    """(group_path, path, size, digest, n_copies, is_extra) of files whose bytes occur more than once.

    ``group_path`` is the group's smallest path, whose file is the one to keep.
    Empty files and files of unknown size are in no group.
    """
    known = digested(files).filter("digest is not null").select("path", "size", "digest")
    groups = known.groupBy("size", "digest").agg(F.count("*").alias("n_copies"), F.min("path").alias("group_path"))
    return known.join(groups.filter("n_copies > 1"), ["size", "digest"]).select(
        "group_path", "path", "size", "digest", "n_copies", (F.col("path") != F.col("group_path")).alias("is_extra")
    )


def purge_plan(duplicates: DataFrame, selected: DataFrame, trash: str, batch: str) -> DataFrame:
    """(source, destination, size, outcome) of the selected copies (path).

    Copies go to ``trash``/``batch``, names made unique in the batch; where all
    copies of a group are selected, the group's first is kept.
    """
    chosen = duplicates.join(selected.select("path").distinct(), "path", "left_semi")
    counts = chosen.groupBy("group_path").agg(F.count("*").alias("n_chosen"), F.min("path").alias("first_chosen"))
    judged = chosen.join(counts, "group_path").withColumn(
        "outcome", F.when((F.col("n_chosen") == F.col("n_copies")) & (F.col("path") == F.col("first_chosen")), "kept").otherwise("trash")
    )
    placed = numbered(Scratch(duplicates.sparkSession, "purge"), judged.withColumn("name", names.base_name(F.col("path"))), ["name", "outcome"], ["path"], "nth")
    name, nth = F.col("name"), F.col("nth") - 1
    unique = F.concat(names.stem(name), F.when(nth > 0, F.concat(F.lit(" ("), nth.cast("string"), F.lit(")"))).otherwise(""), names.suffix(name))
    place = F.when(F.col("outcome") == "trash", F.concat_ws("/", F.lit(trash), F.lit(batch), unique))
    return placed.select(F.col("path").alias("source"), place.alias("destination"), "size", "outcome")


def reclaimed(purge: DataFrame) -> DataFrame:
    """One row: files that a purge moves, and their bytes."""
    moved = F.col("outcome") == "trash"
    return purge.agg(F.count_if(moved).alias("n_files"), F.coalesce(F.sum(F.when(moved, F.col("size"))), F.lit(0)).alias("bytes"))


def groups_of(duplicates: DataFrame) -> DataFrame:
    """(group_path, n_copies, size) one row per group."""
    return duplicates.groupBy("group_path").agg(F.first("n_copies").alias("n_copies"), F.first("size").alias("size"))


def summary(duplicates: DataFrame) -> DataFrame:
    """One row: groups, extra copies and the bytes that they hold."""
    extra = F.col("n_copies") - 1
    return groups_of(duplicates).agg(
        F.count("*").alias("n_groups"),
        F.coalesce(F.sum(extra), F.lit(0)).alias("n_extra"),
        F.coalesce(F.sum(extra * F.col("size")), F.lit(0)).alias("reclaimable"),
    )


def page(duplicates: DataFrame, number: int, page_size: int = 25, members: int = 10) -> DataFrame:
    """Page ``number`` of the groups, clamped to those that exist, and each group's first members.

    (group_index, group_path, path, ordinal, n_copies); the index is global, so
    it stays the same on every page.  Groups are sorted in a distributed way and
    only those of the page are ever in one task.
    """
    groups = groups_of(duplicates).select("group_path")
    total = groups.agg(F.count("*").alias("n")).withColumn("pages", F.greatest(F.lit(1), F.ceil(F.col("n") / page_size))).first()
    at = max(0, min(number, int(total["pages"]) - 1))
    shown = groups.orderBy("group_path").offset(at * page_size).limit(page_size)
    order = Window.orderBy("group_path")
    chosen = shown.withColumn("group_index", (F.row_number().over(order) - 1 + at * page_size).cast("int"))
    rank = F.row_number().over(Window.partitionBy("group_path").orderBy("path"))
    return (
        duplicates.join(chosen, "group_path")
        .withColumn("ordinal", rank)
        .filter(F.col("ordinal") <= members)
        .select("group_index", "group_path", "path", "ordinal", "n_copies")
    )
