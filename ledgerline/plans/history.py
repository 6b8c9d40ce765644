"""The append-only ledger of moves: runs, undo, trash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerline.functions import names
from ledgerline.operators.ranking import numbered
from ledgerline.sources.catalog import TRASH
from ledgerline.sources.scratch import Scratch


def runs(ledger: DataFrame) -> DataFrame:
    """(run_id, run_day, n_entries, is_undone) of every run."""
    return ledger.groupBy("run_id").agg(
        F.max("run_day").alias("run_day"), F.count("*").alias("n_entries"), F.max("is_undone").alias("is_undone")
    )


def history(ledger: DataFrame) -> DataFrame:
    """Runs with a label and an index from 1, newest first."""
    label = F.coalesce(F.date_format(F.try_to_timestamp("run_day", F.lit("yyyyMMdd")), "yyyy-MM-dd"), F.col("run_id"))
    found = runs(ledger).withColumn("label", label)
    return numbered(Scratch(ledger.sparkSession, "history"), found, [], [F.desc("run_day"), F.desc("run_id")], "index").withColumn("index", F.col("index").cast("int"))


def latest_run(ledger: DataFrame) -> DataFrame:
    """The newest run that is not undone."""
    return runs(ledger).filter("not is_undone").orderBy(F.desc("run_day"), F.desc("run_id")).limit(1)


def _outcome(missing: Column, unknown: Column, occupied: Column) -> Column:
    return F.when(missing, "missing").when(unknown, "unknown origin").when(occupied, "occupied").otherwise("restore")


def undo_plan(ledger: DataFrame) -> DataFrame:
    """(run_id, step, source, destination, outcome): every run's moves backwards, from where the file is now."""
    backwards = numbered(Scratch(ledger.sparkSession, "undo"), ledger, ["run_id"], [F.desc("seq")], "step")
    return backwards.select(
        "run_id",
        F.col("step").cast("int").alias("step"),
        F.col("destination").alias("source"),
        F.col("source").alias("destination"),
        _outcome(~F.col("destination_exists"), F.lit(False), F.col("source_occupied")).alias("outcome"),
    )


def in_trash(path: Column) -> Column:
    """Whether the path lies in the trash folder; a folder that only starts like it does not count."""
    return F.coalesce(F.contains(path, F.lit(TRASH)), F.lit(False))


def trash_origins(ledger: DataFrame) -> DataFrame:
    """(path, origin): where each trashed file came from last."""
    moved = ledger.filter(in_trash(F.col("destination")))
    return moved.groupBy(F.col("destination").alias("path")).agg(F.max_by("source", F.struct("run_day", "run_id", "seq")).alias("origin"))


def trash_items(present: DataFrame, ledger: DataFrame) -> DataFrame:
    """(path, batch, name, origin) of files present in the trash; unknown origins are null."""
    parts = F.split(F.element_at(F.split("path", TRASH.replace(".", "[.]")), 2), "/")
    return present.filter(in_trash(F.col("path"))).join(trash_origins(ledger), "path", "left").select(
        "path", parts[0].alias("batch"), F.element_at(parts, -1).alias("name"), "origin"
    )


def restore_plan(items: DataFrame, ledger: DataFrame, occupied: DataFrame) -> DataFrame:
    """(path, origin, outcome): refused where gone, of unknown origin or with its place taken, in that order.

    ``items`` is (path, is_present); ``occupied`` is (path) of files in place.
    """
    known = items.join(trash_origins(ledger), "path", "left")
    taken = occupied.select(F.col("path").alias("origin"), F.lit(True).alias("__taken")).distinct()
    outcome = _outcome(~F.col("is_present"), F.col("origin").isNull(), F.coalesce("__taken", F.lit(False)))
    return known.join(taken, "origin", "left").select("path", "origin", outcome.alias("outcome"))


def restore_selected(items: DataFrame, selected: DataFrame, ledger: DataFrame, occupied: DataFrame) -> DataFrame:
    """``restore_plan`` of the items whose path is selected; selected paths that are not in the trash give nothing."""
    return restore_plan(items.join(selected.select("path").distinct(), "path", "left_semi"), ledger, occupied)


def ordered_trash(items: DataFrame) -> DataFrame:
    """``trash_items`` with batch_position, newest batch first, and position by name within the batch.

    Batches are ordered by the time in their name, batches without one last.
    """
    when = F.try_to_timestamp(F.regexp_extract("batch", r"(\d{8})", 1), F.lit("yyyyMMdd"))
    batches = items.select("batch").distinct().withColumn("batch_position", F.row_number().over(Window.orderBy(when.desc_nulls_last(), F.desc("batch"))))
    inside = F.row_number().over(Window.partitionBy("batch").orderBy("name", "path"))
    return items.withColumn("position", inside).join(batches, "batch")


def undo_details(ledger: DataFrame, most: int = 100) -> DataFrame:
    """(run_id, position, file_name, source_dir, destination_dir, destination_name): the first moves of every run."""
    shown = ledger.withColumn("position", F.row_number().over(Window.partitionBy("run_id").orderBy("seq"))).filter(F.col("position") <= most)
    source, destination = F.col("source"), F.col("destination")
    return shown.select(
        "run_id",
        "position",
        names.base_name(source).alias("file_name"),
        names.parent(source).alias("source_dir"),
        names.parent(destination).alias("destination_dir"),
        names.base_name(destination).alias("destination_name"),
    )


def rebuilt(ledger: DataFrame, undone: DataFrame) -> DataFrame:
    """(run_id, run_day, n_entries, is_undone) from the moves and the undo events (run_id) alone; the same however often."""
    flags = undone.select("run_id").distinct().withColumn("__undone", F.lit(True))
    counted = ledger.groupBy("run_id").agg(F.max("run_day").alias("run_day"), F.count("*").alias("n_entries"))
    return counted.join(flags, "run_id", "left").select("run_id", "run_day", "n_entries", F.coalesce("__undone", F.lit(False)).alias("is_undone"))


def mark_undone(undone: DataFrame, run_id: str) -> DataFrame:
    """The undo events with one more; a second mark changes nothing."""
    return undone.select("run_id").union(undone.sparkSession.createDataFrame([(run_id,)], "run_id string")).distinct()


def chains(scratch: Scratch, ledger: DataFrame) -> DataFrame:
    """(run_id, first_source, last_destination, n_moves) of files moved several times in a run.

    A move continues the last one before it that came to its source, if nothing
    has left from there since.  Moves are linked by a window over each path of a
    run and followed by pointer jumping, so no run is ever held in one task.
    """
    moves = ledger.select("run_id", "seq", "source", "destination")
    ends = moves.select("run_id", "seq", F.col("source").alias("path"), F.lit(0).alias("arrives")).union(
        moves.select("run_id", "seq", F.col("destination").alias("path"), F.lit(1).alias("arrives"))
    )
    at = Window.partitionBy("run_id", "path").orderBy("seq", "arrives")
    before = F.when(F.lag("arrives").over(at) == 1, F.lag("seq").over(at))
    table = scratch.save(ends.withColumn("head", F.coalesce(before, "seq")).filter("arrives = 0").select("run_id", "seq", "head"), "heads")
    while True:
        up = table.select(F.col("run_id").alias("__run"), F.col("seq").alias("__seq"), F.col("head").alias("__head"))
        jumped = table.join(up, (F.col("run_id") == F.col("__run")) & (F.col("head") == F.col("__seq")))
        following = scratch.save(jumped.select("run_id", "seq", F.col("__head").alias("head"), (F.col("__head") != F.col("head")).alias("moved")), "heads")
        scratch.drop(table)
        table = following.drop("moved")
        if not following.filter("moved").limit(1).count():
            break
    return (
        moves.join(table, ["run_id", "seq"])
        .groupBy("run_id", "head")
        .agg(F.min_by("source", "seq").alias("first_source"), F.max_by("destination", "seq").alias("last_destination"), F.count("*").alias("n_moves"))
        .drop("head")
    )
