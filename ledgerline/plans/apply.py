"""Carrying out a plan on a local disk, and the logs of what was done: the only code with effects on files."""

from __future__ import annotations

import json
import os
import shutil
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

UNDONE = ".undone.json"


def apply_moves(
    moves: Iterable[tuple[str, str]], dry_run: bool = True, workers: int = 1, on_success: Callable | None = None, on_skip: Callable | None = None
) -> list[dict[str, str]]:
    """Moves (source, destination) and returns the log in the order of the plan.

    Feed it ``plan.toLocalIterator()``: rows stream through the driver.  Missing
    sources and taken places are left alone and not logged.  A dry run does and
    logs nothing.  With several ``workers`` moves run at once, so a plan whose
    moves depend on each other needs one; a place that an earlier move of the
    plan names then counts as taken, so no two moves can meet there.
    """
    named: set[str] = set()

    def first_there(pairs: Iterable[tuple[str, str]]) -> Iterator[tuple[str, str, bool]]:
        for source, destination in pairs:
            yield source, destination, workers == 1 or destination not in named
            named.add(destination)

    def move(planned: tuple[str, str, bool]) -> dict[str, str] | None:
        source, destination, is_first = planned
        if dry_run or not is_first or not os.path.exists(source) or os.path.exists(destination):
            if on_skip and not dry_run:
                on_skip(source, destination)
            return None
        os.makedirs(os.path.dirname(destination), exist_ok=True)
        shutil.move(source, destination)
        if on_success:
            on_success(source, destination)
        return {"source": source, "destination": destination}

    if workers == 1 or dry_run:
        done = map(move, first_there(moves))
        return [entry for entry in done if entry]
    with ThreadPoolExecutor(workers) as pool:
        return [entry for entry in pool.map(move, first_there(moves)) if entry]


def write_run_log(folder: str, log: list[dict[str, str]], now: datetime) -> str | None:
    """Writes a run's log as JSON and returns its path; an empty log writes nothing."""
    if not log:
        return None
    os.makedirs(folder, exist_ok=True)
    stem = os.path.join(folder, f"run_{now:%Y%m%d_%H%M%S_%f}")
    path, n = f"{stem}.json", 0
    while True:
        try:
            with open(path, "x", encoding="utf-8") as handle:
                json.dump(log, handle, indent=2)
            return path
        except FileExistsError:
            n += 1
            path = f"{stem}_{n}.json"


def read_run_logs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(runs, ledger) of a folder's logs.

    runs: run_id, run_day, n_entries, is_undone; a log that is no JSON counts no
    entries.  ledger: run_id, run_day, seq, source, destination.
    """
    entry = "array<struct<source: string, destination: string>>"
    name = F.regexp_extract("_metadata.file_name", r"^(run_.*?)(?:[.]undone)?[.]json$", 1)
    logs = (
        spark.read.text(folder, wholetext=True, pathGlobFilter="run_*.json")
        .select(
            name.alias("run_id"),
            F.regexp_extract(name, r"^run_(\d{8})", 1).alias("run_day"),
            F.col("_metadata.file_name").endswith(UNDONE).alias("is_undone"),
            F.from_json("value", entry).alias("entries"),
        )
    )
    runs = logs.select("run_id", "run_day", F.greatest(F.size("entries"), F.lit(0)).cast("long").alias("n_entries"), "is_undone")
    ledger = logs.select("run_id", "run_day", F.posexplode("entries").alias("pos", "e"))
    return runs, ledger.select("run_id", "run_day", (F.col("pos") + 1).alias("seq"), "e.source", "e.destination")


def undo_run(path: str, on_restore: Callable | None = None, on_skip: Callable | None = None) -> tuple[int, int]:
    """Moves a logged run's files back, last first, and marks the log as undone; (files restored, files logged)."""
    with open(path, encoding="utf-8") as handle:
        log = json.load(handle)
    back = ((e["destination"], e["source"]) for e in reversed(log))
    restored = apply_moves(back, dry_run=False, on_success=on_restore, on_skip=on_skip)
    os.rename(path, path.removesuffix(".json") + UNDONE)
    return len(restored), len(log)


def delete_files(paths: Iterable[str]) -> dict[str, list[str]]:
    """Deletes files for good: {deleted, failed}."""
    done: dict[str, list[str]] = {"deleted": [], "failed": []}
    for path in paths:
        try:
            os.remove(path)
            done["deleted"].append(path)
        except OSError:
            done["failed"].append(path)
    return done


def delete_empty_folders(paths: Iterable[str]) -> dict[str, list[str]]:
    """Deletes folders for good, deepest first; one that is not empty by then fails."""
    done: dict[str, list[str]] = {"deleted": [], "failed": []}
    for path in sorted(paths, key=lambda p: (-p.count(os.sep), p)):
        try:
            os.rmdir(path)
            done["deleted"].append(path)
        except OSError:
            done["failed"].append(path)
    return done


def empty_trash(trash: str) -> int:
    """Deletes the files that lie directly in the trash's batches, and batches left empty; how many files."""
    count = 0
    for batch in sorted(os.scandir(trash), key=lambda e: e.name) if os.path.isdir(trash) else []:
        if not batch.is_dir(follow_symlinks=False):
            continue
        files = [e.path for e in os.scandir(batch.path) if e.is_file(follow_symlinks=False)]
        count += len(delete_files(files)["deleted"])
        delete_empty_folders([batch.path])
    return count
