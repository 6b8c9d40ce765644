"""Real folders as a DataFrame: a Python data source that lists subtrees in parallel.

Every top folder of a root is a partition of its own.  Regular files only:
symbolic links, to files or folders, are neither listed nor entered; internal
folders are pruned at any depth; folders that cannot be read are passed over.  A
file whose facts cannot be read keeps its row, with null size and time.  Dot
files and empty files are listed.

``content`` is what to read of each file: ``none``, ``prefix`` (8192 bytes) or
``full``.  On a cluster every executor must see the folders.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ledgerline.schemas import FILES
from ledgerline.sources.catalog import INTERNAL

PREFIX_BYTES = 8192


class Subtree(InputPartition):
    """A folder of a root; ``deep`` if its own folders belong to it too."""

    def __init__(self, root: str, folder: str, deep: bool) -> None:
        self.root, self.folder, self.deep = root, folder, deep


class FolderReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.roots = json.loads(options["roots"])
        self.recursive = options.get("recursive", "true").lower() == "true"
        self.content = options.get("content", "none")
        self.skipped = {os.path.abspath(p) for p in json.loads(options.get("skip", "[]"))}
        if self.content not in ("none", "prefix", "full"):
            raise ValueError(f"content is none, prefix or full, not {self.content}")

    def partitions(self) -> list[InputPartition]:
        found: list[InputPartition] = []
        for root in self.roots:
            found.append(Subtree(root, root, False))
            if self.recursive:
                found += [Subtree(root, folder, True) for folder in _folders(root)]
        return found

    def read(self, partition: Subtree) -> Iterator[tuple]:
        todo = [partition.folder]
        while todo:
            folder = todo.pop()
            if partition.deep:
                todo += _folders(folder)
            for entry in _entries(folder):
                if not entry.is_symlink() and entry.is_file(follow_symlinks=False) and entry.path not in self.skipped:
                    yield self._row(partition.root, folder, entry)

    def _row(self, root: str, folder: str, entry: os.DirEntry) -> tuple:
        size = mtime = content = None
        try:
            facts = entry.stat(follow_symlinks=False)
            size, mtime = facts.st_size, facts.st_mtime
            if self.content != "none":
                with open(entry.path, "rb") as handle:
                    content = handle.read(PREFIX_BYTES if self.content == "prefix" else -1)
        except OSError:
            pass
        return (entry.path, root, folder, entry.name, size, mtime, content)


class Folders(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ledgerline_folders"

    def schema(self) -> str:
        return FILES

    def reader(self, schema) -> FolderReader:
        return FolderReader(self.options)


def _entries(folder: str) -> list[os.DirEntry]:
    try:
        with os.scandir(folder) as found:
            return sorted(found, key=lambda e: e.name)
    except OSError:
        return []


def _folders(folder: str) -> list[str]:
    return [e.path for e in _entries(folder) if not e.is_symlink() and e.is_dir(follow_symlinks=False) and e.name not in INTERNAL]


def workspace(folders: Iterable[str]) -> list[str]:
    """Resolved folders in order, each once; those that are gone are left out."""
    resolved = dict.fromkeys(os.path.realpath(f) for f in folders)
    return [f for f in resolved if os.path.isdir(f)]


def joined(present: list[str], folder: str) -> list[str]:
    """The workspace with one folder more; an error if it is a member already."""
    added = os.path.realpath(folder)
    if added in present:
        raise ValueError(f"{added} is in the workspace already")
    return [*present, added]


def scan(spark: SparkSession, roots: list[str], recursive: bool = True, content: str = "none", skip: Iterable[str] = ()) -> DataFrame:
    """(path, root, parent, name, size, mtime, content) of all roots; a file below two roots is listed once.

    ``skip`` names files by path that are never listed, such as the running script.
    """
    spark.dataSource.register(Folders)
    options = {"roots": json.dumps(workspace(roots)), "recursive": str(recursive), "content": content, "skip": json.dumps(list(skip))}
    found = spark.read.format(Folders.name()).options(**options).load()
    return found.dropDuplicates(["path"]) if len(roots) > 1 else found
