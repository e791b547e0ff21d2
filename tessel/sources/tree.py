"""A Spark data source over a tree of files: ``spark.read.format("source_tree").option("root", ...)``.

The driver opens directories breadth first only until there are some for every partition; the executors list and read
what lies below, so neither the number of files nor their listing is the driver's. Ignored and hidden directories are
never opened. The built-in binary reader would drop names that start with a dot or underscore and empty files, so it
is not used. Options: ``root``, ``include_dotfiles``, ``max_bytes``, ``partitions``. The root must be a folder all
executors see.
"""

from __future__ import annotations

import os
from collections import deque
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from tessel.operators.scanning import MAX_BYTES, enters, reads

SCHEMA = "path string, rel_path string, length bigint, content binary"
#: Directories opened on the driver for each partition, so that uneven ones even out.
UNITS_PER_PARTITION = 4


class Folders(InputPartition):
    """Directories to list, each with whether everything below it belongs to it."""

    def __init__(self, units: list[tuple[str, bool]]):
        self.units = units


def _entries(folder: str) -> list[os.DirEntry]:
    try:
        with os.scandir(folder) as listing:
            return sorted(listing, key=lambda e: e.name)
    except OSError:
        return []  # it vanished or is closed to us


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options.get("root") or options.get("path")
        self.dotfiles = str(options.get("include_dotfiles", "false")).lower() == "true"
        self.max_bytes = int(options.get("max_bytes", MAX_BYTES))
        self.parts = max(1, int(options.get("partitions", 64)))
        if not self.root or not os.path.isdir(self.root):
            raise ValueError(f"not a directory: {self.root}")

    def _below(self, folder: str) -> list[str]:
        return [e.path for e in _entries(folder) if e.is_dir(follow_symlinks=False) and enters(e.name, self.dotfiles)]

    def partitions(self) -> list[InputPartition]:
        closed, units = deque([self.root]), []
        while closed and len(closed) + len(units) < self.parts * UNITS_PER_PARTITION:
            folder = closed.popleft()
            units.append((folder, False))  # its own files; its directories are units themselves
            closed.extend(self._below(folder))
        units += [(folder, True) for folder in closed]
        return [Folders(units[i :: self.parts]) for i in range(min(self.parts, len(units)))]

    def read(self, partition: Folders) -> Iterator[tuple]:
        for folder, deep in partition.units:
            opened = [folder]
            while opened:
                here = opened.pop()
                if deep:
                    opened.extend(self._below(here))
                yield from self._files(here)

    def _files(self, folder: str) -> Iterator[tuple]:
        for entry in _entries(folder):
            try:
                if entry.is_file() and reads(entry.name, entry.stat().st_size, self.dotfiles, self.max_bytes):
                    with open(entry.path, "rb") as f:
                        content = f.read()
                    yield entry.path, os.path.relpath(entry.path, self.root), len(content), content
            except OSError:
                continue  # it vanished since the listing


class SourceTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str | StructType:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return TreeReader(self.options)


def read_tree(spark: SparkSession, root: str, **options):
    """The files under ``root`` as a DataFrame."""
    spark.dataSource.register(SourceTree)
    reader = spark.read.format("source_tree").option("root", root)
    for key, value in options.items():
        reader = reader.option(key, str(value).lower() if isinstance(value, bool) else str(value))
    return reader.load()
