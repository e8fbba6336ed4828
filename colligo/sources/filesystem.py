"""Folders and files of a root: a Python data source that prunes its walk by pushed filters.

``Depth < n`` and ``Depth <= n`` bound the walk, so that deeper folders are never opened; excluded folders neither.
"""

from __future__ import annotations

import os
import time
from collections.abc import Iterator, Mapping, Sequence

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, InputPartition, LessThan, LessThanOrEqual

from colligo.collection import Collection

#: Folders that are never entered, whatever the case of their names (fixed values).
EXCLUDED = frozenset(("bin", "obj", ".git", ".vs", ".idea", "node_modules", ".nuget", ".dotnet", "packages", "testresults", "__pycache__", ".mypy_cache", ".pytest_cache", "dist", "build", "out", ".next", ".cache"))
#: Parts to aim at: folders are opened level by level until there are so many, and each is walked by a task of its own.
PARTS = 256
FILES = "Path string, Name string, Extension string, Size bigint, Folder string, Depth bigint, MinutesSinceModified bigint, Source string"
FOLDERS = "Path string, Name string, Empty boolean, FileCount bigint, SubfolderCount bigint, Depth bigint, MinutesSinceModified bigint, Source string"


class _Part(InputPartition):
    """A folder at ``depth`` (None: the root), alone or with all below."""

    def __init__(self, folder: str, depth: int | None, deep: bool):
        super().__init__(folder)
        self.folder, self.depth, self.deep = folder, depth, deep


class _Reader(DataSourceReader):
    def __init__(self, kind: str, root: str, excluded: frozenset[str]):
        self.kind, self.root, self.excluded, self.most = kind, root, excluded, None

    def pushFilters(self, filters):  # noqa: N802
        for f in filters:
            if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)) and f.attribute[-1:] == ("Depth",) and isinstance(f.value, int):
                bound = f.value - (1 if isinstance(f, LessThan) else 0)
                self.most = bound if self.most is None else min(self.most, bound)
            yield f  # Spark tests each row as well

    def partitions(self):
        """Folders opened so far, each by itself, and the folders below them with all that they hold."""
        alone, deep = [_Part("", None, False)], [_Part(f, 0, True) for f in self._below("")]
        while deep and len(deep) < PARTS:
            next_level = [_Part(f, p.depth + 1, True) for p in deep for f in self._below(p.folder)]
            if not next_level:
                break
            alone += [_Part(p.folder, p.depth, False) for p in deep]
            deep = next_level
        return alone + deep

    def _below(self, folder: str) -> list[str]:
        return [f"{folder}/{e.name}" if folder else e.name for e in self._entries(folder) if e.is_dir(follow_symlinks=False) and e.name.lower() not in self.excluded]

    def read(self, partition):
        if partition.depth is None:
            if self.kind == "DiskFiles":
                yield from self._files("", 0)
        else:
            yield from self._walk(partition.folder, partition.depth, partition.deep)

    def _entries(self, folder: str):
        try:
            with os.scandir(os.path.join(self.root, folder)) as it:
                return sorted(it, key=lambda e: e.name)
        except OSError:
            return []

    def _walk(self, folder: str, depth: int, deep: bool = True) -> Iterator[tuple]:
        """A folder at ``depth`` (a folder of the root has depth 0), and all below if ``deep``; its files are one deeper."""
        if self.most is not None and depth > self.most:
            return
        entries = self._entries(folder)
        if self.kind == "Folders":
            files = sum(e.is_file() for e in entries)
            below = sum(e.is_dir(follow_symlinks=False) for e in entries)
            path = os.path.join(self.root, folder)
            yield (folder, os.path.basename(folder), files + below == 0, files, below, depth, self._age(path), folder)
        else:
            yield from self._files(folder, depth + 1, entries)
        for e in entries if deep else ():
            if e.is_dir(follow_symlinks=False) and e.name.lower() not in self.excluded:
                yield from self._walk(f"{folder}/{e.name}", depth + 1)

    def _files(self, folder: str, depth: int, entries=None) -> Iterator[tuple]:
        if self.most is not None and depth > self.most:
            return
        for e in entries if entries is not None else self._entries(folder):
            if e.is_file():
                path = f"{folder}/{e.name}" if folder else e.name
                yield (path, e.name, os.path.splitext(e.name)[1], e.stat().st_size, folder, depth, self._age(e.path), path)

    @staticmethod
    def _age(path: str) -> int:
        try:
            return max(0, int((time.time() - os.stat(path).st_mtime) // 60))
        except OSError:
            return 0


class DiskSource(DataSource):
    """``spark.read.format("colligo_disk").option("kind", "Folders").load(root)``"""

    @classmethod
    def name(cls) -> str:
        return "colligo_disk"

    def schema(self) -> str:
        return FOLDERS if self.options.get("kind") == "Folders" else FILES

    def reader(self, schema) -> DataSourceReader:
        excluded = self.options.get("excluded")
        return _Reader(self.options.get("kind", "DiskFiles"), self.options["path"], frozenset(excluded.lower().split(",")) if excluded is not None else EXCLUDED)


def source(spark: SparkSession, root: str, names: Sequence[str], excluded: Sequence[str] | None = None) -> Mapping[str, Collection]:
    """``Folders`` and ``DiskFiles`` under a root."""
    spark.dataSource.register(DiskSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    out = {}
    for name, item in (("Folders", "Folder"), ("DiskFiles", "DiskFile")):
        if name in names:
            reader = spark.read.format("colligo_disk").option("kind", name)
            if excluded is not None:
                reader = reader.option("excluded", ",".join(excluded))
            out[name] = Collection.of(reader.load(root), item, ["Path"])
    return out
