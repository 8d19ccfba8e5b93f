"""Listing of files by executors: a data source whose partitions are sub-folders.

The driver looks only as far down as it takes to have a sub-folder for each task; the files are found by the tasks,
which have to see the folders under the same paths. Hidden names are listed too, which Spark's file sources pass over.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

LISTING = "folder int, path string, name string, size long, mtime double, ctime double"


class Folders(InputPartition):
    """Sub-folders of one task: (number of the folder asked for, path, whether all below it)."""

    def __init__(self, parts: list[tuple[int, str, bool]]):
        super().__init__(parts)
        self.parts = parts


def _below(folder: str) -> list[str]:
    try:
        with os.scandir(folder) as found:
            return sorted(e.path for e in found if e.is_dir(follow_symlinks=False))
    except OSError:
        return []


def _files(folder: str, deep: bool) -> Iterator[tuple[str, str, int, float, float]]:
    """Regular files, links to such included; nothing for a folder that can't be read."""
    waiting = [folder]
    while waiting:
        at = waiting.pop()
        try:
            with os.scandir(at) as found:
                entries = list(found)
        except OSError:
            continue
        for entry in entries:
            try:
                if entry.is_dir(follow_symlinks=False):
                    if deep:
                        waiting.append(entry.path)
                elif entry.is_file():
                    stat = entry.stat()
                    yield entry.path, entry.name, stat.st_size, stat.st_mtime, stat.st_ctime
            except OSError:
                continue


class FolderReader(DataSourceReader):
    def __init__(self, folders: list[str], recursive: bool, tasks: int):
        self.folders, self.recursive, self.tasks = folders, recursive, tasks

    def partitions(self) -> list[Folders]:
        front = [(i, folder) for i, folder in enumerate(self.folders) if os.path.isdir(folder)]
        parts = [] if self.recursive else [(i, folder, False) for i, folder in front]
        while self.recursive and front:
            if len(front) + len(parts) >= self.tasks:
                parts += [(i, folder, True) for i, folder in front]
                break
            parts += [(i, folder, False) for i, folder in front]
            front = [(i, child) for i, folder in front for child in _below(folder)]
        dealt = [parts[k :: self.tasks] for k in range(min(self.tasks, len(parts)))]
        return [Folders(p) for p in dealt] or [Folders([])]

    def read(self, partition: Folders) -> Iterator[tuple]:
        for i, folder, deep in partition.parts:
            for found in _files(folder, deep):
                yield (i, *found)


class MediaFolders(DataSource):
    """Options: ``folders``, a JSON list; ``recursive`` and ``tasks``."""

    @classmethod
    def name(cls) -> str:
        return "twinsieve_folders"

    def schema(self) -> str:
        return LISTING

    def reader(self, schema) -> FolderReader:
        folders = [os.path.abspath(f) for f in json.loads(self.options["folders"])]
        return FolderReader(folders, self.options.get("recursive", "true") == "true", int(self.options.get("tasks", "64")))


def list_files(spark: SparkSession, folders: list[str], recursive: bool = True) -> DataFrame:
    """``folder, path, name, size, mtime, ctime`` of the files in some folders, in no order."""
    spark.dataSource.register(MediaFolders)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return spark.read.format(MediaFolders.name()).options(folders=json.dumps(list(folders)), recursive=str(recursive).lower(), tasks=tasks).load()
