"""Listing of mounted media folders as a Spark data source: folders are walked in parallel and no file is opened."""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

FORMAT = "media_files"
SCHEMA = "path string, name string, stem string, extension string, length long, modified timestamp"
FANOUT = 4096  # folders and files of the upper levels the driver deals out


class Share(InputPartition):
    """Some folders to walk and some names to look at."""

    def __init__(self, folders: list[str], files: list[str]):
        self.folders, self.files = folders, files


class MediaReader(DataSourceReader):
    def __init__(self, root: str, shares: int, extensions: set[str] | None):
        self.root, self.shares, self.extensions = root, shares, extensions

    def partitions(self) -> list[Share]:
        """Levels are opened from the top until there are enough folders for all shares; each share gets every so many-th of them."""
        folders, files = [self.root], []
        while folders and len(folders) < 4 * self.shares and len(folders) + len(files) < FANOUT:
            below: list[str] = []
            for folder in folders:
                with os.scandir(folder) as entries:
                    for entry in entries:
                        (below if entry.is_dir(follow_symlinks=False) else files).append(entry.path)
            folders = below
        folders, files = sorted(folders), sorted(files)
        dealt = [Share(folders[n::self.shares], files[n::self.shares]) for n in range(self.shares)]
        return [share for share in dealt if share.folders or share.files] or [Share([], [])]

    def read(self, partition: Share) -> Iterator[tuple]:
        for path in partition.files:
            yield from self._row(path)
        for folder in partition.folders:
            for place, _, names in os.walk(folder):
                for name in names:
                    yield from self._row(os.path.join(place, name))

    def _row(self, path: str) -> Iterator[tuple]:
        name = os.path.basename(path)
        stem, dot, extension = name.rpartition(".")
        if not dot or not stem:
            stem, extension = name, ""
        if self.extensions is not None and extension not in self.extensions:
            return
        try:
            found = os.stat(path)
        except FileNotFoundError:  # gone since it was listed
            return
        yield path, name, stem, extension, found.st_size, datetime.fromtimestamp(found.st_mtime, timezone.utc)


class FilteringMediaReader(MediaReader):
    """Spark takes a reader that filters only where its setting for it is on."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Comparisons of the extension are settled while walking, everything else is left to Spark."""
        for wanted in filters:
            if isinstance(wanted, EqualTo) and wanted.attribute == ("extension",):
                values = {wanted.value}
            elif isinstance(wanted, In) and wanted.attribute == ("extension",):
                values = set(wanted.value)
            else:
                yield wanted
                continue
            self.extensions = values if self.extensions is None else self.extensions & values


class MediaFiles(DataSource):
    """``spark.read.format("media_files").load(folder)``; options: ``shares`` (partitions), ``extensions`` (comma-separated), ``pushdown``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> MediaReader:
        listed = self.options.get("extensions")
        kind = FilteringMediaReader if self.options.get("pushdown") == "true" else MediaReader
        return kind(self.options["path"], int(self.options.get("shares", "32")), set(listed.split(",")) if listed else None)


def media_files(spark: SparkSession, folder: str, shares: int = 32) -> DataFrame:
    """Files below a folder that every executor has mounted: path, name, stem, extension (as written, without dot), length, modified.

    Links to folders are not followed. Filters on ``extension`` reach the walk where ``spark.sql.python.filterPushdown.enabled``
    is set. Files of stores that only Spark reads are listed by ``catalog.list_files``.
    """
    spark.dataSource.register(MediaFiles)
    pushdown = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format(FORMAT).option("shares", shares).option("pushdown", pushdown).load(folder)
