"""A collection of files as a table, read by a data source of its own.

Spark's file source has no nanosecond times and follows links, so the walk is a
Python data source.  The driver opens directories breadth first until there are
``SHARES`` of them; each of these is a partition, with all below it where it was
not opened itself.  Tasks walk them without following links.
"""

from __future__ import annotations

import os
import re
from collections import deque
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from framewise.functions.files import GENERATED_DIRECTORY, SYSTEM_DIRECTORIES, casefold, file_name, is_source_image, parent

SCHEMA = "file_path string, size_bytes long, modified_ns long, error string"
SHARES = 256
_GENERATED = re.compile(GENERATED_DIRECTORY)


def _pruned(name: str) -> bool:
    return name.lower() in SYSTEM_DIRECTORIES or bool(_GENERATED.match(name))


class _Directory(InputPartition):
    def __init__(self, path: str, deep: bool) -> None:
        super().__init__(path)
        self.path, self.deep = path, deep


class _Reader(DataSourceReader):
    def __init__(self, root: str, output: str | None) -> None:
        self.root, self.output = root, output and os.path.abspath(output)

    def _left_out(self, entry: os.DirEntry) -> bool:
        return _pruned(entry.name) or (self.output is not None and os.path.abspath(entry.path) == self.output)

    def partitions(self) -> list[_Directory]:
        opened, closed = [], deque([self.root])
        while closed and len(opened) + len(closed) < SHARES:
            path = closed.popleft()
            opened.append(_Directory(path, False))
            try:
                with os.scandir(path) as found:
                    closed += sorted(e.path for e in found if e.is_dir(follow_symlinks=False) and not self._left_out(e))
            except OSError:
                if path == self.root:
                    raise  # else its task tells
        return opened + [_Directory(p, True) for p in closed]

    def read(self, partition: _Directory) -> Iterator[tuple]:
        todo = [partition.path]
        while todo:
            path = todo.pop()
            try:
                with os.scandir(path) as found:
                    for e in found:
                        if e.is_symlink():
                            continue
                        if e.is_dir():
                            if partition.deep and not self._left_out(e):
                                todo.append(e.path)
                        elif e.is_file():
                            s = e.stat()
                            yield e.path, s.st_size, s.st_mtime_ns, None
            except OSError as error:  # an unreadable directory is a row, not the end of the scan
                yield path, None, None, str(error)


class CollectionSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "collection"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:  # noqa: ANN001
        return _Reader(self.options["path"], self.options.get("output"))


def scan(spark: SparkSession, root: str, output: str | None = None) -> DataFrame:
    """Every file below ``root``, but not those below the folder ``output`` of earlier runs: ``file_path, size_bytes, modified_ns, error``."""
    spark.dataSource.register(CollectionSource)
    source = spark.read.format("collection").option("path", root)
    return (source if output is None else source.option("output", output)).load()


def images(files: DataFrame) -> DataFrame:
    """The supported images of a scan, with ``parent, name`` and the ``path_key`` that orders them."""
    kept = files.where(F.col("error").isNull() & is_source_image(F.col("file_path")))
    return kept.withColumns({"parent": parent(F.col("file_path")), "name": file_name(F.col("file_path")), "path_key": casefold("file_path")})
