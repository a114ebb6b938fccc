"""Files that tasks read by byte ranges."""

from __future__ import annotations

import re
import struct

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

PAGE = 1 << 20


def listed(spark: SparkSession, path: str) -> DataFrame:
    """(path) of all files under path. Their contents are not read: the scan has no such column.
    Spark lists no empty files, so these have no row."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")


def store(path: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system of a path as Spark gives it, and the name in it."""
    local = re.match(r"(?:file:(?://(?=/))?)?(/.*)", path)
    return (fs.LocalFileSystem(), local.group(1)) if local else fs.FileSystem.from_uri(path)


class Pages:
    """A file of any size, of which two pages are held at most (or one piece that is larger than a page).

    Paths are as Spark lists them: of local or mounted folders, or of a store that Arrow has a file system for.
    """

    def __init__(self, path: str, page: int = PAGE) -> None:
        system, name = store(path)
        self._file = system.open_input_file(name)
        self.size, self._page, self._at, self._held = self._file.size(), page, 0, b""

    def __enter__(self) -> Pages:
        return self

    def __exit__(self, *error: object) -> None:
        self._file.close()

    def take(self, at: int, n: int) -> bytes:
        """n bytes from `at` on; fewer at the end of the file."""
        if at < self._at or at + n > self._at + len(self._held):
            self._at, self._held = at, self._file.read_at(max(0, min(max(n, self._page), self.size - at)), at)
        return self._held[at - self._at : at - self._at + n]

    def unpack(self, form: str, at: int) -> tuple:
        return struct.unpack(form, self.take(at, struct.calcsize(form)))
