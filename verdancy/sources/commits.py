"""Batches of a table under a folder, each committed as a whole or not at all.

A batch's rows are written to a folder of their own under data/. Creating one empty folder, commits/<batch>/<version>,
then commits them: that is a single step of the file system. Readers see the highest version of each batch; what was
written but never committed, or was replaced, is never read.
"""

from __future__ import annotations

import uuid
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession


class Batches:
    """Committed batches of rows of one schema. Any text but the empty one names a batch; it is quoted in paths."""

    def __init__(self, spark: SparkSession, folder: str, schema: str):
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), schema

    def _path(self, at: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(at)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, at: str) -> list[str]:
        path, fs = self._path(at)
        return sorted(f.getPath().getName() for f in fs.listStatus(path)) if fs.exists(path) else []

    def committed(self) -> dict[str, str]:
        """The version that counts of each batch, by name."""
        found = {}
        for batch in self._names(f"{self.folder}/commits"):
            if versions := self._names(f"{self.folder}/commits/{batch}"):
                found[unquote(batch)] = versions[-1]
        return found

    def write(self, rows: DataFrame) -> str:
        """Writes rows that aren't committed yet, and returns what commit() takes."""
        name = uuid.uuid4().hex
        rows.write.parquet(f"{self.folder}/data/{name}")
        return name

    def commit(self, batch: str, written: str) -> None:
        """Makes written rows the batch's, in place of those it has."""
        if not batch:
            raise ValueError("a batch needs a name")
        at = f"{self.folder}/commits/{quote(batch, safe='')}"
        versions = self._names(at)
        number = int(versions[-1].split("-")[0]) + 1 if versions else 0
        path, fs = self._path(f"{at}/{number:09d}-{written}")
        fs.mkdirs(path)

    def put(self, batch: str, rows: DataFrame, again: bool = True) -> bool:
        """Writes and commits a batch. With again=False a batch that is there stays as it is, and nothing is computed. Returns whether it was written."""
        if not again and batch in self.committed():
            return False
        self.commit(batch, self.write(rows))
        return True

    def read(self) -> DataFrame:
        """Rows of all committed batches."""
        found = [f"{self.folder}/data/{version.split('-')[1]}" for version in self.committed().values()]
        return self.spark.read.schema(self.schema).parquet(*found) if found else self.spark.createDataFrame([], self.schema)
