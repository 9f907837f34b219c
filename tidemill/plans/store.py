"""Materialized relations in files, counted in pages."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from .keys import pages


@dataclass
class Entry:
    """columns: of each column the expression that it holds, by which a query finds its own names."""

    path: str
    columns: dict[tuple, str]
    schema: object
    pages: int
    rows: int
    pins: int = 0


@dataclass
class Store:
    """A folder with a budget of 4096-byte pages; None is no limit."""

    spark: SparkSession
    root: str
    budget: int | None = None
    entries: dict = field(default_factory=dict)
    written_pages: int = 0
    deleted: int = 0
    number: int = 0

    @property
    def used(self) -> int:
        return sum(e.pages for e in self.entries.values())

    @property
    def over(self) -> int:
        """Pages over the budget."""
        return 0 if self.budget is None else max(0, self.used - self.budget)

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def put(self, key: tuple, df: DataFrame, columns: dict[tuple, str]) -> Entry:
        """Write a relation. Its size is that of its files."""
        self.number += 1
        path = f"{self.root}/{hashlib.sha256(repr(key).encode()).hexdigest()[:24]}-{self.number}"
        df.write.mode("overwrite").parquet(path)
        p, fs = self._fs(path)
        rows = self.spark.read.schema(df.schema).parquet(path).count()
        entry = Entry(path, columns, df.schema, max(1, pages(fs.getContentSummary(p).getLength())), rows)
        self.entries[key] = entry
        self.written_pages += entry.pages
        return entry

    def read(self, key: tuple) -> DataFrame:
        e = self.entries[key]
        return self.spark.read.schema(e.schema).parquet(e.path)

    def delete(self, key: tuple) -> None:
        e = self.entries[key]
        if e.pins:
            raise ValueError("a pinned relation is in use")
        del self.entries[key]
        p, fs = self._fs(e.path)
        fs.delete(p, True)
        self.deleted += 1

    def file_pages(self, df: DataFrame) -> int | None:
        """Pages of the files that a table reads; None if it is not read from files."""
        total = 0
        for f in df.inputFiles():
            p, fs = self._fs(f)
            total += fs.getFileStatus(p).getLen()
        return pages(total) or None
