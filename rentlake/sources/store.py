"""Stored tables: one parquet folder per table and version.

A version is written whole before the pointer to it changes, so a lost executor or a
repeated run leaves the last good version in place.  The pointers are empty files: ``_open/<version>`` stands
while a version is written and ``_done/<version>`` after, so finding the complete versions is one listing.

A table may be laid out by day instead, ``day=<date>/version=<version>``: a reader of some days lists and
opens only these, however long the table has lived.  Rows without a time have a folder of their own.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_NO_DAY = "__HIVE_DEFAULT_PARTITION__"


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, table: str, version: int | str) -> str:
        return f"{self.root}/{table}/version={version}"

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), target

    def _names(self, folder: str) -> list[str]:
        fs, target = self._fs(f"{self.root}/{folder}")
        return [status.getPath().getName() for status in fs.listStatus(target)] if fs.exists(target) else []

    def _marked(self, table: str, mark: str) -> list[int]:
        return sorted(int(name) for name in self._names(f"{table}/{mark}") if name.isdigit())

    def _mark(self, table: str, version: int, mark: str) -> None:
        fs, path = self._fs(f"{self.root}/{table}/{mark}/{version}")
        fs.create(path, True).close()

    def _unmark(self, table: str, version: int, mark: str) -> None:
        fs, path = self._fs(f"{self.root}/{table}/{mark}/{version}")
        fs.delete(path, False)

    def versions(self, table: str) -> list[int]:
        """Complete versions, oldest first."""
        names = self._names(table)
        if "_done" in names:
            return self._marked(table, "_done")
        if "_open" in names:
            return []
        # A table written by other means: Spark's own marker counts.
        found = [int(name.split("=")[1]) for name in names if name.startswith("version=")]
        return sorted(v for v in found if "_SUCCESS" in self._names(f"{table}/version={v}"))

    @contextmanager
    def writing(self, table: str, version: int) -> Iterator[bool]:
        """Around a write of a version: nobody reads it until it is whole.  Gives whether it was begun before."""
        known = self.versions(table)
        again = version in known or version in self._marked(table, "_open")
        if known and "_done" not in self._names(table):
            for old in known:
                self._mark(table, old, "_done")
        self._mark(table, version, "_open")
        self._unmark(table, version, "_done")
        yield again
        self._mark(table, version, "_done")
        self._unmark(table, version, "_open")

    def _by_day(self, table: str) -> dict[dt.date | None, str]:
        """Day folders of a table; empty if it is not laid out by day."""
        found = {name[4:]: f"{self.root}/{table}/{name}" for name in self._names(table) if name.startswith("day=")}
        return {None if day == _NO_DAY else dt.date.fromisoformat(day): path for day, path in found.items()}

    def _scan_days(self, table: str, schema: str, paths: list[str], before: int | None) -> DataFrame:
        columns = self.spark.createDataFrame([], schema).columns
        reader = self.spark.read.schema(f"{schema}, day date, version bigint").option("basePath", f"{self.root}/{table}")
        rows = reader.parquet(*paths)
        if before is not None:
            rows = rows.where(F.col("version") < before)
        begun = self._marked(table, "_open")  # seldom more than one
        return (rows.where(~F.col("version").isin(begun)) if begun else rows).select(*columns, "day", "version")

    def read(self, table: str, schema: str, before: int | None = None) -> DataFrame:
        """Newest complete version (older than ``before``, if given); empty if there is none."""
        usable = [v for v in self.versions(table) if before is None or v < before]
        if not usable:
            return self.spark.createDataFrame([], schema)
        days = self._by_day(table)
        if days:
            return self._scan_days(table, schema, list(days.values()), None).where(F.col("version") == usable[-1]).drop("day", "version")
        return self.spark.read.schema(schema).parquet(self.path(table, usable[-1]))

    def read_all(self, table: str, schema: str, before: int | None = None) -> DataFrame:
        """All rows appended so far, or by the versions older than ``before``."""
        days = self._by_day(table)
        if days:
            return self._scan_days(table, schema, list(days.values()), before).drop("day", "version")
        usable = [v for v in self.versions(table) if before is None or v < before]
        if not usable:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[self.path(table, v) for v in usable])

    def read_days(self, table: str, schema: str, days=None, first: dt.date | None = None, before: int | None = None) -> DataFrame:
        """Rows of the given ``days`` (None: those without a time), or of all days from ``first`` on.

        Only the folders of these days are listed and read.
        """
        wanted = None if days is None else set(days)
        keep = lambda day: day in wanted if wanted is not None else day is not None and (first is None or day >= first)
        paths = {day: path for day, path in self._by_day(table).items() if keep(day)}
        if not paths:
            return self.spark.createDataFrame([], schema)
        rows = self._scan_days(table, schema, list(paths.values()), before)
        dated = sorted(day for day in paths if day is not None)
        hit = F.col("day").between(dated[0], dated[-1]) if dated else F.lit(False)
        return rows.where(hit | F.col("day").isNull() if None in paths else hit).drop("day", "version")

    def write(self, table: str, version: int, rows: DataFrame, day: str | None = None) -> None:
        """Write a version; doing it again gives the same table.  ``day`` names the time column to lay rows out by."""
        with self.writing(table, version) as again:
            if day is None:
                rows.write.mode("overwrite").parquet(self.path(table, version))
                return
            if again:
                for folder in self._by_day(table).values():
                    fs, path = self._fs(f"{folder}/version={version}")
                    fs.delete(path, True)
            placed = rows.withColumns({"day": F.to_date(day), "version": F.lit(version).cast("bigint")})
            placed.write.mode("append").partitionBy("day", "version").parquet(f"{self.root}/{table}")

    def drop(self, table: str, version: int) -> None:
        self._unmark(table, version, "_done")
        fs, path = self._fs(self.path(table, version))
        fs.delete(path, True)
