"""Keyed tables that a batch changes in place: a base and the changes since.

A batch writes only the rows it changes, so its cost follows the batch and not the table.  The newest
row of a key counts.  Rows are laid out by a hash of one column, and a lookup reads only the parts that
its keys can lie in.  Every ``fold_every`` batches base and changes become the next base: a reader
opens one base and fewer than that many changes, however long the table has lived.  Versions
before the last base but one are dropped.

A batch gives a key at most once.  It reads what stood before its own version and writes that version
only, so running it again gives the same rows.

A batch of any size is written by as many tasks as its rows need, however few the parts: a large part is
dealt out by a hash of the keys, and further by its size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rentlake.session import any_size
from rentlake.sources.store import Store

#: So many keys looked up may go to every task; more are joined where they lie.
FEW = 1 << 16
#: Shares that the parts of a table are dealt into together, where a batch has rows enough.
SHARES = 64


class Keyed:
    """``keys`` tell rows apart and are never null; ``by`` is the one rows are laid out by (the first key, if not given)."""

    def __init__(self, store: Store, table: str, schema: str, keys: list[str], by: str | None = None, buckets: int = 64, fold_every: int = 16):
        self.store, self.table, self.base = store, table, f"{table}_base"
        self.schema, self.keys, self.by = schema, keys, by or keys[0]
        self.buckets, self.fold_every = buckets, fold_every
        self.columns = store.spark.createDataFrame([], schema).columns

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.by), F.lit(self.buckets)).cast("int")

    def _parts(self, before: int | None) -> tuple[list[int], list[int]]:
        """The base a reader starts from (one or none) and the changes on top of it."""
        usable = lambda table: [v for v in self.store.versions(table) if before is None or v < before]
        base = usable(self.base)[-1:]
        return base, [v for v in usable(self.table) if not base or v > base[0]]

    def _scan(self, table: str, versions: list[int], buckets: list[int] | None) -> DataFrame:
        spark = self.store.spark
        schema = f"{self.schema}, gone boolean, version bigint, bucket int"
        if not versions:
            return spark.createDataFrame([], schema).limit(0)  # known to be empty before it runs
        reader = spark.read.schema(schema).option("basePath", f"{self.store.root}/{table}")
        rows = reader.parquet(*[self.store.path(table, v) for v in versions])
        return rows if buckets is None else rows.where(F.col("bucket").isin(buckets))

    def _state(self, before: int | None, buckets: list[int] | None = None, wanted: DataFrame | None = None) -> DataFrame:
        base, changes = self._parts(before)
        only = lambda rows: rows if wanted is None else rows.join(wanted, self.by, "left_semi")
        old = only(self._scan(self.base, base, buckets)).select(*self.columns) if base else None
        if not changes:
            return self._scan(self.base, [], None).select(*self.columns) if old is None else old
        new = only(self._scan(self.table, changes, buckets))
        rows = new
        if len(changes) > 1:
            # A window and not max_by of whole rows: only the columns that the reader selects are moved.
            newest = F.max("version").over(Window.partitionBy(*self.keys))
            rows = new.withColumn("_newest", newest).where("version = _newest")
        now = rows.where(~F.col("gone")).select(*self.columns)
        return now if old is None else old.join(any_size(new.select(*self.keys)), self.keys, "left_anti").unionByName(now)

    def read(self, before: int | None = None) -> DataFrame:
        """All rows, or those that stood before a version."""
        return self._state(before)

    def lookup(self, wanted: DataFrame, before: int | None = None) -> DataFrame:
        """Rows whose ``by`` column is among the ``wanted``; only parts that can hold them are read."""
        if not any(self._parts(before)):
            return self._state(before)
        wanted = wanted.select(self.by).where(F.col(self.by).isNotNull())
        near = dict(wanted.groupBy(self.bucket()).count().collect())  # at most one per bucket
        keys = wanted.distinct() if sum(near.values()) <= FEW else any_size(wanted.distinct())
        return self._state(before, [*near] if len(near) < self.buckets else None, keys)

    def write(self, version: int, rows: DataFrame, gone: DataFrame | None = None) -> None:
        """Put rows in, and take away those whose keys (and ``by``) are in ``gone``."""
        put = rows.select(*self.columns, F.lit(False).alias("gone"))
        if gone is not None:
            away = gone.select(*{*self.keys, self.by}, F.lit(True).alias("gone"))
            put = put.unionByName(away, allowMissingColumns=True)
        self._write(self.table, version, put)
        base, changes = self._parts(version + 1)
        if len(changes) >= self.fold_every:
            self._write(self.base, version, self.read(version + 1).withColumn("gone", F.lit(False)))
            self._drop(base[0] if base else 0)

    def _write(self, table: str, version: int, rows: DataFrame) -> None:
        share = F.pmod(F.hash(*self.keys), F.lit(-(-SHARES // self.buckets)))  # another hash than that of the parts
        placed = rows.withColumns({"bucket": self.bucket(), "_share": share}).hint("rebalance", "bucket", "_share").drop("_share")
        with self.store.writing(table, version):
            placed.write.mode("overwrite").partitionBy("bucket").parquet(self.store.path(table, version))

    def _drop(self, last: int) -> None:
        """Versions that no batch after the base ``last`` reads."""
        for table, unread in ((self.base, lambda v: v < last), (self.table, lambda v: v <= last)):
            for v in self.store.versions(table):
                if unread(v):
                    self.store.drop(table, v)
