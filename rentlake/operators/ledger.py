"""What has been processed, so that nothing is processed twice.

Rows lie by day of receipt, and their ids a second time by hash.  A feed delivers its last hours again in every
run, so nearly all ids of a batch are found on the days the batch holds, and only those days are read.
What is left is looked up among all ids, in the parts these ids can lie in: an id that comes back with another
time, or beyond the lookback, is known all the same.

A null id is never known; a null time is a day of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentlake.operators.tables import unseen
from rentlake.session import cut_lineage
from rentlake.sources.keyed import Keyed
from rentlake.sources.store import Store


class Ledger:
    """``key`` is the id and ``time`` the time of receipt, both columns of ``schema``."""

    def __init__(self, store: Store, table: str, schema: str, key: str, time: str, buckets: int = 64, fold_every: int = 16):
        self.store, self.table, self.schema, self.key, self.time = store, table, schema, key, time
        types = dict(store.spark.createDataFrame([], schema).dtypes)
        self.ids = Keyed(store, f"{table}_ids", f"{key} {types[key]}, {time} {types[time]}", [key], buckets=buckets, fold_every=fold_every)

    def near(self, rows: DataFrame, before: int | None = None) -> DataFrame:
        """Ledger rows of the days that ``rows`` hold."""
        days = [r[0] for r in rows.select(F.to_date(self.time)).distinct().collect()]  # one row per day of the batch
        return self.store.read_days(self.table, self.schema, days=days, before=before)

    def unseen(self, rows: DataFrame, before: int | None = None) -> DataFrame:
        """Rows whose id no version (older than ``before``) holds."""
        left = cut_lineage(unseen(rows, self.near(rows, before), self.key))
        return unseen(left, self.ids.lookup(left, before), self.key)

    def write(self, version: int, rows: DataFrame) -> None:
        """Add rows; adding a version again replaces it."""
        columns = self.store.spark.createDataFrame([], self.schema).columns
        self.store.write(self.table, version, rows.select(*columns), day=self.time)
        newest = F.max(self.time).alias(self.time)  # the keys of the id table are never null and stand once
        self.ids.write(version, rows.where(F.col(self.key).isNotNull()).groupBy(self.key).agg(newest))
