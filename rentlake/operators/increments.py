"""The listing table kept up to date batch by batch, at the cost of the batch.

A draft can only meet listings of its own URL and listings that hold its fingerprint, so a batch looks
up those and merges against them.  Who holds a fingerprint, and which active listings share a match
key, are tables of their own, laid out by fingerprint and by key.

Duplicate links depend on a key's oldest active listing.  A batch regroups the keys that its changed
rows left or entered; only where the oldest listing of a key is another one than before are the other
listings of that key read and linked again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rentlake.operators.duplicates import backfill_match_keys
from rentlake.operators.upsert import LISTING_SCHEMA, Merge, keyed, merge_keyed
from rentlake.session import any_size, cut_lineage, scratch
from rentlake.sources.keyed import Keyed
from rentlake.sources.store import Store

_URL = ["canonical_url"]
_HOLDER = ["listing_fingerprint", "canonical_url"]
_MEMBER = ["property_match_key", "canonical_url"]


def _holders(rows: DataFrame) -> DataFrame:
    return rows.where("listing_fingerprint is not null").select(*_HOLDER)


def _members(rows: DataFrame) -> DataFrame:
    return rows.where("dismissed_at is null and property_match_key is not null").select(*_MEMBER, "id", "first_seen_at")


def _oldest(members: DataFrame, name: str) -> DataFrame:
    oldest = F.min(F.struct("first_seen_at", "id")).alias("_oldest")
    return members.groupBy("property_match_key").agg(oldest).select("property_match_key", F.col("_oldest.id").alias(name))


def _linked(rows: DataFrame, oldest: DataFrame) -> DataFrame:
    """Active rows point at the oldest listing of their key; all others keep what they had."""
    active = F.col("dismissed_at").isNull() & F.col("property_match_key").isNotNull()
    link: Column = F.when(active, F.nullif(F.col("primary_id"), F.col("id"))).otherwise(F.col("possible_duplicate_of_id"))
    return rows.join(any_size(oldest), "property_match_key", "left").withColumn("possible_duplicate_of_id", link).select(*rows.columns)


class Listings:
    """Listing rows by URL, with the lookups that a merge needs."""

    def __init__(self, store: Store, buckets: int = 64, fold_every: int = 16):
        size = {"buckets": buckets, "fold_every": fold_every}
        self.rows = Keyed(store, "listing_rows", LISTING_SCHEMA, _URL, **size)
        self.holders = Keyed(store, "listing_holders", "listing_fingerprint string, canonical_url string", _HOLDER, **size)
        self.members = Keyed(store, "listing_members", "property_match_key string, canonical_url string, id string, first_seen_at timestamp", _MEMBER, **size)

    def merge(self, version: int, drafts: DataFrame) -> Merge:
        """Apply drafts as ``upsert.merge`` does; ``listings`` of the result are those that the drafts could meet."""
        spark = drafts.sparkSession
        with scratch(spark):
            with scratch(spark):
                batch = cut_lineage(keyed(drafts))
                holders = self.holders.lookup(batch.select(F.col("fingerprint").alias("listing_fingerprint")), version)
                wanted = cut_lineage(batch.select(*_URL).unionAll(holders.select(*_URL)).distinct())
                old = cut_lineage(self.rows.lookup(wanted, version), 1)
                merged = merge_keyed(old, batch, 2)
            changed = any_size(cut_lineage(merged.changes.select(F.col("target_url").alias("canonical_url")).distinct()))
            after = backfill_match_keys(merged.listings.join(changed, _URL, "left_semi").select(*merged.listings.columns))
            self.put(version, cut_lineage(old.join(changed, _URL, "left_semi")), cut_lineage(after))
        return merged

    def put(self, version: int, before: DataFrame, after: DataFrame) -> None:
        """Replace rows: ``before`` as they are stored, ``after`` as they are to be; what is only in ``before`` goes.

        Both are read several times, a few columns each: give written tables, or selections of them.
        """
        before, after = before.select(*self.rows.columns), after.select(*self.rows.columns)
        left, entered = _members(before), _members(after)
        known = cut_lineage(self.members.lookup(left.select("property_match_key").unionAll(entered.select("property_match_key")), version))
        stay = known.join(any_size(left), _MEMBER, "left_anti")
        oldest = cut_lineage(_oldest(stay.unionByName(entered), "primary_id"))
        moved = oldest.join(any_size(_oldest(known, "was")), "property_match_key", "left").where(F.col("primary_id") != F.col("was")).drop("was")
        others = stay.join(any_size(moved), "property_match_key", "left_semi").join(any_size(after.select(*_URL)), _URL, "left_anti")
        again = self.rows.lookup(cut_lineage(others.select(*_URL)), version)
        rows = _linked(after, oldest).unionByName(_linked(again, oldest))
        less = lambda rows, other, keys: rows.join(any_size(other.select(*keys)), keys, "left_anti")
        self.holders.write(version, less(_holders(after), _holders(before), _HOLDER), less(_holders(before), _holders(after), _HOLDER))
        self.members.write(version, entered, less(left, entered, _MEMBER))
        self.rows.write(version, rows, less(before, after, _URL))
