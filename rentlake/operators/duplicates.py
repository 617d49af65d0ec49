"""Soft duplicate links between listings with the same match key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentlake.functions import keys


def distinct_match_keys(listings: DataFrame) -> DataFrame:
    return listings.where("dismissed_at is null and property_match_key is not null").select("property_match_key").distinct()


def backfill_match_keys(listings: DataFrame) -> DataFrame:
    """Compute the key of active rows that lack one."""
    c = F.col
    street = keys.street_key(keys.street_text(c("location_hint"), c("title"), c("raw_snippet")))
    key = keys.match_key(street, c("rent_eur"), c("rooms"))
    filled = F.coalesce(c("property_match_key"), F.when(c("dismissed_at").isNull(), key))
    return listings.withColumn("property_match_key", filled)


def primaries(listings: DataFrame) -> DataFrame:
    """Oldest active listing per key; an aggregate, so a hot key combines before the shuffle."""
    return (
        listings.where("dismissed_at is null and property_match_key is not null")
        .groupBy("property_match_key")
        .agg(F.min(F.struct("first_seen_at", "id")).alias("_p"))
        .select("property_match_key", F.col("_p.id").alias("primary_id"))
    )


def reconcile(listings: DataFrame) -> DataFrame:
    """Point every active listing at the oldest one of its key; ``link_changed`` tells what moved."""
    old = F.col("possible_duplicate_of_id")
    active = F.col("dismissed_at").isNull() & F.col("property_match_key").isNotNull()
    link = F.when(active, F.nullif(F.col("primary_id"), F.col("id"))).otherwise(old)
    return (
        listings.join(primaries(listings), "property_match_key", "left")
        .withColumn("_link", link)
        .withColumn("link_changed", ~F.col("_link").eqNullSafe(old))
        .withColumn("possible_duplicate_of_id", F.col("_link"))
        .select(*listings.columns, "link_changed")
    )
