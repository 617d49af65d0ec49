"""Coordinates, distance and proximity score per listing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentlake.criteria import Criteria
from rentlake.functions import places
from rentlake.functions.regex import half_up
from rentlake.session import cut_lineage


def with_query(listings: DataFrame, c: Criteria) -> DataFrame:
    asked = places.with_geocode_query(listings, F.col("location_hint"), F.col("title"), "geo_query", c.city_suffix)
    return asked.withColumn("geo_key", places.geocode_key(F.col("geo_query")))


def one_point_per_key(points: DataFrame) -> DataFrame:
    """Key to point; a repeated key keeps the smallest point."""
    return points.groupBy("query_key").agg(F.min(F.struct("lat", "lng")).alias("p")).select(
        "query_key", F.col("p.lat").alias("lat"), F.col("p.lng").alias("lng")
    )


def lookup(keyed: DataFrame, c: Criteria, cache: DataFrame, gazetteer: DataFrame, fallback: DataFrame) -> DataFrame:
    """Distinct keys to points: cache, then gazetteer, then (if allowed) fallback gazetteer.

    The tables are united with a rank and reduced to one point per key before the join,
    so each key is looked up once however many listings ask for it.
    """
    tables = [(cache, "cache", 0), (gazetteer, "gazetteer", 1)]
    if c.use_fallback_places:
        tables.append((fallback, "fallback", 2))
    ranked = None
    for table, name, rank in tables:
        part = table.select(
            "query_key", F.struct(F.lit(rank).alias("rank"), F.lit(name).alias("source"), "lat", "lng").alias("p")
        )
        ranked = part if ranked is None else ranked.unionByName(part)
    wanted = keyed.where(F.col("geo_key").isNotNull()).select(F.col("geo_key").alias("query_key")).distinct()
    best = ranked.join(wanted, "query_key", "left_semi").groupBy("query_key").agg(F.min("p").alias("p"))
    return best.select(F.col("query_key").alias("geo_key"), "p.rank", F.col("p.source").alias("found_source"),
                       F.col("p.lat").alias("found_lat"), F.col("p.lng").alias("found_lng"))


def resolve(
    listings: DataFrame, c: Criteria, cache: DataFrame, gazetteer: DataFrame, fallback: DataFrame, as_of: str | None = None
) -> DataFrame:
    """Listings with point, distance to the reference point and proximity score.

    With proximity switched off the stored distance and score stay as they are.
    """
    if not c.proximity_enabled:
        return listings
    located = F.col("lat").isNotNull() & F.col("lng").isNotNull()
    keyed = with_query(listings, c)
    # Read twice: once for the distinct keys, once to join the points back.
    ask = cut_lineage(keyed.withColumn("geo_key", F.when(~located, F.col("geo_key"))))
    joined = ask.join(lookup(ask, c, cache, gazetteer, fallback), "geo_key", "left")
    lat = F.when(located, F.col("lat")).otherwise(F.col("found_lat"))
    lng = F.when(located, F.col("lng")).otherwise(F.col("found_lng"))
    found = ~located & F.col("found_lat").isNotNull()
    stamped = F.lit(as_of).cast("timestamp")
    moved = joined.select(
        *[n for n in listings.columns if n not in ("lat", "lng", "geocode_source", "geocoded_at")],
        "geo_key", "geo_query", F.col("rank").alias("geo_rank"),
        lat.alias("lat"), lng.alias("lng"),
        F.when(found, F.col("found_source")).otherwise(F.col("geocode_source")).alias("geocode_source"),
        F.when(found, stamped).otherwise(F.col("geocoded_at")).alias("geocoded_at"),
    )
    meters = half_up(
        places.haversine_m(F.col("lat"), F.col("lng"), F.lit(float(c.reference_lat)), F.lit(float(c.reference_lng)))
    ).cast("int")
    measured = moved.withColumn("distance_to_ref_m", meters)
    score = F.when(
        F.col("distance_to_ref_m").isNull(), F.lit(c.missing_score)
    ).otherwise(places.distance_score(F.col("distance_to_ref_m"), c.buckets, c.missing_score))
    return measured.withColumn("proximity_score", score.cast("int"))


def new_cache_rows(resolved: DataFrame, cache: DataFrame, as_of: str | None = None) -> DataFrame:
    """Points found outside the cache, one row per key, ready to append."""
    fresh = resolved.where("geo_rank > 0").groupBy("geo_key").agg(
        F.min(F.struct("geo_query", "lat", "lng", "geocode_source")).alias("p")
    )
    rows = fresh.select(
        F.col("geo_key").alias("query_key"), F.col("p.geo_query").alias("query_raw"), "p.lat", "p.lng",
        F.col("p.geocode_source").alias("source"), F.lit(as_of).cast("timestamp").alias("created_at"),
    )
    return rows.join(cache.select("query_key"), "query_key", "left_anti")
