"""Geocode keys, distances and proximity scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rentlake import fixed_values as V
from rentlake.functions.keys import fold
from rentlake.functions.regex import collapse, filled, half_up, js, stages, strip


def geocode_key(query: Column) -> Column:
    return fold(query)


def tidy_query(query: Column) -> Column:
    bare = collapse(F.regexp_replace(query, js(V.SNC), ""))
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r" +,", ","), r",\s*,", ","))


def with_geocode_query(df: DataFrame, hint: Column, title: Column, out: str, suffix: str | None = None) -> DataFrame:
    """Hint, else title; NULL if shorter than five; city added unless named."""
    raw = F.col(f"_{out}_raw")
    query = raw
    if suffix and suffix.strip():
        low = F.lower(raw)
        named = F.contains(low, F.lit("torino")) | F.contains(low, F.lit("turin"))
        query = F.when(named, raw).otherwise(F.concat(raw, F.lit(", " + suffix.strip())))
    source = F.coalesce(filled(strip(hint)), filled(strip(title)), F.lit(""))
    return stages(
        df, {f"_{out}_raw": collapse(source)}, {out: F.when(F.length(raw) >= 5, tidy_query(query))}
    ).drop(f"_{out}_raw")


def haversine_m(lat1, lng1, lat2, lng2) -> Column:
    d_lat, d_lng = F.radians(lat2 - lat1), F.radians(lng2 - lng1)
    h = F.pow(F.sin(d_lat / 2), F.lit(2)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(
        F.sin(d_lng / 2), F.lit(2)
    )
    return F.lit(2.0 * V.EARTH_RADIUS_M) * F.asin(F.when(h > 1, F.lit(1.0)).otherwise(F.sqrt(h)))


def distance_score(meters: Column, buckets, missing: int = 5) -> Column:
    """Score of the first bucket that reaches the distance, 0 beyond all."""
    score = F.lit(0)
    for reach, points in sorted(buckets, reverse=True):
        score = F.when(meters <= reach, F.lit(points)).otherwise(score)
    usable = meters.isNotNull() & ~F.isnan(meters.cast("double")) & (meters >= 0)
    return F.when(usable & (meters.cast("double") != float("inf")), score).otherwise(F.lit(missing))


def distance_text(meters: Column) -> Column:
    """``~650 m`` or ``~1.5 km``; a quarter kilometre rounds up."""
    km = F.replace(F.format_number(meters / 1000, 1), F.lit(","), F.lit(""))
    quarter = F.concat(F.floor(meters / 1000).cast("string"), F.lit(".3"))
    return F.when(meters < 1000, F.concat(F.lit("~"), half_up(meters).cast("string"), F.lit(" m"))).otherwise(
        F.concat(F.lit("~"), F.when(meters % 1000 == 250, quarter).otherwise(km), F.lit(" km"))
    )
