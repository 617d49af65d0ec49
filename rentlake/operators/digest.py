"""Ranking, filtering and layout of the digest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rentlake import fixed_values as V
from rentlake.criteria import Criteria
from rentlake.functions import alerts, cards, posts, rules
from rentlake.functions.regex import filled
from rentlake.operators.scoring import with_latest


def with_primary(listings: DataFrame) -> DataFrame:
    """Listings with the listing they duplicate as a struct, NULL if none."""
    primary = listings.select(
        F.col("id").alias("_pid"), F.struct("id", "source", "canonical_url", "title").alias("possible_duplicate_of")
    )
    return listings.join(primary, F.col("possible_duplicate_of_id") == F.col("_pid"), "left").drop("_pid")


def digest_view(listings: DataFrame, scores: DataFrame) -> DataFrame:
    """Active listings with their latest score and their primary."""
    scored = with_latest(with_primary(listings).where("dismissed_at is null"), scores, "inner")
    return scored.select(
        *listings.columns, "possible_duplicate_of",
        F.col("s_score").alias("score"), F.col("s_reasons").alias("reasons"), F.col("s_summary").alias("summary"),
        F.col("s_risk_level").alias("risk_level"), F.col("s_risk_reasons").alias("risk_reasons"),
    )


def rank_order() -> list[Column]:
    """Not high risk first, then the better score, then the id."""
    return [F.coalesce(F.col("risk_level") == "high", F.lit(False)).asc(), F.col("score").desc(), F.col("id").asc()]


def may_send(sent_at: Column, price_changed_at: Column, dismissed_at: Column) -> Column:
    """Never sent, or sent before the last price change; dismissed ones never."""
    return dismissed_at.isNull() & (sent_at.isNull() | F.coalesce(sent_at < price_changed_at, F.lit(False)))


def with_skip_reason(view: DataFrame, c: Criteria, min_score: int = 25, min_rent: int = 200) -> DataFrame:
    """Add why a listing is left out, checked in this order; NULL if it goes in."""
    k = F.col
    # The digest row carries no snippet, so avoid phrases are looked for in hint and title.
    text = rules.search_text(F.lit(None).cast("string"), k("location_hint"), k("title"))
    casa_ok = (
        k("rent_eur").isNotNull()
        & alerts.is_meaningful_title(k("title"))
        & (k("area_sqm").isNotNull() | filled(k("location_hint")).isNotNull())
    )
    post_ok = posts.digest_ready(k("title"), k("_clean_title"), k("rent_eur"), k("area_sqm"), k("rooms"), k("location_hint"))
    reason = (
        F.when((k("source") == "casa.it") & ~casa_ok, F.lit("incomplete alert"))
        .when((k("source") == V.POST_SOURCE) & ~post_ok, F.lit("incomplete post"))
        .when(~rules.meets_hard(c, k("_digest_text"), k("rooms"), k("area_sqm"), k("rent_eur"), k("condo_fee_eur")), F.lit("hard criteria"))
        .when(k("score") < min_score, F.lit("low score"))
        .when(k("rent_eur") < min_rent, F.lit("low rent"))
        .when(~may_send(k("sent_at"), k("price_changed_at"), k("dismissed_at")), F.lit("already sent"))
    )
    cleaned = view.withColumns({"_clean_title": posts.clean(F.coalesce("title", F.lit(""))), "_digest_text": text})
    return cleaned.withColumn("skip_reason", reason).drop("_clean_title", "_digest_text")


def top(view: DataFrame, n: int) -> DataFrame:
    return view.orderBy(*rank_order()).limit(n)


def selection(view: DataFrame, c: Criteria, top_n: int = 10, **limits) -> DataFrame:
    """The ``top_n`` best listings that pass every filter."""
    return top(with_skip_reason(view, c, **limits).where("skip_reason is null"), top_n)


def batches(chosen: DataFrame, per_run: int = 10, queue: bool = False) -> DataFrame:
    """Split a selection: normal cards take the budget first, suspicious ones fill the rest.

    With a queue behind it everything goes out and nothing is deferred.  ``chosen`` is a
    digest selection, at most ``top_n`` rows, so one window partition per class is small
    by construction.
    """
    suspicious = F.coalesce(F.col("risk_level") == "high", F.lit(False))
    ranked = chosen.withColumn("suspicious", suspicious).withColumn(
        "place", F.row_number().over(Window.partitionBy("suspicious").orderBy(F.col("score").desc(), "id"))
    )
    if queue:
        return ranked.withColumn("deferred", F.lit(False))
    normal = F.count(F.when(~F.col("suspicious"), 1)).over(Window.partitionBy())
    budget = F.when(F.col("suspicious"), F.greatest(F.lit(per_run) - normal, F.lit(0))).otherwise(F.lit(per_run))
    return ranked.withColumn("deferred", F.col("place") > budget)


def send_stats(chosen: DataFrame) -> DataFrame:
    """Counters of a split selection."""
    def count(condition):
        return F.count(F.when(condition, 1))

    bad, late = F.col("suspicious"), F.col("deferred")
    return chosen.agg(
        count(~bad & ~late).alias("normal"), count(bad & ~late).alias("suspicious"), count(late).alias("deferred")
    )


def schedule(split: DataFrame, header: str | Column, reference_name: str | None, start: str, delay_ms: int = 2500) -> DataFrame:
    """Header, normal cards, divider, suspicious cards, one every ``delay_ms``."""
    k = F.col
    row = {n: k(n) for n in split.columns}
    body = split.where(~k("deferred")).select(
        F.when(k("suspicious"), F.lit(3)).otherwise(F.lit(1)).alias("part"), "place",
        k("id").alias("listing_id"), cards.card(row, reference_name).alias("text"),
    )
    spark = split.sparkSession
    top_line = spark.range(1).select(
        F.lit(0).alias("part"), F.lit(1).alias("place"), F.lit(None).cast("string").alias("listing_id"),
        (F.lit(header) if isinstance(header, str) else header).alias("text"),
    )
    divider = (
        body.where("part = 3").groupBy().count().where("count > 0").select(
            F.lit(2).alias("part"), F.lit(1).alias("place"), F.lit(None).cast("string").alias("listing_id"),
            F.lit(V.SUSPICIOUS_DIVIDER).alias("text"),
        )
    )
    lines = top_line.unionByName(body).unionByName(divider)
    at = (F.row_number().over(Window.orderBy("part", "place")) - 1).alias("position")
    wait = F.make_interval(secs=F.col("position") * F.lit(max(0, delay_ms) / 1000).cast("decimal(18,6)"))
    return lines.select(at, "listing_id", "text").withColumn("send_at", F.lit(start).cast("timestamp") + wait)
