"""Ledgers, metrics, export and maintenance of the stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rentlake.functions.regex import cut


def unseen(rows: DataFrame, ledger: DataFrame, key: str) -> DataFrame:
    """Rows whose id is not in the ledger yet."""
    return rows.join(ledger.select(key), key, "left_anti")


def found_per(rows: DataFrame, kept: DataFrame, key: str) -> DataFrame:
    """Number of kept drafts per row of the input, zero included."""
    counts = kept.groupBy(key).agg(F.count("*").cast("int").alias("listings_found"))
    return rows.join(counts, key, "left").withColumn("listings_found", F.coalesce("listings_found", F.lit(0)))


def message_ledger(messages: DataFrame, kept: DataFrame, as_of: str) -> DataFrame:
    return found_per(messages, kept, "message_id").select(
        "message_id", "subject", "from_address", "received_at", F.lit(as_of).cast("timestamp").alias("processed_at"),
        "listings_found",
    )


def post_ledger(posts: DataFrame, kept: DataFrame, as_of: str) -> DataFrame:
    return found_per(posts, kept, "post_id").select(
        "post_id", "group_id", "permalink", cut(F.col("message"), 500).alias("message"), "posted_at",
        F.lit(as_of).cast("timestamp").alias("processed_at"), "listings_found",
    )


def duplicate_skips_since(changes: DataFrame, time: str) -> DataFrame:
    """Number of drafts since a time that met a listing that was there already, one row."""
    return changes.where((F.col("seen_at") >= F.lit(time).cast("timestamp")) & ~F.col("is_new")).agg(F.count("*").alias("n"))


def row_counts(**tables: DataFrame) -> DataFrame:
    out = None
    for name, table in tables.items():
        part = table.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = part if out is None else out.unionByName(part)
    return out


def run_row(spark, run_id: str, started: str, finished: str | None, counters: dict[str, int], error: str | None = None) -> DataFrame:
    """One row of run metrics: running, completed or failed."""
    status = "failed" if error else ("completed" if finished else "running")
    names = ("messages_processed", "listings_parsed", "listings_new", "duplicates_skipped", "listings_scored", "cards_sent")
    values = [int(counters.get(n, 0)) for n in names]
    schema = "id string, started string, finished string, status string, " + ", ".join(f"{n} int" for n in names) + ", error_message string"
    row = spark.createDataFrame([(run_id, started, finished, status, *values, error)], schema)
    return row.select(
        "id", F.col("started").cast("timestamp").alias("started_at"), F.col("finished").cast("timestamp").alias("finished_at"),
        "status", *names, "error_message",
    )


def last_runs(runs: DataFrame, n: int = 20) -> DataFrame:
    return runs.orderBy(F.col("started_at").desc(), "id").limit(n)


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def plain_time(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.lit("—"))


def text_array(value: Column) -> Column:
    """JSON text to an array of strings; anything else gives an empty one."""
    return F.coalesce(
        F.try_variant_get(F.try_parse_json(value), "$", "array<string>"), F.array().cast("array<string>")
    )


def export_view(listings_with_score: DataFrame) -> DataFrame:
    """Listings with their latest score nested, texts cut and times as ISO text."""
    k = F.col
    score = F.when(
        k("s_scored_at").isNotNull(),
        F.struct(
            k("s_score").alias("score"), k("s_risk_level").alias("riskLevel"), k("s_risk_source").alias("riskSource"),
            k("s_model").alias("model"), k("s_reasons").alias("reasons"), k("s_risk_reasons").alias("riskReasons"),
            iso(k("s_scored_at")).alias("scoredAt"),
        ),
    )
    return listings_with_score.select(
        "id", F.coalesce("listing_url", "canonical_url").alias("url"), k("canonical_url").alias("canonicalUrl"),
        k("listing_url").alias("listingUrl"), "source", "title", k("location_hint").alias("locationHint"),
        k("address_raw").alias("addressRaw"), k("rent_eur").alias("rentEur"), k("condo_fee_eur").alias("condoFeeEur"),
        k("total_cost_eur").alias("totalCostEur"), k("area_sqm").alias("areaSqm"), "rooms", "floor",
        k("has_lift").alias("hasLift"), iso(k("first_seen_at")).alias("firstSeenAt"),
        iso(k("last_seen_at")).alias("lastSeenAt"), iso(k("price_changed_at")).alias("priceChangedAt"),
        iso(k("sent_at")).alias("sentAt"), iso(k("dismissed_at")).alias("dismissedAt"), iso(k("saved_at")).alias("savedAt"),
        cut(k("raw_snippet"), 200).alias("rawSnippet"), score.alias("latestScore"),
    )


def export_messages(ledger: DataFrame) -> DataFrame:
    """Ledger rows as the export spells them."""
    k = F.col
    return ledger.select(
        "message_id", "subject", k("from_address").alias("from"), iso(k("received_at")).alias("receivedAt"),
        iso(k("processed_at")).alias("processedAt"), k("listings_found").alias("listingsFound"),
    )


def export_runs(runs: DataFrame, n: int = 20) -> DataFrame:
    """The last runs as the export spells them."""
    k = F.col
    return last_runs(runs, n).select(
        "id", "status", iso(k("started_at")).alias("startedAt"), iso(k("finished_at")).alias("finishedAt"),
        k("messages_processed").alias("messagesProcessed"), k("listings_parsed").alias("listingsParsed"), k("listings_new").alias("listingsNew"),
        k("duplicates_skipped").alias("duplicatesSkipped"), k("listings_scored").alias("listingsScored"), k("cards_sent").alias("cardsSent"),
        k("error_message").alias("errorMessage"),
    )


def export(path: str, listings_with_score: DataFrame, scores: DataFrame, ledger: DataFrame, runs: DataFrame) -> None:
    """Write summary, listings, messages and runs as JSON lines, a folder each."""
    sections = {
        "summary": row_counts(listings=listings_with_score, listing_scores=scores, processed_messages=ledger, runs=runs),
        "listings": export_view(listings_with_score), "messages": export_messages(ledger), "runs": export_runs(runs),
    }
    for name, rows in sections.items():
        rows.write.mode("overwrite").json(f"{path}/{name}")


def mark_sent(listings: DataFrame, sent: DataFrame) -> DataFrame:
    """Stamp listings named in (listing_id, sent_at, message_id)."""
    one = sent.groupBy("listing_id").agg(F.max(F.struct("sent_at", "message_id")).alias("_m"))
    joined = listings.join(one, F.col("id") == F.col("listing_id"), "left")
    return joined.select(*[
        F.coalesce(F.col("_m.sent_at"), F.col("sent_at")).alias(n) if n == "sent_at"
        else F.coalesce(F.col("_m.message_id"), F.col("sent_message_id")).alias(n) if n == "sent_message_id"
        else F.col(n) for n in listings.columns
    ])


def mark_dismissed(listings: DataFrame, ids: DataFrame, as_of: str) -> DataFrame:
    gone = ids.select(F.col("listing_id").alias("_gone")).distinct()
    joined = listings.join(gone, F.col("id") == F.col("_gone"), "left")
    stamp = F.when(F.col("_gone").isNotNull(), F.lit(as_of).cast("timestamp")).otherwise(F.col("dismissed_at"))
    return joined.withColumn("dismissed_at", stamp).select(*listings.columns)


def _cleared(listings: DataFrame, names, where: Column) -> DataFrame:
    types = dict(listings.dtypes)
    return listings.select(*[
        F.when(~where, F.col(n)).otherwise(F.lit(None).cast(types[n])).alias(n) if n in names else F.col(n)
        for n in listings.columns
    ])


SENT = ("sent_at", "sent_message_id")
GEO = ("lat", "lng", "geocode_source", "geocoded_at", "distance_to_ref_m", "proximity_score")


def says(column: str, *words: str) -> Column:
    hit = F.lit(False)
    for word in words:
        hit = hit | F.coalesce(F.contains(F.col(column), F.lit(word)), F.lit(False))
    return hit


def rescore_reset(listings: DataFrame, scores: DataFrame) -> tuple[DataFrame, DataFrame]:
    """No scores, nothing sent."""
    return _cleared(listings, SENT, F.lit(True)), scores.limit(0)


def scores_of_kept(scores: DataFrame, dropped: DataFrame) -> DataFrame:
    """Scores whose listing is not among the dropped ones."""
    return scores.join(dropped.select(F.col("id").alias("listing_id")), "listing_id", "left_anti")


def purge_click_hosts(listings: DataFrame, scores: DataFrame, ledger: DataFrame):
    """Drop listings under the click host with their scores; requeue that portal's messages."""
    junk = says("canonical_url", "clicks.immobiliare.it")
    dropped = listings.where(junk)
    return listings.where(~junk), scores_of_kept(scores, dropped), ledger.where(~says("from_address", "immobiliare.it"))


def portal_reset(listings: DataFrame, scores: DataFrame, ledger: DataFrame):
    """Requeue portal messages, clear geo and sent marks of portal listings, drop their scores."""
    by_source = says("source", "idealista", "casa.it")
    cleared = _cleared(
        listings, SENT + GEO, by_source | says("canonical_url", "immobiliare.it", "idealista.it", "casa.it")
    )
    dropped = listings.where(by_source | says("canonical_url", "immobiliare.it"))
    requeued = ledger.where(~says("from_address", "idealista", "casa.it", "immobiliare.it"))
    return cleared, scores_of_kept(scores, dropped), requeued
