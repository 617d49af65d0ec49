"""Score listings and lay out the digest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rentlake.criteria import Criteria
from rentlake.functions import cards
from rentlake.operators import digest, geocode, scoring
from rentlake.session import cut_lineage


def classified(listings: DataFrame, scores: DataFrame, c: Criteria, as_of: str, days: int = 7, limit: int | None = None) -> DataFrame:
    """Active listings with ``outcome``: cache, hard or scored."""
    rows = scoring.with_search_text(scoring.candidates(listings, scores, F.lit(as_of).cast("timestamp"), days, limit))
    outcome = F.when(F.col("fresh"), F.lit("cache")).when(~scoring.hard_ok(c), F.lit("hard")).otherwise(F.lit("scored"))
    return rows.select(*listings.columns, outcome.alias("outcome"))


def located(
    listings: DataFrame, scores: DataFrame, c: Criteria, cache: DataFrame, gazetteer: DataFrame, fallback: DataFrame,
    as_of: str, days: int = 7, limit: int | None = None,
) -> DataFrame:
    """Listings that are due, with points, distances and proximity scores."""
    due = classified(listings, scores, c, as_of, days, limit).where("outcome = 'scored'").drop("outcome")
    return geocode.resolve(due, c, cache, gazetteer, fallback, as_of)


def rate(
    listings: DataFrame, scores: DataFrame, c: Criteria, cache: DataFrame, gazetteer: DataFrame, fallback: DataFrame,
    model_replies: DataFrame | None, as_of: str, days: int = 7, limit: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Located listings that were due, and their new score rows."""
    due = located(listings, scores, c, cache, gazetteer, fallback, as_of, days, limit)
    return due, scoring.score(due, c, model_replies, as_of)


def with_points(listings: DataFrame, located: DataFrame) -> DataFrame:
    """Write points, distances and proximity scores back to the listing table."""
    names = ("lat", "lng", "geocode_source", "geocoded_at", "distance_to_ref_m", "proximity_score")
    new = located.select(F.col("id").alias("_id"), F.struct(*names).alias("_g"))
    joined = listings.join(new, F.col("id") == F.col("_id"), "left")
    here = F.col("_id").isNotNull()
    return joined.select(*[
        F.when(here, F.col(f"_g.{n}")).otherwise(F.col(n)).alias(n) if n in names else F.col(n) for n in listings.columns
    ])


def header_text(as_of: str, new: int, duplicates: int, queue: bool, delay_ms: int) -> Column:
    """Header of a digest as a column over its one-row counters."""
    k = F.col
    note = cards.queued_note(k("normal") + k("suspicious"), delay_ms) if queue else cards.deferred_note(k("deferred"))
    return cards.header(F.lit(as_of).cast("timestamp"), F.lit(new), F.lit(duplicates), k("normal"), k("suspicious"), note)


def digest_cards(
    listings: DataFrame, scores: DataFrame, c: Criteria, as_of: str, new: int = 0, duplicates: int = 0,
    top_n: int = 10, per_run: int = 10, delay_ms: int = 2500, queue: bool = False,
) -> DataFrame:
    """Texts of one digest in sending order; ``queue`` sends all of them and says so."""
    # At most top_n rows, written once: counters, cards and divider read them, not the tables.
    chosen = cut_lineage(digest.selection(digest.digest_view(listings, scores), c, top_n))
    return cards_of(chosen, c, as_of, new, duplicates, per_run, delay_ms, queue)


def cards_of(
    chosen: DataFrame, c: Criteria, as_of: str, new: int = 0, duplicates: int = 0,
    per_run: int = 10, delay_ms: int = 2500, queue: bool = False,
) -> DataFrame:
    """Texts of a written selection in sending order."""
    split = digest.batches(chosen, per_run, queue)
    head = digest.send_stats(split).select(header_text(as_of, new, duplicates, queue, delay_ms).alias("h")).first()["h"]
    return digest.schedule(split, head, c.reference_name, as_of, delay_ms)
