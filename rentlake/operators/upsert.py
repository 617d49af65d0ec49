"""Merge drafts into the listing table under two keys.

A draft belongs to the listing of its URL; if there is none, to the oldest listing that
holds its fingerprint at that moment; else it opens a listing.  An update may change the
fingerprint a listing holds, so the outcome depends on the order of the drafts.

The order is replayed with joins, not one draft at a time.  What a listing holds depends
only on the drafts of its own URL since it was opened (a draft that came in by
fingerprint carries the fingerprint already held).  So the one unknown is *when each URL
opens its listing*.  Opening earlier means more holders, and more holders mean other URLs
open later: starting from "every URL opens at its first draft", alternating rounds close
in on the only consistent answer from both sides, and the first round that changes
nothing has found it.  Only URLs that share a fingerprint with another URL take part.

Whether anybody holds fingerprint f at position x is a running count of the spans that have
begun and not ended there; who the oldest of them is, is an interval lookup: spans are
split into aligned power-of-two blocks, a position lies in one block per level, and the
lookup becomes an equi-join against one pre-aggregated row per (f, block).  No pairs within
a fingerprint are made, and no key has to fit a task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rentlake.functions import keys, urls
from rentlake.functions.amounts import total_cost
from rentlake.functions.regex import strip
from rentlake.operators.ordered import chunk, numbered, with_next, with_previous
from rentlake.session import any_size, cut_lineage, scratch

LISTING_SCHEMA = """
    id string, canonical_url string, listing_url string, source string, external_id string,
    title string, address_raw string, location_hint string, rent_eur int, condo_fee_eur int,
    total_cost_eur int, area_sqm double, rooms double, floor int, has_lift boolean,
    raw_snippet string, listing_fingerprint string, property_match_key string,
    possible_duplicate_of_id string, lat double, lng double, geocode_source string,
    geocoded_at timestamp, distance_to_ref_m int, proximity_score int,
    first_seen_at timestamp, last_seen_at timestamp, price_changed_at timestamp,
    material_hash string, sent_at timestamp, sent_message_id string,
    dismissed_at timestamp, saved_at timestamp
"""
LAST_KNOWN = (
    "address_raw", "location_hint", "rent_eur", "condo_fee_eur", "area_sqm", "rooms", "floor",
    "has_lift", "raw_snippet", "source", "external_id",
)
#: The order of time; no two drafts are equal in it.
_ORDER = ("seen_at", "draft_key")
_DRAFT_TYPES = {
    "listing_url": "string", "source": "string", "external_id": "string", "title": "string",
    "address_raw": "string", "location_hint": "string", "rent_eur": "int", "condo_fee_eur": "int",
    "area_sqm": "double", "rooms": "double", "floor": "int", "has_lift": "boolean", "raw_snippet": "string",
}


def empty_listings(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], LISTING_SCHEMA).limit(0)  # known to be empty before it runs


def keyed(drafts: DataFrame, *also: str) -> DataFrame:
    """Drafts with every column of the schema and the derived keys, and the columns ``also``."""
    c = F.col
    missing = [F.lit(None).cast(t).alias(c) for c, t in _DRAFT_TYPES.items() if c not in drafts.columns]
    street = keys.street_key(keys.street_text(c("location_hint"), c("title"), c("raw_snippet")))
    return drafts.select("*", *missing).withColumn("_street", street).select(
        *also, "draft_key", "seen_at", "canonical_url",
        *[c(n).cast(t).alias(n) for n, t in _DRAFT_TYPES.items()],
        keys.fingerprint(c("_street"), c("rent_eur"), c("rooms"), c("area_sqm")).alias("fingerprint"),
        keys.match_key(c("_street"), c("rent_eur"), c("rooms")).alias("match_key"),
        keys.material_hash(c("rent_eur"), c("area_sqm"), c("rooms"), c("location_hint")).alias("hash"),
        total_cost(c("rent_eur"), c("condo_fee_eur")).alias("total"),
    )


# --- identity ----------------------------------------------------------------

def _blocks(low: Column, high: Column, levels: int) -> Column:
    """Aligned blocks (level, number) that tile positions low..high-1, at most two per level."""
    per_level = []
    for level in range(levels + 1):
        first = F.shiftright(low + F.lit((1 << level) - 1), level)
        end = F.shiftright(high, level)
        open_ = first < end
        per_level.append(F.when(open_ & (first % 2 == 1), F.struct(F.lit(level).alias("level"), first.alias("number"))))
        per_level.append(F.when(open_ & (end % 2 == 1), F.struct(F.lit(level).alias("level"), (end - 1).alias("number"))))
    return F.array_compact(F.array(*per_level))


def _enclosing(pos: Column, levels: int) -> Column:
    """The block of every level that holds a position."""
    return F.array(
        *[F.struct(F.lit(k).alias("level"), F.shiftright(pos, k).alias("number")) for k in range(levels + 1)]
    )


def _spans(runs: DataFrame, known: DataFrame, opened: DataFrame, span: int, *carried: str) -> DataFrame:
    """Positions low..high-1 at which a URL holds a fingerprint, given when each URL opens.

    A run is a stretch in which the drafts of a URL say the same; it counts from the first
    of them that comes with or after the opening.
    """
    since = F.greatest("start", "holds_from")
    from_drafts = runs.join(any_size(opened.withColumnRenamed("canonical_url", "owner")), "owner").select(
        "fingerprint", "owner", *carried, (since + 1).alias("low"), F.coalesce("end", F.lit(span)).alias("high")
    )
    from_table = known.where(F.col("fingerprint").isNotNull()).select(
        "fingerprint", F.col("canonical_url").alias("owner"), *carried,
        F.lit(0).cast("long").alias("low"), F.coalesce("first_pos", F.lit(span)).alias("high"),
    )
    return from_drafts.unionByName(from_table).where(F.col("low") < F.col("high"))


def _alone(lookups: DataFrame, spans: DataFrame) -> DataFrame:
    """Lookups (canonical_url, pos, fingerprint, holds_from, own) at which nobody else holds the fingerprint.

    A running count of the spans that have begun and not ended; ``own`` says whether one of
    them is the URL's own.  Counts run inside chunks of positions, and only the sums of the
    chunks travel, so a busy fingerprint does not fill a task.
    """
    ends = spans.select("fingerprint", F.explode(F.array(
        F.struct(F.col("low").alias("pos"), F.lit(1).alias("delta")), F.struct(F.col("high").alias("pos"), F.lit(-1).alias("delta"))
    )).alias("e")).select("fingerprint", "e.*")
    ends = ends.groupBy("fingerprint", "pos").agg(F.sum("delta").alias("delta"))
    rows = ends.unionByName(lookups.withColumn("delta", F.lit(0).cast("long")), allowMissingColumns=True)
    rows = rows.withColumn("chunk", chunk())
    # at one position spans begin and end before anybody looks
    near = Window.partitionBy("fingerprint", "chunk").orderBy("pos", F.col("canonical_url").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    inside = rows.withColumn("inside", F.sum("delta").over(near)).where("canonical_url is not null")
    far = Window.partitionBy("fingerprint").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = rows.groupBy("fingerprint", "chunk").agg(F.sum("delta").alias("delta"))
    carry = carry.select("fingerprint", "chunk", F.sum("delta").over(far).alias("before"))
    held = F.col("inside") + F.coalesce("before", F.lit(0)) - F.col("own").cast("int")
    return inside.join(any_size(carry), ["fingerprint", "chunk"], "left").where(held <= 0).select("canonical_url", "pos", "holds_from")


def _openings(own: DataFrame, runs: DataFrame, known: DataFrame, never: int) -> DataFrame:
    """(canonical_url, opened, holds_from) of every URL; ``never`` for one that never opens a listing.

    A round turns a bound of the openings into the bound of the other side.  A URL whose
    two bounds agree is settled: it leaves with its lookups, and only fingerprints that the
    others still look up go on, so rounds get smaller.
    """
    columns = ["canonical_url", "opened", "holds_from"]
    first = F.min(F.struct("pos", "holds_from")).alias("p")
    settled = known.select("canonical_url", F.lit(-1).cast("long").alias("opened"), F.lit(-1).cast("long").alias("holds_from"))
    places = own.where(~F.col("in_table"))
    open_ = cut_lineage(places.groupBy("canonical_url").agg(first).select("canonical_url", F.col("p.pos").alias("opened"), "p.holds_from"))
    while True:
        asked = places.join(any_size(open_.select("canonical_url", "opened")), "canonical_url")
        mine = F.coalesce((F.col("prev_held_pos") >= F.col("opened")) & (F.col("prev_fingerprint") == F.col("fingerprint")), F.lit(False))
        lookups = asked.where("fingerprint is not null").select("canonical_url", "pos", "fingerprint", "holds_from", mine.alias("own"))
        blank = asked.where("fingerprint is null").select("canonical_url", "pos", "holds_from")
        missed = _alone(lookups, _spans(runs, known, settled.unionByName(open_), never)).unionByName(blank).groupBy("canonical_url").agg(first)
        both = cut_lineage(open_.join(any_size(missed), "canonical_url", "left").select(
            *columns, F.coalesce("p.pos", F.lit(never)).alias("later"), F.coalesce("p.holds_from", F.lit(never)).alias("later_holds")
        ))
        settled = settled.unionByName(both.where("opened = later").select(*columns))
        open_ = both.where("opened <> later").select("canonical_url", F.col("later").alias("opened"), F.col("later_holds").alias("holds_from"))
        if open_.isEmpty():
            return settled.where("opened >= 0")
        settled = cut_lineage(settled)
        places = cut_lineage(places.join(any_size(open_), "canonical_url", "left_semi"))
        asked_for = places.select("fingerprint").distinct()
        runs = cut_lineage(runs.join(any_size(asked_for), "fingerprint", "left_semi"))


def resolve(drafts: DataFrame, listings: DataFrame, total: int) -> DataFrame:
    """Add ``target_url`` (canonical URL of the listing a draft belongs to) and ``opens``.

    ``drafts`` carry their positions ``pos`` in the order of time, below ``total``.
    """
    table = listings.select(
        "canonical_url", F.col("listing_fingerprint").alias("fingerprint"), F.col("first_seen_at").alias("first_seen")
    )
    both = drafts.select("canonical_url", "fingerprint").unionByName(table.select("canonical_url", "fingerprint"))
    shared = (
        both.where(F.col("fingerprint").isNotNull())
        .groupBy("fingerprint")
        .agg(F.min("canonical_url").alias("a"), F.max("canonical_url").alias("b"))
        .where(F.col("a") != F.col("b"))
        .select("fingerprint")
    )
    contested = cut_lineage(both.join(any_size(shared), "fingerprint", "left_semi").select("canonical_url").distinct())

    # When each URL opens its listing: before all drafts if it is in the table, at its first draft if it is free.
    in_table = any_size(table.select("canonical_url", F.lit(True).alias("in_table")))
    first = drafts.groupBy("canonical_url").agg(F.min("pos").alias("first")).join(in_table, "canonical_url", "left")
    free = first.select("canonical_url", F.when(F.col("in_table"), F.lit(-1).cast("long")).otherwise(F.col("first")).alias("opened"))
    own_url, opens = F.col("canonical_url").alias("target_url"), (F.col("pos") == F.col("opened")).alias("opens")
    if contested.isEmpty():
        return drafts.join(any_size(free), "canonical_url").select(*drafts.columns, own_url, opens)

    rows = (
        drafts.select("pos", "canonical_url", "fingerprint")
        .join(any_size(contested), "canonical_url", "left_semi")
        .join(in_table, "canonical_url", "left")
        .withColumn("in_table", F.coalesce("in_table", F.lit(False)))
    )
    levels = max(1, total.bit_length())
    marked = rows.withColumn("held_pos", F.when(F.col("fingerprint").isNotNull(), F.col("pos")))
    by_url = (["canonical_url"], chunk(), ["pos"])
    own = with_next(with_previous(marked, *by_url, ["fingerprint", "held_pos"]), *by_url, ["held_pos"])
    own = cut_lineage(own.withColumn("holds_from", F.coalesce("held_pos", "next_held_pos", F.lit(total))).drop("held_pos", "next_held_pos"))
    starts = own.where(F.col("fingerprint").isNotNull() & ~F.col("fingerprint").eqNullSafe(F.col("prev_fingerprint")))
    runs = with_next(starts.select("canonical_url", "pos", "fingerprint"), *by_url, ["pos"])
    runs = cut_lineage(runs.select("fingerprint", F.col("canonical_url").alias("owner"), F.col("pos").alias("start"), F.col("next_pos").alias("end")))
    known = cut_lineage(
        table.join(any_size(contested), "canonical_url", "left_semi")
        .join(any_size(runs.groupBy(F.col("owner").alias("canonical_url")).agg(F.min("start").alias("first_pos"))), "canonical_url", "left")
        .withColumn("born", F.struct(F.lit(0).alias("fresh"), F.unix_micros("first_seen").alias("at")))
    )
    opened = cut_lineage(_openings(own, runs, known, total))

    fresh = opened.select("canonical_url", "holds_from", F.struct(F.lit(1).alias("fresh"), F.col("opened").alias("at")).alias("born"))
    births = fresh.unionByName(known.select("canonical_url", F.lit(-1).cast("long").alias("holds_from"), "born"))
    # Only drafts before their URL's own opening need a holder: the oldest of those at their position.
    # A position lies in one block of each level, a span is a few blocks.
    held = (
        _spans(runs, known, births, total, "born")
        .select("fingerprint", "owner", "born", F.explode(_blocks(F.col("low"), F.col("high"), levels)).alias("b"))
        .groupBy("fingerprint", "b")
        .agg(F.min(F.struct("born", "owner")).alias("oldest"))
    )
    homeless = own.where(F.col("fingerprint").isNotNull() & ~F.col("in_table")).join(any_size(opened.select("canonical_url", "opened")), "canonical_url").where("pos < opened")
    asked = homeless.select("pos", "fingerprint", F.explode(_enclosing(F.col("pos"), levels)).alias("b"))
    oldest = asked.join(any_size(held), ["fingerprint", "b"]).groupBy("pos").agg(F.min("oldest").alias("oldest"))
    oldest = cut_lineage(oldest.select("pos", F.col("oldest.owner").alias("target_url")))
    when = free.withColumnRenamed("opened", "else").join(any_size(opened.select("canonical_url", "opened")), "canonical_url", "left")
    placed = drafts.join(any_size(when.select("canonical_url", F.coalesce("opened", "else").alias("opened"))), "canonical_url")
    at_home = placed.where("pos >= opened").select(*drafts.columns, own_url, opens)
    homeless = placed.where("pos < opened").join(any_size(oldest), "pos", "left")
    return at_home.unionByName(homeless.select(*drafts.columns, "target_url", F.lit(False).alias("opens")))


# --- fold --------------------------------------------------------------------

@dataclass(frozen=True)
class Merge:
    """New listing table, one change row per draft, and the other URLs of each listing."""

    listings: DataFrame
    changes: DataFrame
    alternate_urls: DataFrame


def changes_of(resolved: DataFrame, listings: DataFrame) -> DataFrame:
    """Per draft: is it new, did the price change, did the facts change."""
    before = with_previous(resolved, ["target_url"], chunk(), ["pos"], ["rent_eur", "hash"])
    old = listings.select(
        F.col("canonical_url").alias("target_url"), F.col("rent_eur").alias("old_rent"),
        F.col("material_hash").alias("old_hash"),
    )
    rent = F.coalesce("prev_rent_eur", "old_rent")
    return before.join(any_size(old), "target_url", "left").select(
        "draft_key", "seen_at", "target_url",
        keys.listing_id(F.col("target_url")).alias("listing_id"),
        F.col("opens").alias("is_new"),
        F.coalesce(~F.col("opens") & (F.col("rent_eur") != rent), F.lit(False)).alias("price_changed"),
        (~F.col("opens") & ~F.coalesce("prev_hash", "old_hash").eqNullSafe(F.col("hash"))).alias("material_changed"),
    )


def _folded(resolved: DataFrame) -> DataFrame:
    """One row per target; every field is an aggregate, so hot targets combine before the shuffle."""
    at = F.col("pos")

    def last(name: str) -> Column:
        return F.max_by(name, F.when(F.col(name).isNotNull(), at)).alias(name)

    title = F.nullif(strip(F.col("title")), F.lit(""))
    url = F.when(strip(F.col("listing_url")) != "", F.col("listing_url"))
    return resolved.groupBy("target_url").agg(
        *[last(n) for n in (*LAST_KNOWN, "total", "fingerprint", "match_key")],
        F.max_by("hash", at).alias("hash"),
        F.min_by(title, F.when(title.isNotNull(), F.struct(-F.length(title), at))).alias("title"),
        F.max_by(url, F.when(url.isNotNull(), F.struct(urls.url_score(url), at))).alias("listing_url"),
        F.min("seen_at").alias("first_seen"),
        F.max("seen_at").alias("last_seen"),
    )


def merge(listings: DataFrame, drafts: DataFrame) -> Merge:
    """Apply drafts (``draft_key`` unique, ``seen_at`` set) to the listing table."""
    spark = drafts.sparkSession
    with scratch(spark):
        with scratch(spark):
            # Written first: ordering reads its input twice, and the keys are dear to derive.
            rows, total = numbered(cut_lineage(keyed(drafts)), *_ORDER, outlives=1)
        return _merge_ordered(listings, rows, total)


def merge_keyed(listings: DataFrame, drafts: DataFrame, outlives: int = 0) -> Merge:
    """``merge`` of drafts that went through ``keyed``.

    ``listings`` need only hold what the drafts can meet: listings of their URLs, and those that hold one
    of their fingerprints.  ``outlives`` as in ``cut_lineage``, for the results.
    """
    with scratch(drafts.sparkSession):
        return _merge_ordered(listings, *numbered(drafts, *_ORDER), outlives + 1)


def _merge_ordered(listings: DataFrame, rows: DataFrame, total: int, outlives: int = 1) -> Merge:
    """The merge of numbered drafts, inside a block of ``scratch`` that the results outlive.

    Who a draft belongs to is found on a few narrow columns; the others travel twice, to their target and to its sums.
    A table goes as soon as what is read from it is written.
    """
    spark = rows.sparkSession
    with scratch(spark):
        placed = cut_lineage(resolve(rows.select("pos", *_ORDER, "canonical_url", "fingerprint", "rent_eur", "hash"), listings, total).drop("fingerprint"), 1)
    changes = cut_lineage(changes_of(placed, listings), outlives)
    foreign = placed.where(F.col("canonical_url") != F.col("target_url"))
    alternates = (
        foreign.groupBy("target_url", "canonical_url")
        .agg(F.min("seen_at").alias("first_seen_at"))
        .select(
            keys.listing_id(F.col("target_url")).alias("listing_id"), F.col("canonical_url").alias("alternate_url"), "first_seen_at"
        )
    )
    alternates = cut_lineage(alternates, outlives)
    told = rows.select("pos", "seen_at", *LAST_KNOWN, "total", "fingerprint", "match_key", "hash", "title", "listing_url")
    resolved = cut_lineage(told.join(any_size(placed.select("pos", "target_url")), "pos"))
    priced = changes.where("price_changed").groupBy("target_url").agg(F.max("seen_at").alias("priced_at"))
    new = _folded(resolved).join(any_size(priced), "target_url", "left").select(
        *[F.col(n).alias(f"n_{n}") for n in (
            "target_url", *LAST_KNOWN, "total", "fingerprint", "match_key", "hash", "title", "listing_url",
            "first_seen", "last_seen", "priced_at",
        )]
    )
    joined = listings.join(new, listings["canonical_url"] == new["n_target_url"], "full_outer")
    c = F.col
    fresh = {n: F.coalesce(c(f"n_{n}"), c(n)) for n in LAST_KNOWN}
    fresh |= {
        "id": F.coalesce(c("id"), keys.listing_id(c("n_target_url"))),
        "canonical_url": F.coalesce(c("canonical_url"), c("n_target_url")),
        "listing_url": F.when(c("n_target_url").isNull(), c("listing_url")).otherwise(
            F.coalesce(urls.preferred_url(c("listing_url"), c("n_listing_url")), c("listing_url"))
        ),
        "title": F.when(c("n_target_url").isNull(), c("title")).otherwise(
            F.coalesce(urls.better_title(c("title"), c("n_title")), c("title"))
        ),
        "total_cost_eur": F.coalesce(c("n_total"), c("total_cost_eur")),
        "listing_fingerprint": F.coalesce(c("n_fingerprint"), c("listing_fingerprint")),
        "property_match_key": F.coalesce(c("n_match_key"), c("property_match_key")),
        "material_hash": F.coalesce(c("n_hash"), c("material_hash")),
        "first_seen_at": F.coalesce(c("first_seen_at"), c("n_first_seen")),
        "last_seen_at": F.greatest(c("last_seen_at"), c("n_last_seen")),
        "price_changed_at": F.coalesce(c("n_priced_at"), c("price_changed_at")),
    }
    table = cut_lineage(joined.select(*[fresh.get(n, c(n)).alias(n) for n in listings.columns]), outlives)
    return Merge(table, changes, alternates)


def merged_alternates(urls_so_far: Column, existing: Column, incoming: Column) -> Column:
    """Other URLs of a listing as an array, in order of arrival."""
    return F.when(existing == incoming, urls_so_far).otherwise(
        F.array_distinct(F.concat(urls_so_far, F.array(existing, incoming)))
    )
