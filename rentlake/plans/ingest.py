"""From landed messages and posts to the listing table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rentlake.criteria import Criteria
from rentlake.functions import alerts, posts
from rentlake.operators import feed, mail, tables
from rentlake.operators.duplicates import backfill_match_keys, reconcile
from rentlake.operators.scoring import hard_ok, with_search_text
from rentlake.operators.upsert import Merge, merge
from rentlake.session import cut_lineage

Seen = DataFrame | Callable[[DataFrame], DataFrame]


def message_drafts(messages: DataFrame, c: Criteria) -> DataFrame:
    """Drafts with ``rental`` (a rental listing worth keeping) and ``kept`` (and within the hard limits)."""
    k = F.col
    gate = ~k("sale") & alerts.keeps_draft(
        k("sender"), k("title"), k("location_hint"), k("raw_snippet"), k("rent_eur"), k("area_sqm")
    )
    drafts = with_search_text(mail.drafts(messages)).withColumn("rental", gate)
    return drafts.withColumn("kept", k("rental") & hard_ok(c)).withColumnRenamed("received_at", "seen_at").drop("_text", "sale")


def post_drafts(found: DataFrame, c: Criteria) -> DataFrame:
    """Drafts of posts that are not student housing, with ``kept``."""
    k = F.col
    drafts = feed.post_drafts(found.where(~posts.is_student(k("message"))))
    drafts = drafts.withColumn("_gate", posts.clean(posts.gate_text(k("message"), k("title"), k("raw_snippet"))))
    gate = posts.keeps_draft(
        k("_gate"), k("canonical_url"), k("rent_eur"), k("rooms"), k("area_sqm"), k("location_hint")
    )
    kept = with_search_text(drafts).withColumn("kept", gate & hard_ok(c))
    return kept.withColumnRenamed("posted_at", "seen_at").drop("_gate", "_text")


def all_drafts(message_rows: DataFrame, post_rows: DataFrame) -> DataFrame:
    """Kept drafts of both feeds; each keeps the time its message or post was seen."""
    names = [*mail.DRAFT_COLUMNS, "seen_at", "origin", "origin_id"]
    a = message_rows.where("kept").select(*names)
    b = post_rows.where("kept").select(*names)
    key = F.concat_ws("|", "origin", "origin_id", "canonical_url")
    return a.unionByName(b).withColumn("draft_key", key)


@dataclass(frozen=True)
class Ingested:
    """``counts`` has one row: the counters of both feeds."""

    merge: Merge
    listings: DataFrame
    message_ledger: DataFrame
    post_ledger: DataFrame
    counts: DataFrame


def _unseen(rows: DataFrame, seen: Seen, key: str) -> DataFrame:
    return seen(rows) if callable(seen) else tables.unseen(rows, seen, key)


def ingest(
    listings: DataFrame, messages: DataFrame, found_posts: DataFrame,
    seen_messages: Seen, seen_posts: Seen, c: Criteria, as_of: str,
) -> Ingested:
    """New messages and posts, filtered, merged and linked; ``Seen`` is a table of known ids or leaves them out itself."""
    # Each is read several times below; written down, an input is matched with its ledger
    # and a text is parsed once.
    new_messages = cut_lineage(_unseen(messages, seen_messages, "message_id"))
    new_posts = cut_lineage(_unseen(found_posts, seen_posts, "post_id"))
    from_mail = cut_lineage(
        message_drafts(new_messages, c).withColumns({"origin": F.lit("message"), "origin_id": F.col("message_id").cast("string")})
    )
    from_posts = cut_lineage(
        post_drafts(new_posts, c).withColumns({"origin": F.lit("post"), "origin_id": F.col("post_id").cast("string")})
    )
    merged = merge(listings, all_drafts(from_mail, from_posts))
    linked = reconcile(backfill_match_keys(merged.listings)).drop("link_changed")
    mail_counts = message_counters(messages, new_messages, from_mail, merged.changes)
    return Ingested(
        merged, linked,
        tables.message_ledger(new_messages, from_mail.where("kept"), as_of),
        tables.post_ledger(new_posts, from_posts.where("kept"), as_of),
        run_totals(mail_counts, post_counters(found_posts, new_posts, from_posts, merged.changes)),
    )


def _n(condition=None) -> Column:
    return F.count("*") if condition is None else F.count(F.when(condition, 1))


def _merged(changes: DataFrame, origin: str) -> DataFrame:
    """New and repeated listings among the drafts of a feed."""
    own = changes.where(F.startswith("draft_key", F.lit(f"{origin}|")))
    return own.agg(_n(F.col("is_new")).alias("listings_new"), _n(~F.col("is_new")).alias("duplicates"))


def message_counters(messages: DataFrame, new: DataFrame, drafts: DataFrame, changes: DataFrame) -> DataFrame:
    """Messages read and known; drafts kept, dropped as no rental or by the hard limits, new and repeated.

    One-row aggregates side by side.
    """
    k = F.col
    read = new.agg(_n().alias("processed"))
    known = messages.agg(_n().alias("_all"))
    kept = drafts.agg(
        _n(k("kept")).alias("parsed"), _n(~k("rental")).alias("skipped_non_rent"), _n(k("rental") & ~k("kept")).alias("skipped_hard")
    )
    whole = read.join(known).join(kept).join(_merged(changes, "message"))
    return whole.select("processed", (k("_all") - k("processed")).alias("skipped"), "parsed", "skipped_non_rent", "skipped_hard", "listings_new", "duplicates")


def post_counters(found: DataFrame, new: DataFrame, drafts: DataFrame, changes: DataFrame) -> DataFrame:
    """The seven counters of the post feed; one-row aggregates side by side."""
    k = F.col
    student = posts.is_student(k("message"))
    read = new.agg(_n(~student).alias("processed"), _n(student).alias("skipped_student"), _n().alias("_new"))
    known = found.agg(_n().alias("_all"))
    kept = drafts.agg(_n(k("kept")).alias("parsed"), _n(~k("kept")).alias("skipped_non_rent"))
    whole = read.join(known).join(kept).join(_merged(changes, "post"))
    return whole.select(
        "processed", "parsed", "listings_new", "duplicates", "skipped_student", "skipped_non_rent", (k("_all") - k("_new")).alias("skipped")
    )


def run_totals(messages: DataFrame, found: DataFrame) -> DataFrame:
    """Counters of both feeds in one row, and the totals the digest names."""
    m = messages.select(*[F.col(n).alias(f"messages_{n}") for n in messages.columns])
    p = found.select(*[F.col(n).alias(f"posts_{n}") for n in found.columns])
    both = m.join(p)
    return both.select(
        "*",
        (F.col("messages_listings_new") + F.col("posts_listings_new")).alias("listings_new"),
        (F.col("messages_duplicates") + F.col("posts_duplicates")).alias("duplicates"),
    )
