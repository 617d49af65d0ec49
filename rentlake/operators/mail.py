"""Alert messages to listing drafts."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rentlake.functions import alerts, amounts, keys, urls
from rentlake.functions.regex import collapse, cut
from rentlake.operators.anchors import message_anchors
from rentlake.session import cut_lineage

DRAFT_COLUMNS = (
    "canonical_url", "listing_url", "source", "external_id", "title", "location_hint",
    "rent_eur", "condo_fee_eur", "area_sqm", "rooms", "raw_snippet",
)


@dataclass(frozen=True)
class Parser:
    """Takes the messages that ``takes`` (of sender and subject; null counts as no) is true for, and turns their anchors into drafts.

    ``scan`` says which anchors it sees and how much text around them, see ``dom.scan``; all of them, if not given.
    ``skips_sales``: its sale alerts are left out before their bodies are read.
    """

    name: str
    takes: Callable[[Column, Column], Column]
    drafts: Callable[[DataFrame], DataFrame]
    scan: str = "every"
    skips_sales: bool = False


def routed(messages: DataFrame, parsers: Sequence[Parser] | None = None) -> DataFrame:
    """Messages with the text to parse and the first parser that takes them, null where none does."""
    route = F.coalesce(*[F.when(p.takes(F.col("from_address"), F.col("subject")), F.lit(p.name)) for p in parsers or PARSERS])
    return messages.select(
        "*",
        alerts.body(F.col("html_body"), F.col("text_body")).alias("body"),
        route.alias("route"),
    )


def anchors_of(messages: DataFrame, parsers: Sequence[Parser] | None = None) -> DataFrame:
    """Anchors of all messages that a parser takes, in one pass."""
    parsers = parsers or PARSERS
    scan = F.coalesce(*[F.when(F.col("route") == p.name, F.lit(p.scan)) for p in parsers])
    todo = routed(messages, parsers).withColumns({"sale": alerts.is_sale_alert(F.col("subject"), F.col("body")), "scan": scan})
    no_sales = F.col("route").isin([p.name for p in parsers if p.skips_sales])
    return message_anchors(todo.where(F.col("route").isNotNull() & ~(F.col("sale") & no_sales)))


def generic_drafts(anchors: DataFrame) -> DataFrame:
    """One draft per listing URL of a message, the first anchor wins."""
    known = anchors.withColumn("canonical_url", urls.canonical(F.col("href")))
    first = (
        known.where(urls.is_listing_page(F.col("canonical_url")))
        .groupBy("message_id", "canonical_url")
        .agg(F.min(F.struct("pos", "received_at", "sale", "subject", "sender", "text", "block")).alias("a"))
        .select("message_id", "canonical_url", "a.*")
    )
    text, block, context = F.col("text"), F.col("block"), F.col("context")
    casa = alerts.from_casa(F.col("sender"))
    staged = first.withColumns(
        {
            "context": cut(collapse(F.concat_ws(" ", "subject", block, text)), 500),
            "casa_subject": F.when(casa, F.col("subject")),
            "casa_block": F.when(casa, block),
        }
    )
    staged = amounts.with_rent(staged, "context", "c_rent")
    staged = amounts.with_rent(staged, "casa_block", "b_rent")
    staged = alerts.with_subject_fields(staged, "casa_subject", "s_")
    staged = staged.withColumns(
        {
            "b_hint": alerts.block_hint(F.col("casa_block")),
            "rent_eur": F.coalesce("c_rent", "b_rent", "s_rent_eur"),
            "area_sqm": F.coalesce(amounts.area(context), amounts.area(F.col("casa_block")), F.col("s_area_sqm")),
            "rooms": F.coalesce(amounts.rooms(context), amounts.rooms(block)),
        }
    )
    hint = F.coalesce(F.col("s_location_hint"), F.col("b_hint"), F.when(~casa, F.nullif(cut(block, 120), F.lit(""))))
    staged = staged.withColumn("location_hint", hint).withColumn(
        "plain_title",
        F.when(alerts.is_call_to_action(text), F.col("s_title")).otherwise(
            F.coalesce(F.nullif(cut(text, 200), F.lit("")), F.col("s_title"))
        ),
    )
    built = alerts.built_title(F.col("plain_title"), F.col("area_sqm"), F.col("location_hint"), F.col("rent_eur"))
    return staged.select(
        "message_id",
        "received_at",
        "sale",
        "sender",
        "canonical_url",
        F.lit(None).cast("string").alias("listing_url"),
        urls.site_of(F.col("canonical_url")).alias("source"),
        F.lit(None).cast("string").alias("external_id"),
        F.when(casa, built).otherwise(F.col("plain_title")).alias("title"),
        "location_hint",
        "rent_eur",
        amounts.condo_fee(context).alias("condo_fee_eur"),
        "area_sqm",
        "rooms",
        cut(context, 400).alias("raw_snippet"),
    )


def idealista_drafts(anchors: DataFrame) -> DataFrame:
    """One draft per listing id of a message, the longest title wins, a tie keeps the first."""
    text = F.col("text")
    best = (
        anchors.withColumn("external_id", urls.immobile_id(F.col("href")))
        .where(F.col("external_id").isNotNull() & alerts.idealista_anchor(text))
        .groupBy("message_id", "external_id")
        .agg(F.min(F.struct((-F.length(text)).alias("rank"), "pos", "received_at", "sale", "sender", "text", "block")).alias("a"))
        .select("message_id", "external_id", "a.*")
    )
    block, url = F.col("block"), urls.immobile_url(F.col("external_id"))
    return amounts.with_rent(best, "block", "rent").select(
        "message_id",
        "received_at",
        "sale",
        "sender",
        url.alias("canonical_url"),
        url.alias("listing_url"),
        F.lit("idealista.it").alias("source"),
        "external_id",
        cut(text, 200).alias("title"),
        alerts.hint_from_title(text).alias("location_hint"),
        F.when(amounts.has_monthly_hint(block), F.col("rent")).alias("rent_eur"),
        amounts.condo_fee(block).alias("condo_fee_eur"),
        amounts.area(block).alias("area_sqm"),
        F.coalesce(amounts.rooms(block), amounts.rooms_from_words(text), amounts.rooms_from_words(block)).alias("rooms"),
        cut(block, 400).alias("raw_snippet"),
    )


def immobiliare_drafts(found: DataFrame) -> DataFrame:
    """One draft per stable key of a message; click links change, the key does not."""
    text, block = F.col("text"), F.col("block")
    anchors = found.where(alerts.immobiliare_anchor(text))
    read = (
        amounts.with_rent(anchors, "block", "rent_eur")
        .withColumn("area_sqm", amounts.area(block))
        .withColumn("canonical_url", keys.alert_url(text, F.col("rent_eur"), F.col("area_sqm")))
        .groupBy("message_id", "canonical_url")
        .agg(F.min(F.struct("pos", "received_at", "sale", "sender", "href", "text", "block", "rent_eur", "area_sqm")).alias("a"))
        .select("message_id", "canonical_url", "a.*")
    )
    return read.select(
        "message_id",
        "received_at",
        "sale",
        "sender",
        "canonical_url",
        urls.click_url(F.col("href")).alias("listing_url"),
        F.lit("immobiliare.it").alias("source"),
        urls.click_id(F.col("href")).alias("external_id"),
        cut(text, 200).alias("title"),
        alerts.hint_from_title_or_block(text, block).alias("location_hint"),
        "rent_eur",
        amounts.condo_fee(block).alias("condo_fee_eur"),
        "area_sqm",
        F.coalesce(amounts.rooms(block), amounts.rooms(text), amounts.rooms_from_prefix(text)).alias("rooms"),
        cut(block, 400).alias("raw_snippet"),
    )


# The first that takes a message reads it.  ``drafts`` can be given others, before, after or instead of these.
PARSERS = (
    Parser("immobiliare", alerts.from_immobiliare, immobiliare_drafts, "immobiliare"),
    Parser("idealista", lambda sender, subject: alerts.from_idealista(sender), idealista_drafts, "idealista", skips_sales=True),
    Parser("generic", lambda sender, subject: F.lit(True), generic_drafts, "generic"),
)


def drafts(messages: DataFrame, parsers: Sequence[Parser] | None = None) -> DataFrame:
    """Drafts of all messages: one pass over the bodies, then each parser on the anchors of its messages."""
    parsers = tuple(parsers or PARSERS)
    if len({p.name for p in parsers}) < len(parsers):
        raise ValueError("two parsers have one name")
    found = cut_lineage(anchors_of(messages, parsers))
    out = None
    for parser in parsers:
        part = parser.drafts(found.where(F.col("route") == parser.name)).withColumn("parser", F.lit(parser.name))
        out = part if out is None else out.unionByName(part)
    return out
