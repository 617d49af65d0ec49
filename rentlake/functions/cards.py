"""Digest texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rentlake import fixed_values as V
from rentlake.functions.places import distance_text
from rentlake.functions.regex import filled, number_text, strip
from rentlake.functions.urls import open_link, source_line


def duplicate_line(primary: Column) -> Column:
    """Pointer to the older listing; ``primary`` is a struct or NULL."""
    none = F.lit(None).cast("string")
    label = F.coalesce(
        filled(strip(primary["title"])),
        source_line(primary["source"], none, primary["canonical_url"]),
        F.lit("earlier listing"),
    )
    link = open_link(none, primary["canonical_url"])
    text = F.concat(F.lit(V.DUPLICATE_LINE), label)
    return F.when(primary["id"].isNotNull(), F.concat(text, F.coalesce(F.concat(F.lit("\n   "), link), F.lit(""))))


def card(row: dict[str, Column], reference_name: str | None = None) -> Column:
    """Card of one listing, a line per known fact; the facts line always shows."""
    risk = (
        F.when(row["risk_level"] == "high", F.lit("🚨 "))
        .when(row["risk_level"].isin("medium", "low"), F.lit("⚠️ "))
        .otherwise(F.lit(""))
    )
    head = F.concat(
        risk, F.lit("🏠 "), row["score"].cast("string"), F.lit("/100 — "), F.coalesce(row["title"], F.lit("Listing"))
    )
    facts = F.concat_ws(
        ", ",
        F.concat(number_text(row["rooms"]), F.lit(" rooms")),
        F.concat(number_text(row["area_sqm"]), F.lit(" m²")),
        F.nullif(row["location_hint"], F.lit("")),
    )
    fee = row["condo_fee_eur"]
    price = F.nullif(
        F.concat_ws(
            " · ",
            F.concat(F.lit("💶 "), row["rent_eur"].cast("string"), F.lit(" €/mo")),
            F.concat(F.lit("spese "), fee.cast("string"), F.lit("€")),
            F.when(fee.isNotNull(), F.concat(F.lit("total ~"), row["total_cost_eur"].cast("string"), F.lit("€"))),
        ),
        F.lit(""),
    )
    distance = F.lit(None).cast("string")
    if reference_name and reference_name.strip():
        distance = F.concat(
            F.lit("📍 "), distance_text(row["distance_to_ref_m"]), F.lit(f" from {reference_name.strip()}")
        )
    tip = F.concat(F.lit("💡 "), F.nullif(strip(row["summary"]), F.lit("")))
    reasons = F.when(
        F.size(row["reasons"]) > 0, F.concat(F.lit("✅ "), F.array_join(F.slice(row["reasons"], 1, 3), "; "))
    )
    risks = F.when(
        F.size(row["risk_reasons"]) > 0, F.concat(F.lit("⚠️ "), F.array_join(row["risk_reasons"], "; "))
    )
    link = open_link(row["listing_url"], row["canonical_url"])
    return F.concat_ws(
        "\n",
        head,
        duplicate_line(row["possible_duplicate_of"]),
        facts,
        price,
        distance,
        tip,
        reasons,
        risks,
        source_line(row["source"], row["listing_url"], row["canonical_url"]),
        F.coalesce(F.concat(F.lit("🔗 "), link), F.lit(V.NO_LINK_LINE)),
    )


def header(day: Column, new: Column, duplicates: Column, normal: Column, suspicious: Column, note: Column) -> Column:
    return F.concat(
        F.lit("📅 "), F.date_format(day, "dd/MM/yyyy"),
        F.lit("\nNew: "), new.cast("string"),
        F.lit(" · email duplicates skipped: "), duplicates.cast("string"),
        F.lit("\nTop "), normal.cast("string"),
        F.when(suspicious > 0, F.concat(F.lit(" + "), suspicious.cast("string"), F.lit(" suspicious"))).otherwise(
            F.lit("")
        ),
        note,
    )


def deferred_note(deferred: Column) -> Column:
    text = F.concat(F.lit("\n⏳ "), deferred.cast("string"), F.lit(" more in queue — next pipeline run"))
    return F.when(deferred > 0, text).otherwise(F.lit(""))


def queued_note(cards: Column, delay_ms: int) -> Column:
    return F.concat(F.lit("\n📬 "), cards.cast("string"), F.lit(f" cards queued in BullMQ (staggered {delay_ms} ms)"))
