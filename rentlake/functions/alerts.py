"""Predicates and projections for portal alert messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rentlake import fixed_values as V
from rentlake.functions import amounts
from rentlake.functions.regex import collapse, cut, filled, group, has, number_text, stages, strip


def body(html: Column, text: Column) -> Column:
    """The HTML body, or the plain one if that is empty."""
    return F.coalesce(F.nullif(html, F.lit("")), text, F.lit(""))


def _says(text: Column, word: str) -> Column:
    return F.coalesce(F.contains(F.lower(text), F.lit(word)), F.lit(False))


def from_immobiliare(sender: Column, subject: Column) -> Column:
    verdict = _says(sender, "immobiliare.it")
    for phrase in V.IMMOBILIARE_SUBJECTS:
        verdict = verdict | _says(subject, phrase)
    return verdict


def from_idealista(sender: Column) -> Column:
    return _says(sender, "idealista")


def from_casa(sender: Column) -> Column:
    return _says(sender, "casa.it")


def is_sale_alert(subject: Column, message_body: Column) -> Column:
    """Sale words decide only where no rent word occurs."""
    blob = F.concat_ws(" ", F.coalesce(message_body, F.lit("")), F.coalesce(subject, F.lit("")))
    return ~has(blob, V.RENT_ALERT) & has(blob, V.SALE_ALERT)


def immobiliare_anchor(text: Column) -> Column:
    t = collapse(text)
    return (F.length(t) >= 15) & ~has(t, V.FOOTER_LINK) & has(t, V.IMMOBILIARE_ANCHOR)


def idealista_anchor(text: Column) -> Column:
    t = collapse(text)
    return (F.length(t) >= 12) & ~has(t, V.FOOTER_LINK) & ~has(t, V.IDEALISTA_SKIP) & has(t, V.IDEALISTA_ANCHOR)


def is_call_to_action(text: Column) -> Column:
    t = collapse(text)
    return (F.length(t) < 4) | has(t, V.CALL_TO_ACTION)


def is_meaningful_title(title: Column) -> Column:
    t = collapse(F.coalesce(title, F.lit("")))
    return (F.length(t) >= 8) & ~has(t, r"^listing$") & ~is_call_to_action(t)


def _square_metres(area_sqm: Column) -> Column:
    return F.concat(number_text(area_sqm), F.lit(" m²"))


def with_subject_fields(df: DataFrame, subject: str, prefix: str) -> DataFrame:
    """Title, rent, area and place of a pipe-delimited subject; NULL elsewhere."""
    p = {n: f"{prefix}{n}" for n in ("title", "rent_eur", "area_sqm", "location_hint")}
    text, parts = f"_{prefix}text", f"_{prefix}parts"
    size = F.size(parts)
    tail = F.array_join(F.slice(parts, 3, F.greatest(size, F.lit(1))), ", ")
    hint = F.when(size >= 3, tail).otherwise(F.element_at(F.col(parts), -1))
    named = F.concat_ws(" — ", _square_metres(F.col(p["area_sqm"])), F.col(p["location_hint"]))
    df = stages(
        df,
        {text: strip(group(F.col(subject), V.SUBJECT_ALERT))},
        {parts: F.transform(F.split(F.col(text), r"\|"), strip), p["area_sqm"]: amounts.area(F.col(text))},
        {p["location_hint"]: F.nullif(cut(hint, 120), F.lit(""))},
        {p["title"]: F.when(F.col(text).isNotNull(), F.coalesce(F.nullif(named, F.lit("")), cut(F.col(text), 200)))},
    )
    return amounts.with_rent(df, text, p["rent_eur"]).drop(text, parts)


def built_title(title: Column, area_sqm: Column, hint: Column, rent_eur: Column) -> Column:
    facts = F.nullif(F.concat_ws(" — ", _square_metres(area_sqm), filled(strip(hint))), F.lit(""))
    price = F.concat(F.lit("Affitto "), rent_eur.cast("string"), F.lit(" €/mese"))
    return cut(F.when(is_meaningful_title(title), strip(title)).otherwise(F.coalesce(facts, price)), 200)


def block_hint(block: Column) -> Column:
    """Place named in a text block, else the city if it is named."""
    place = cut(collapse(group(block, V.BLOCK_LOCATION, 0)), 120)
    return F.coalesce(place, F.when(has(block, V.CITY_WORD), F.lit("Torino")))


def hint_from_title(title: Column) -> Column:
    """Text after in/a, else the title."""
    return F.coalesce(cut(strip(group(title, V.HINT_AFTER_IN)), 120), cut(title, 120))


def hint_from_title_or_block(title: Column, block: Column) -> Column:
    return F.coalesce(
        cut(group(title, V.HINT_AFTER_TYPE), 120),
        cut(strip(group(block, V.HINT_BEFORE_TURIN)), 120),
        cut(title, 120),
    )


def keeps_draft(sender, title, hint, snippet, rent_eur, area_sqm, sale=None) -> Column:
    """Gate before a draft of an alert reaches the listing table; ``sale`` rejects all."""
    blank = F.lit("")
    text, name = F.coalesce(snippet, blank), F.coalesce(title, blank)
    known = rent_eur.isNotNull()
    idealista = known & amounts.has_monthly_hint(F.concat_ws(" ", text, name))
    casa = known & is_meaningful_title(title) & (area_sqm.isNotNull() | filled(hint).isNotNull())
    other = F.coalesce(rent_eur <= V.RENT_HINT_ABOVE, F.lit(True)) | amounts.has_monthly_hint(text)
    return (
        F.when(F.lit(False) if sale is None else sale, F.lit(False))
        .when(from_idealista(sender), idealista)
        .when(from_casa(sender), casa)
        .otherwise(other)
    )
