"""Predicates and projections for group posts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rentlake import fixed_values as V
from rentlake.functions import amounts
from rentlake.functions.regex import collapse, cut, cut_before, filled, group, has, has_any, js, strip


def strip_html(html: Column) -> Column:
    """Text of a page: scripts, styles and tags become blanks, four entities decoded."""
    text = html
    for pattern in (r"<script[\s\S]*?<\/script>", r"<style[\s\S]*?<\/style>", r"<[^>]+>"):
        text = F.regexp_replace(text, js(pattern), " ")
    for entity, char in (("&nbsp;", " "), ("&amp;", "&"), ("&quot;", '"'), ("&#39;", "'")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def decode_href(href: Column) -> Column:
    return F.replace(F.replace(href, F.lit("&amp;"), F.lit("&")), F.lit("&quot;"), F.lit('"'))


def cut_at_comments(text: Column) -> Column:
    """Collapsed feed text without the comments."""
    return cut_before(text, V.FEED_CUT_MARKERS, 30)


def clean(text: Column) -> Column:
    """Collapsed text without the comment thread that follows a post."""
    return cut_before(collapse(text), V.FEED_UI_MARKERS, 20)


def is_student(text: Column) -> Column:
    return has_any(collapse(text), V.STUDENT_MARKERS)


def is_noise(text: Column) -> Column:
    return has_any(collapse(text), V.FEED_UI_MARKERS)


def looks_like_rental(cleaned: Column) -> Column:
    """Expects cleaned text."""
    for_sale = has_any(cleaned, V.SALE_MARKERS) & ~has(cleaned, V.AFFITT)
    return F.coalesce(F.length(cleaned) >= 20, F.lit(False)) & ~for_sale & has_any(cleaned, V.RENT_MARKERS)


def names_price(text: Column) -> Column:
    return has(text, V.EXPLICIT_RENT)


def is_conversation(cleaned: Column) -> Column:
    """Expects cleaned text."""
    return has_any(cleaned, V.CONVERSATION_MARKERS) & ~names_price(cleaned) & ~has(cleaned, V.AFFITT)


def is_post_url(canonical_url: Column) -> Column:
    return has(canonical_url, r"facebook\.com")


def gate_text(message: Column, title: Column, snippet: Column) -> Column:
    """Text the gate looks at, before ``clean``."""
    blank = F.lit("")
    return F.concat_ws(" ", F.coalesce(message, blank), F.coalesce(title, blank), F.coalesce(snippet, blank))


def keeps_draft(cleaned, canonical_url, rent_eur, rooms, area_sqm, hint) -> Column:
    """Gate before a draft of a post reaches the listing table; takes the cleaned gate text."""
    dear = F.coalesce(rent_eur > V.RENT_HINT_ABOVE, F.lit(False)) & ~amounts.has_monthly_hint(cleaned)
    priced = names_price(cleaned)
    in_range = F.coalesce(rent_eur.between(200, 1500), F.lit(False))
    facts = rent_eur.isNotNull() & (rooms.isNotNull() | area_sqm.isNotNull() | F.coalesce(hint != "", F.lit(False)))
    return (
        ~is_student(cleaned)
        & ~is_noise(cleaned)
        & ~is_conversation(cleaned)
        & looks_like_rental(cleaned)
        & ~dear
        & (~is_post_url(canonical_url) | ((in_range | priced) & (facts | priced)))
    )


def digest_ready(title, cleaned_title, rent_eur, area_sqm, rooms, hint) -> Column:
    """Gate before a post listing reaches the digest."""
    name = F.coalesce(title, F.lit(""))
    facts = area_sqm.isNotNull() | rooms.isNotNull() | filled(hint).isNotNull()
    return (
        ~is_noise(name)
        & ~is_conversation(cleaned_title)
        & F.coalesce(rent_eur >= 200, F.lit(False))
        & facts
        & (F.length(strip(name)) >= 15)
    )


def post_title(cleaned: Column) -> Column:
    """First sentence longer than ten characters, else the head of the cleaned text."""
    lines = F.filter(F.transform(F.split(cleaned, r"[.\n]"), strip), lambda x: F.length(x) > 10)
    first = F.coalesce(F.try_element_at(lines, F.lit(1)), cut(cleaned, 120))
    return F.coalesce(F.nullif(cut(first, 200), F.lit("")), F.lit(V.POST_TITLE_DEFAULT))


def place_hint(text: Column) -> Column:
    return cut(strip(group(text, V.POST_PLACE, 0)), 120)


def group_ids(text: Column) -> Column:
    """Ids and slugs of a comma or blank separated list, in order, once each."""
    parts = F.transform(F.split(text, js(r"[,\s]+")), strip)
    return F.array_distinct(F.filter(parts, lambda p: p.rlike(js(V.GROUP_ID))))
