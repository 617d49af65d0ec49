"""Identity keys of a listing."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from rentlake import fixed_values as V
from rentlake.functions.regex import collapse, half_up, js, number_text


def _accent_pairs() -> tuple[str, str]:
    """Every Latin, Greek or Cyrillic letter that is a base letter plus marks."""
    marked, plain = [], []
    for code in (*range(0x00C0, 0x0530), *range(0x1E00, 0x2000)):
        parts = unicodedata.normalize("NFD", chr(code))
        base = "".join(c for c in parts if not unicodedata.category(c).startswith("M"))
        if len(parts) > 1 and len(base) == 1:
            marked.append(chr(code))
            plain.append(base)
    return "".join(marked), "".join(plain)


_MARKED, _PLAIN = _accent_pairs()


def fold(text: Column) -> Column:
    """Lower case, no accents, full stops and commas as blanks, blanks collapsed."""
    low = F.lower(text)
    bare = F.regexp_replace(F.translate(low, _MARKED, _PLAIN), r"\p{M}", "")
    is_ascii = F.octet_length(text) == F.length(text)
    return collapse(F.replace(F.replace(F.when(is_ascii, low).otherwise(bare), F.lit("."), F.lit(" ")), F.lit(","), F.lit(" ")))


def street_key(text: Column) -> Column:
    """``via-<name>[-<number>]`` of the first street in the text."""
    words = F.split(F.regexp_extract(fold(text), js(V.STREET, fold_case=False), 0), " ")
    # Empty as null by way of an array: inside a condition, nullif derives its text twice.
    rest = F.array_remove(F.array(F.array_join(F.slice(words, 2, 2), "-")), F.lit(""))
    return F.concat(F.lit("via-"), F.get(rest, F.lit(0)))


def street_text(hint: Column, title: Column, snippet: Column) -> Column:
    """Where the street of a listing is looked for."""
    blank = F.lit("")
    return F.concat_ws(" ", F.coalesce(hint, blank), F.coalesce(title, blank), F.coalesce(snippet, blank))


def _whole(value: Column) -> Column:
    return F.coalesce(half_up(value).cast("string"), F.lit("?"))


def _if_rent(rent_eur: Column, key: Column) -> Column:
    return F.when(rent_eur >= 100, key)


def fingerprint(street, rent_eur, rooms, area_sqm) -> Column:
    """Key across portals: street, rooms, area and rent."""
    return _if_rent(
        rent_eur,
        F.concat(street, F.lit("|r"), _whole(rooms), F.lit("|a"), _whole(area_sqm), F.lit("|€"), rent_eur.cast("string")),
    )


def match_key(street, rent_eur, rooms) -> Column:
    """Softer key without the area."""
    return _if_rent(rent_eur, F.concat(street, F.lit("|r"), _whole(rooms), F.lit("|€"), rent_eur.cast("string")))


def material_hash(rent_eur, area_sqm, rooms, hint) -> Column:
    blank = F.lit("")
    text = F.concat_ws(
        "|",
        F.coalesce(rent_eur.cast("string"), blank),
        F.coalesce(number_text(area_sqm), blank),
        F.coalesce(number_text(rooms), blank),
        F.coalesce(hint, blank),
    )
    return F.substring(F.sha2(text, 256), 1, 16)


def alert_url(title, rent_eur, area_sqm) -> Column:
    """Stable URL for alerts whose click links change from mail to mail."""
    blank = F.lit("")
    text = F.concat_ws(
        "|", F.lower(title), F.coalesce(rent_eur.cast("string"), blank), F.coalesce(number_text(area_sqm), blank)
    )
    return F.concat(F.lit(V.ALERT_URL), F.substring(F.sha2(text, 256), 1, 20), F.lit("/"))


def listing_id(canonical_url: Column) -> Column:
    """Deterministic id, so that a rerun gives the same rows."""
    return F.substring(F.sha2(canonical_url, 256), 1, 24)
