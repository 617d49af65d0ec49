"""URL projections and listing sources."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from rentlake import fixed_values as V
from rentlake.functions.regex import cut, filled, group, has, js, strip

_SPLIT = r"\A\s*(https?)://([^/?#\\\s<>|^@]+)([^?#]*)(\?[^#]*)?(#[\s\S]*)?\z"


def _part(url: Column, n: int) -> Column:
    return F.regexp_extract(url, "(?i)" + _SPLIT, n)


def host(url: Column) -> Column:
    """Lower-case host, NULL if the URL does not parse."""
    return F.nullif(F.regexp_replace(F.lower(_part(url, 2)), r":\d*\z", ""), F.lit(""))


def _port(url: Column) -> Column:
    """``:port`` unless it is the scheme's own."""
    port = F.regexp_extract(_part(url, 2), r":0*(\d+)\z", 1)
    usual = F.when(F.lower(_part(url, 1)) == "http", "80").otherwise("443")
    return F.when((port == "") | (port == usual), F.lit("")).otherwise(F.concat(F.lit(":"), port))


# Bytes the form encoding escapes and a path keeps, in the order in which they are put back.
_KEPT_IN_PATH = "/:@!$&'(),;=[]|^~+%"
_DOT_SEGMENT = r"(?i)(?:\A|/)(?:\.|%2e){1,2}(?:/|\z)"


def _without_dots(path: Column) -> Column:
    """Path without ``.`` and ``..`` segments, however they are spelled."""
    segments = F.split(F.substring(path, 2, 1 << 30), "/")
    numbered = F.transform(segments, lambda x, i: F.struct(F.regexp_replace(x, "(?i)%2e", ".").alias("plain"), x.alias("text"), (i == F.size(segments) - 1).alias("last")))
    none = F.array().cast("array<string>")
    end = lambda x: F.when(x["last"], F.array(F.lit(""))).otherwise(none)
    up = lambda done: F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
    done = F.aggregate(
        numbered, none,
        lambda acc, x: F.when(x["plain"] == "..", F.concat(up(acc), end(x))).when(x["plain"] == ".", F.concat(acc, end(x))).otherwise(F.concat(acc, F.array(x["text"]))),
    )
    return F.concat(F.lit("/"), F.array_join(done, "/"))


def _encoded_path(path: Column) -> Column:
    """Characters outside the path's own set as UTF-8 escapes; escapes in the text stay."""
    text = F.replace(F.url_encode(path), F.lit("+"), F.lit("%20"))
    for char in _KEPT_IN_PATH:
        text = F.replace(text, F.lit(f"%{ord(char):02X}"), F.lit(char))
    return F.when(path.rlike(r"[^!$-;=@-_a-z|~]"), text).otherwise(path)


def path(url: Column) -> Column:
    """Path, at least ``/``."""
    plain = F.translate(_part(url, 3), "\\\t\r\n", "/")
    whole = F.when(plain == "", F.lit("/")).when(plain.rlike(_DOT_SEGMENT), _without_dots(plain)).otherwise(plain)
    return _encoded_path(whole)


def _form(text: Column) -> Column:
    """Name or value of a query as the form encoding spells it."""
    lone = F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25")
    return F.when(text.rlike(r"[^A-Za-z0-9*._+-]"), F.url_encode(F.url_decode(lone))).otherwise(text)


def search(url: Column) -> Column:
    """Query part without the campaign parameters, ``''`` if nothing is left."""
    pairs = F.filter(F.split(F.substring(_part(url, 4), 2, 1 << 30), "&"), lambda p: p != "")
    spelled = F.transform(
        pairs,
        lambda p: F.struct(
            _form(F.substring_index(p, "=", 1)).alias("name"),
            _form(F.when(F.contains(p, F.lit("=")), F.substring(p, F.length(F.substring_index(p, "=", 1)) + 2, F.length(p))).otherwise(F.lit(""))).alias("value"),
        ),
    )
    kept = F.filter(spelled, lambda p: ~p["name"].isin(*V.UTM_PARAMS))
    text = F.array_join(F.transform(kept, lambda p: F.concat(p["name"], F.lit("="), p["value"])), "&")
    return F.when(text == "", F.lit("")).otherwise(F.concat(F.lit("?"), text))


def bare_host(url: Column) -> Column:
    return F.regexp_replace(host(url), r"\Awww\.", "")


def canonical(url: Column) -> Column:
    """Stable form of a listing URL; NULL if it is not an http(s) URL."""
    where = path(url)
    immobili = F.regexp_extract(where, r"(?i)/immobili/(\d+)", 1)
    annunci = F.regexp_extract(where, r"(?i)/annunci/(\d+)", 1)
    is_casa = F.endswith(bare_host(url), F.lit("casa.it"))
    return (
        F.when(host(url).isNull(), F.lit(None).cast("string"))
        .when(is_casa & (immobili != ""), F.concat(F.lit(V.CASA_URL_IMMOBILI), immobili, F.lit("/")))
        .when(is_casa & (annunci != ""), F.concat(F.lit(V.CASA_URL_ANNUNCI), annunci, F.lit("/")))
        .otherwise(F.concat(F.lower(_part(url, 1)), F.lit("://"), host(url), _port(url), where, search(url)))
    )


def _listing_page_pattern() -> str:
    """One pattern: no tracking host, a portal domain, a listing path of that portal."""
    blocked = "|".join(re.escape(p) for p in V.TRACKING_HOST_PREFIXES)
    portals = "|".join(
        rf"{re.escape(domain)}(?::\d+)?(?=[/?]).*?(?:{'|'.join(paths)})" for domain, paths in V.LISTING_PATHS.items()
    )
    return rf"(?i)\A\s*https?://(?:www\.)?+(?!{blocked})[^/?#\\\s<>|^@]*?(?:{portals})"


def is_listing_page(url: Column) -> Column:
    """A known portal, no tracking host, and a listing path."""
    return F.coalesce(F.substring_index(url, "#", 1).rlike(_listing_page_pattern()), F.lit(False))


def is_portal_or_listing(url: Column) -> Column:
    return is_listing_page(url) | has(url, V.PORTAL_HOST)


def _last_two(name: Column) -> Column:
    labels = F.filter(F.split(name, r"\."), lambda x: x != "")
    return F.when(F.size(labels) >= 2, F.concat_ws(".", F.slice(labels, -2, 2)))


def base_domain(hostname: Column) -> Column:
    """Site domain behind tracking and www labels; NULL if fewer than two labels stay."""
    labels = "|".join(V.TRACKING_LABELS)
    bare = F.regexp_replace(F.lower(hostname), r"\.\z", "")
    return _last_two(F.regexp_replace(bare, rf"\A(?:(?:{labels})\.)+", ""))


def site_of(url: Column) -> Column:
    """Last two labels of the host without www."""
    labels = F.split(bare_host(url), r"\.")
    return F.concat_ws(".", F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), F.lit(2)))


def _is_http(url: Column) -> Column:
    return F.coalesce(F.startswith(url, F.lit("http")), F.lit(False))


def _http_site(url: Column) -> Column:
    return F.when(_is_http(url), base_domain(host(url)))


def infer_source(source: Column, listing_url: Column, canonical_url: Column) -> Column:
    dotted = F.when(F.contains(source, F.lit(".")), strip(F.lower(F.regexp_replace(source, r"\Awww\.", ""))))
    return F.coalesce(_http_site(listing_url), _http_site(canonical_url), dotted)


def portal_home(source_key: Column, listing_url: Column, canonical_url: Column) -> Column:
    dotted = F.when(F.contains(source_key, F.lit(".")), F.lower(F.regexp_replace(source_key, r"\Awww\.", "")))
    site = F.coalesce(_http_site(listing_url), _http_site(canonical_url), dotted)
    return F.concat(F.lit("https://www."), site)


def source_line(source: Column, listing_url: Column, canonical_url: Column) -> Column:
    link = F.coalesce(listing_url, canonical_url)
    post = F.when(F.contains(link, F.lit("facebook.com")), F.concat(F.lit("📌 Facebook · "), link)).otherwise(
        F.lit("📌 Facebook group")
    )
    home = portal_home(infer_source(source, listing_url, canonical_url), listing_url, canonical_url)
    return F.when(source == V.POST_SOURCE, post).otherwise(F.concat(F.lit("📌 "), home))


def url_score(url: Column) -> Column:
    score = F.when(_is_http(url), F.lit(5)).otherwise(F.lit(0))
    for pattern, points in reversed(V.URL_SCORES):
        score = F.when(has(url, pattern), F.lit(points)).otherwise(score)
    return score


def preferred_url(old: Column, new: Column) -> Column:
    """Higher score wins, a tie goes to the new one; blanks do not count."""
    return (
        F.when(filled(old).isNull(), filled(new)).when(filled(new).isNull(), old)
        .when(url_score(old) > url_score(new), old).otherwise(new)
    )


def better_title(old: Column, new: Column) -> Column:
    """Longer trimmed title wins, a tie keeps the old one."""
    a, b = F.nullif(strip(old), F.lit("")), F.nullif(strip(new), F.lit(""))
    return F.when(F.length(b) > F.length(a), b).otherwise(F.coalesce(a, b))


def open_link(listing_url: Column, canonical_url: Column) -> Column:
    """Link a reader can open; synthetic alert URLs are not one."""
    synthetic = F.contains(canonical_url, F.lit("/annunci/alert-"))
    return F.when(_is_http(listing_url), listing_url).when(_is_http(canonical_url) & ~synthetic, canonical_url)


def immobile_id(href: Column) -> Column:
    return group(href, V.IMMOBILE_ID)


def immobile_url(listing_id: Column) -> Column:
    return F.concat(F.lit(V.IDEALISTA_URL), listing_id, F.lit("/"))


def click_id(href: Column) -> Column:
    return cut(group(href, V.CLICK_ID_CS, fold_case=False), 12)


def click_url(href: Column) -> Column:
    bare = strip(href)
    return F.when(bare.rlike(r"\Ahttps?://"), bare).otherwise(F.concat(F.lit("https://"), bare))


def post_permalink(href: Column, group_id: Column, post_id: Column) -> Column:
    default = F.concat(F.lit(V.FACEBOOK + "/groups/"), group_id, F.lit("/posts/"), post_id, F.lit("/"))
    absolute = F.when(_is_http(href) & host(href).isNotNull(), F.concat(F.lit(V.FACEBOOK), path(href)))
    relative = F.when(F.startswith(href, F.lit("/")), F.concat(F.lit(V.FACEBOOK), F.substring_index(href, "?", 1)))
    return F.coalesce(absolute, relative, default)


def urls_in(text: Column) -> Column:
    """URLs in free text, closing punctuation removed."""
    found = F.regexp_extract_all(text, F.lit(js(V.POST_URL)), F.lit(0))
    return F.transform(found, lambda u: F.regexp_replace(u, js(V.POST_URL_TAIL_CS, False), ""))
