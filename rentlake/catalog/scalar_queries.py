"""Text, number, JSON and predicate operators, row by row over whole views."""

from __future__ import annotations

from pyspark.sql import functions as F

from rentlake import criteria
from rentlake import fixed_values as V
from rentlake.catalog import sqlkit as S
from rentlake.catalog.registry import projection
from rentlake.functions import alerts, amounts, cards, keys, places, posts, replies, rules, urls
from rentlake.functions.regex import collapse, cut, half_up
from rentlake.operators import digest, scoring, tables
from rentlake.operators.upsert import merged_alternates
from rentlake.sources import landing

C = criteria.load()
NONE = "cast(null as varchar)"


def null():
    return F.lit(None).cast("string")


def STREETED(rows):
    return rows.withColumn("street", keys.street_key(keys.street_text(F.col("location_hint"), F.col("title"), F.col("raw_snippet"))))


def SCORED(rows):
    return rows.withColumn("doc", replies.document(F.col("response"))).withColumn("scores", replies.criteria_scores(F.col("doc")))


def CLEANED(rows):
    return rows.withColumn("clean_text", posts.clean(F.col("message")))


# --- text and URLs -----------------------------------------------------------
projection("t1_collapse_text", "messages", ["message_id"],
           lambda c: {"text": cut(collapse(c("html_body")), 400)},
           {"text": f"left({S.collapse('html_body')}, 400)"})
projection("t2_strip_html", "messages", ["message_id"],
           lambda c: {"text": collapse(posts.strip_html(c("html_body")))},
           [{"a": f"regexp_replace(html_body, {S.re2(r'<script[\s\S]*?<\/script>')}, ' ', 'g')"},
            {"b": f"regexp_replace(a, {S.re2(r'<style[\s\S]*?<\/style>')}, ' ', 'g')"},
            {"d": "regexp_replace(b, '<[^>]+>', ' ', 'g')"},
            {"e": "replace(replace(replace(replace(d, '&nbsp;', ' '), '&amp;', '&'), '&quot;', '\"'), '&#39;', '''')"},
            {"text": S.collapse("e")}])
projection("t3_decode_href", "messages", ["message_id"],
           lambda c: {"decoded": posts.decode_href(c("html_body"))},
           {"decoded": "replace(replace(html_body, '&amp;', '&'), '&quot;', '\"')"})
projection("t4_cut_at_comments", "feed_pages", ["page_id"],
           lambda c: {"text": c("cut_text")},
           [{"t": S.collapse("replace(replace(regexp_replace(regexp_replace(html, '(?i)<script[\\s\\S]*?</script>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '&amp;', '&'), '&#39;', '''')")},
            *S.cut_before("t", "cutted", V.FEED_CUT_MARKERS, 30), {"text": "trim(cutted)"}],
           prepare=lambda d: d.withColumn("cut_text", posts.cut_at_comments(collapse(posts.strip_html(F.col("html"))))))
projection("t5_clean_post", "posts", ["post_id"],
           lambda c: {"text": c("clean_text")},
           [{"t": S.collapse("message")}, *S.cut_before("t", "text", V.FEED_UI_MARKERS, 20)], ["text"], prepare=CLEANED)
projection("t6_permalink", "feed_pages", ["page_id"],
           lambda c: {"permalink": urls.post_permalink(F.coalesce(F.nullif(F.regexp_extract(c("html"), 'href="([^"]*)"', 1), F.lit("")), F.lit("")), c("group_id"), c("page_id"))},
           [{"h": "regexp_extract(html, 'href=\"([^\"]*)\"', 1)"},
            {"permalink": f"""case when starts_with(h, 'http') then 'https://www.facebook.com' || regexp_extract(h, 'https?://[^/]+([^?#]*)', 1)
               when starts_with(h, '/') then 'https://www.facebook.com' || split_part(h, '?', 1)
               else 'https://www.facebook.com/groups/' || group_id || '/posts/' || page_id || '/' end"""}])
# Ports, dot segments, characters outside ASCII, blanks and escapes.
_ODD_URL = """concat(case when message_id % 2 = 0 then 'https' else 'http' end, '://www.Site.it', case message_id % 4 when 0 then ':443' when 1 then ':8080' when 2 then ':80' else '' end,
  case message_id % 3 when 0 then '/a/./b/../affitto/città/' when 1 then '/../x/y/../../zona 1/' else '/plain/%C3%A8/' end, cast(message_id as varchar(20)), '?q=due%20locali+e~l*a&utm_source=z&place=', case when message_id % 5 = 0 then 'Forlì' else '%2Fa' end, '#end')"""
projection("t7_canonical_url", "messages", ["message_id"],
           lambda c: {"canonical": urls.canonical(F.regexp_extract(c("html_body"), 'href="([^"]*)"', 1)),
                      "page_canonical": urls.canonical(F.concat(F.lit("http://x.Example.com/a?utm_medium=1&k="), c("message_id").cast("string"), F.lit("&flag#top"))),
                      "odd_canonical": urls.canonical(F.expr(_ODD_URL))},
           [{"h": "regexp_extract(html_body, 'href=\"([^\"]*)\"', 1)",
             "h2": "'http://x.Example.com/a?utm_medium=1&k=' || cast(message_id as varchar) || '&flag#top'", "h3": _ODD_URL},
            *S.canonical("h", "canonical"), *S.canonical("h2", "page_canonical"), *S.canonical("h3", "odd_canonical")], ["canonical", "page_canonical", "odd_canonical"])
projection("t8_base_domain", "drafts", ["draft_id"],
           lambda c: {"domain": urls.base_domain(urls.host(c("listing_url"))), "own": urls.base_domain(urls.host(c("canonical_url")))},
           {"domain": S.base_domain(S.host("listing_url")), "own": S.base_domain(S.host("canonical_url"))})
projection("t9_portal_home", "drafts", ["draft_id"],
           lambda c: {"home": urls.portal_home(c("source"), c("listing_url"), c("canonical_url")), "by_key": urls.portal_home(c("source"), null(), null())},
           {"home": S.portal_home("source", "listing_url", "canonical_url"), "by_key": S.portal_home("source", NONE, NONE)})
projection("t10_infer_source", "drafts", ["draft_id"],
           lambda c: {"inferred": urls.infer_source(c("source"), c("listing_url"), null()), "all_known": urls.infer_source(c("source"), c("listing_url"), c("canonical_url"))},
           {"inferred": S.source_key("source", "listing_url", NONE), "all_known": S.source_key("source", "listing_url", "canonical_url")})
projection("t11_source_line", "listings", ["id"],
           lambda c: {"line": urls.source_line(c("source"), c("listing_url"), c("canonical_url"))},
           {"line": S.source_line("source", "listing_url", "canonical_url")})
projection("t12_site_of", "drafts", ["draft_id"],
           lambda c: {"site": urls.site_of(c("canonical_url"))},
           {"site": f"array_to_string(string_split({S.bare_host('canonical_url')}, '.')[-2:], '.')"})
projection("t13_url_score", "drafts", ["draft_id"],
           lambda c: {"score": urls.url_score(c("canonical_url")), "link_score": urls.url_score(F.coalesce(c("listing_url"), F.lit("")))},
           {"score": S.url_score("canonical_url"), "link_score": S.url_score("coalesce(listing_url, '')")})
projection("t14_preferred_url", "drafts", ["draft_id"],
           lambda c: {"preferred": urls.preferred_url(c("listing_url"), c("canonical_url")), "reverse": urls.preferred_url(c("canonical_url"), c("listing_url"))},
           [{"l": "case when trim(listing_url) <> '' then listing_url end"},
            {"preferred": f"case when {S.url_score('l')} > {S.url_score('canonical_url')} and l is not null then l else canonical_url end",
             "reverse": f"case when l is null or {S.url_score('canonical_url')} > {S.url_score('l')} then canonical_url else l end"}])
projection("t15_better_title", "drafts", ["draft_id"],
           lambda c: {"title": urls.better_title(c("title"), c("location_hint")), "other": urls.better_title(c("location_hint"), c("title"))},
           {"title": "case when location_hint is not null and length(trim(location_hint)) > length(trim(title)) then trim(location_hint) else trim(title) end",
            "other": "case when location_hint is null or length(trim(title)) > length(trim(location_hint)) then trim(title) else trim(location_hint) end"})
projection("t16_open_link", "drafts", ["draft_id"],
           lambda c: {"link": urls.open_link(c("listing_url"), c("canonical_url")), "alert": urls.open_link(null(), F.concat(F.lit(V.ALERT_URL), c("draft_key")))},
           {"link": S.open_link("listing_url", "canonical_url"), "alert": "cast(null as varchar)"})
projection("t17_immobile_id", "drafts", ["draft_id"],
           lambda c: {"listing_no": urls.immobile_id(c("canonical_url")), "url": urls.immobile_url(urls.immobile_id(c("canonical_url")))},
           [{"listing_no": S.group("canonical_url", V.IMMOBILE_ID)}, {"url": "'https://www.idealista.it/immobile/' || listing_no || '/'"}], ["listing_no", "url"])
projection("t18_click_id", "drafts", ["draft_id"],
           lambda c: {"click": urls.click_id(c("listing_url")), "url": urls.click_url(F.regexp_replace(c("listing_url"), "^https://", ""))},
           [{"click": "left(nullif(regexp_extract(listing_url, '/f/a/([^/~]+)', 1), ''), 12)"},
            {"url": "case when listing_url is null then null else 'https://' || trim(regexp_replace(listing_url, '^https://', '')) end"}], ["click", "url"])
projection("t19_alert_url", "drafts", ["draft_id"],
           lambda c: {"url": keys.alert_url(c("title"), c("rent_eur"), c("area_sqm"))},
           {"url": f"'https://www.immobiliare.it/annunci/alert-' || left(sha256(lower(title) || '|' || coalesce(cast(rent_eur as varchar), '') || '|' || {S.num('area_sqm')}), 20) || '/'"})
projection("t20a_hint_from_title", "messages", ["message_id"],
           lambda c: {"hint": alerts.hint_from_title(c("subject")), "city": alerts.hint_from_title(F.concat(F.lit("Trilocale in "), c("subject")))},
           {"hint": f"coalesce(left({S.strip(S.group('subject', V.HINT_AFTER_IN))}, 120), left(subject, 120))",
            "city": f"coalesce(left({S.strip(S.group("('Trilocale in ' || subject)", V.HINT_AFTER_IN))}, 120), left('Trilocale in ' || subject, 120))"})
projection("t20b_hint_from_title_or_block", "drafts", ["draft_id"],
           lambda c: {"hint": alerts.hint_from_title_or_block(F.when(c("draft_id") % 2 == 0, F.concat(F.lit("2-room flat "), c("title"))).otherwise(c("title")), F.concat(c("title"), F.lit(", "), F.coalesce(c("location_hint"), F.lit("x")), F.lit(", Turin")))},
           [{"t": "case when draft_id % 2 = 0 then '2-room flat ' || title else title end", "b": "title || ', ' || coalesce(location_hint, 'x') || ', Turin'"},
            {"hint": f"coalesce(left({S.group('t', V.HINT_AFTER_TYPE)}, 120), left({S.strip(S.group('b', V.HINT_BEFORE_TURIN))}, 120), left(t, 120))"}])
projection("t20c_hint_from_post", "posts", ["post_id"],
           lambda c: {"hint": posts.place_hint(c("message"))},
           {"hint": f"left({S.strip(S.group('message', V.POST_PLACE, 0))}, 120)"})
_SUBJECT = [
    {"body": S.strip(S.group("subject", V.SUBJECT_ALERT))},
    {"parts": "list_transform(string_split(body, '|'), lambda p: trim(p))", "area_sqm": S.area("body")},
    {"location_hint": "nullif(left(case when len(parts) >= 3 then array_to_string(parts[3:], ', ') else parts[-1] end, 120), '')"},
    {"named": "concat_ws(' — ', cast(cast(area_sqm as bigint) as varchar) || ' m²', location_hint)"},
    {"title": "case when body is not null then coalesce(nullif(named, ''), left(body, 200)) end"},
    *S.rent("body", "rent_eur"),
]
projection("t21_subject_fields", "messages", ["message_id"],
           lambda c: {n: c(f"s_{n}") for n in ("title", "rent_eur", "area_sqm", "location_hint")},
           _SUBJECT, ["title", "rent_eur", "area_sqm", "location_hint"], prepare=lambda d: alerts.with_subject_fields(d, "subject", "s_"))
projection("t22_built_title", "drafts", ["draft_id"],
           lambda c: {"title": alerts.built_title(F.when(c("draft_id") % 3 == 0, c("title")).when(c("draft_id") % 3 == 1, F.lit("Vedi 3 foto")), F.when(c("draft_id") % 5 < 3, c("area_sqm")), F.when(c("draft_id") % 5 < 2, c("location_hint")), c("rent_eur"))},
           [{"t": "case draft_id % 3 when 0 then title when 1 then 'Vedi 3 foto' end", "a": "case when draft_id % 5 < 3 then area_sqm end", "h": "case when draft_id % 5 < 2 then location_hint end"},
            {"facts": f"nullif(concat_ws(' — ', {S.num('a')} || ' m²', case when trim(h) <> '' then trim(h) end), '')"},
            {"out_title": f"left(case when {S.meaningful('t')} then trim(t) else coalesce(facts, 'Affitto ' || cast(rent_eur as varchar) || ' €/mese') end, 200)"}],
           ["out_title as title"])
projection("t23_block_fields", "messages", ["message_id"],
           lambda c: {"rent_eur": c("r"), "area_sqm": amounts.area(c("td")), "rooms": amounts.rooms(c("td")), "location_hint": alerts.block_hint(c("td"))},
           [{"b": "regexp_extract(html_body, '<td>(.*?)</td>', 1)"}, *S.rent("b", "rent_eur"),
            {"area_sqm": S.area("b"), "rooms": S.rooms("b"),
             "location_hint": f"coalesce(left({S.collapse(S.group('b', V.BLOCK_LOCATION, 0))}, 120), case when {S.has('b', V.CITY_WORD)} then 'Torino' end)"}],
           ["rent_eur", "area_sqm", "rooms", "location_hint"],
           prepare=lambda d: amounts.with_rent(d.withColumn("td", F.regexp_extract("html_body", "<td>(.*?)</td>", 1)), "td", "r"))
projection("t24_street_key", "drafts", ["draft_id"],
           lambda c: {"street": keys.street_key(c("title")), "accented": keys.street_key(F.concat(F.lit("Corso Così, "), c("draft_id").cast("string"), F.lit("B")))},
           {"street": S.street("title"), "accented": S.street("('Corso Così, ' || cast(draft_id as varchar) || 'B')")})
_STREET = {"street": S.street(S.blob("location_hint", "title", "raw_snippet"))}
projection("t25_fingerprint", "drafts", ["draft_id"],
           lambda c: {"fingerprint": keys.fingerprint(c("street"), c("rent_eur"), c("rooms"), c("area_sqm"))},
           [_STREET, {"fingerprint": f"case when rent_eur >= 100 then street || '|r' || {S.whole('rooms')} || '|a' || {S.whole('area_sqm')} || '|€' || cast(rent_eur as varchar) end"}], prepare=STREETED)
projection("t26_match_key", "drafts", ["draft_id"],
           lambda c: {"match_key": keys.match_key(c("street"), c("rent_eur"), c("rooms"))},
           [_STREET, {"match_key": f"case when rent_eur >= 100 then street || '|r' || {S.whole('rooms')} || '|€' || cast(rent_eur as varchar) end"}], prepare=STREETED)
HASH = f"left(sha256(coalesce(cast(rent_eur as varchar), '') || '|' || coalesce({S.num('area_sqm')}, '') || '|' || coalesce({S.num('rooms')}, '') || '|' || coalesce(location_hint, '')), 16)"
projection("t27_material_hash", "drafts", ["draft_id"],
           lambda c: {"hash": keys.material_hash(c("rent_eur"), c("area_sqm"), c("rooms"), c("location_hint"))}, {"hash": HASH})
projection("t28_geocode_key", "posts", ["post_id"],
           lambda c: {"geo_key": places.geocode_key(c("message"))}, {"geo_key": S.fold("message")})
GEO_QUERY = [
    {"raw": S.collapse("coalesce(case when trim(location_hint) <> '' then location_hint end, case when trim(title) <> '' then title end, '')")},
    {"city": "case when contains(lower(raw), 'torino') or contains(lower(raw), 'turin') then raw else raw || ', Torino, Italy' end"},
    {"bare": S.collapse(f"regexp_replace(city, {S.re2(V.SNC)}, '', 'g')")},
    {"geo_query": "case when length(raw) >= 5 then trim(regexp_replace(regexp_replace(bare, ' +,', ',', 'g'), ',\\s*,', ',', 'g')) end"},
]
projection("t29_geocode_query", "drafts", ["draft_id"],
           lambda c: {"geo_query": c("gq")}, GEO_QUERY, prepare=lambda d: places.with_geocode_query(d, F.col("location_hint"), F.col("title"), "gq", C.city_suffix))
projection("t30_tidy_query", "drafts", ["draft_id"],
           lambda c: {"tidy": places.tidy_query(F.concat(c("title"), F.lit(" s.n.c , , "), F.coalesce(c("location_hint"), F.lit("S N C x"))))},
           [{"x": "title || ' s.n.c , , ' || coalesce(location_hint, 'S N C x')"}, {"b": S.collapse(f"regexp_replace(x, {S.re2(V.SNC)}, '', 'g')")},
            {"tidy": "trim(regexp_replace(regexp_replace(b, ' +,', ',', 'g'), ',\\s*,', ',', 'g'))"}])
projection("t31_distance_text", "drafts", ["draft_id"],
           lambda c: {"distance": places.distance_text(F.pmod(c("draft_id") * 50, F.lit(30000)).cast("int"))},
           [{"m": "cast((draft_id * 50) % 30000 as integer)"}, {"distance": S.distance_text("m")}])
projection("t34_fill_template", "drafts", ["draft_id"],
           lambda c: {"text": replies.fill("{{a}} at {{b}} {{a}} {{missing}}", {"a": c("title"), "b": F.coalesce(c("location_hint"), F.lit("{{a}}"))})},
           {"text": "replace(replace('{{a}} at {{b}} {{a}} {{missing}}', '{{a}}', title), '{{b}}', coalesce(location_hint, '{{a}}'))"})
_JSON = [
    {"snip": "left(raw_snippet, 800)", "total": "coalesce(rent_eur + condo_fee_eur, rent_eur)"},
    {"json": "'{' || concat_ws(',', '\"title\":\"' || title || '\"', '\"rentEur\":' || rent_eur, '\"condoFeeEur\":' || condo_fee_eur, '\"totalCostEur\":' || total,"
             f" '\"areaSqm\":' || {S.num('area_sqm')}, '\"rooms\":' || {S.num('rooms')}, '\"location\":\"' || location_hint || '\"', '\"snippet\":\"' || snip || '\"') || '}}'"},
]


def _payload(c):
    return replies.listing_json(c("title"), c("rent_eur"), c("condo_fee_eur"), c("area_sqm"), c("rooms"), c("location_hint"), c("raw_snippet"))


projection("j7_listing_json", "drafts", ["draft_id"], lambda c: {"json": _payload(c)}, _JSON, ["json"])


def _prompt_sql() -> str:
    out = S.q(C.rating_prompt)
    for key, value in {"listingJson": None, **replies.prompt_values(C)}.items():
        out = f"replace({out}, {S.q('{{' + key + '}}')}, {'json' if value is None else S.q(value)})"
    return out


PROMPT_STEPS = [*_JSON, {"prompt": _prompt_sql()}]
projection("t35_prompt", "drafts", ["draft_id"], lambda c: {"prompt": replies.prompt(C, _payload(c))}, PROMPT_STEPS)
TEXT = f"lower({S.blob('raw_snippet', 'location_hint', 'title')})"
projection("t36_search_text", "drafts", ["draft_id"],
           lambda c: {"text": rules.search_text(c("raw_snippet"), c("location_hint"), c("title"))}, {"text": TEXT})
projection("t38_post_title", "posts", ["post_id"],
           lambda c: {"title": posts.post_title(c("clean_text"))},
           [{"t": S.collapse("message")}, *S.cut_before("t", "cleaned", V.FEED_UI_MARKERS, 20),
            {"line": "list_filter(list_transform(string_split_regex(cleaned, '[.\\n]'), lambda x: trim(x)), lambda x: length(x) > 10)[1]"},
            {"title": "coalesce(nullif(left(coalesce(line, left(cleaned, 120)), 200), ''), 'Facebook listing')"}], prepare=CLEANED)

# --- numbers -----------------------------------------------------------------
projection("n1_parse_amount", "drafts", ["draft_id"],
           lambda c: {n: c(n) for n in ("whole", "thousand", "plain", "spaced")},
           [{"x1": "cast(rent_eur as varchar) || '.500,50'", "x2": "'1,' || left(draft_key, 3)", "x3": "draft_key", "x4": "'1 ' || coalesce(cast(rent_eur as varchar), 'x') || '.0'"},
            *S.amount("x1", "a1"), *S.amount("x2", "a2"), *S.amount("x3", "a3"), *S.amount("x4", "a4")],
           ["cast(a1 as bigint) as whole", "cast(a2 as bigint) as thousand", "cast(a3 as bigint) as plain", "cast(a4 as bigint) as spaced"],
           prepare=lambda d: amounts.with_amounts(d.withColumns({
               "x1": F.concat(F.col("rent_eur").cast("string"), F.lit(".500,50")), "x2": F.concat(F.lit("1,"), F.substring("draft_key", 1, 3)),
               "x4": F.concat(F.lit("1 "), F.coalesce(F.col("rent_eur").cast("string"), F.lit("x")), F.lit(".0"))}),
               {"whole": "x1", "thousand": "x2", "plain": "draft_key", "spaced": "x4"}))
projection("n2_repair_thousand", "drafts", ["draft_id"],
           lambda c: {"amount": amounts.repair_thousand(c("rent_eur"), F.concat(F.lit("€ 1"), F.substring(c("draft_key"), -3, 1), F.lit("000/mese"))).cast("int")},
           [{"t": "'€ 1' || substr(draft_key, -3, 1) || '000/mese'"}, {"amount": f"cast(case when {S.has('t', V.RENT_THOUSAND)} or rent_eur = 1 then 1000 else rent_eur end as integer)"}])
projection("n3_accept_rent", "drafts", ["draft_id"],
           lambda c: {"accepted": amounts.accepted(c("rent_eur") * 3 - 500, c("title")), "monthly": amounts.accepted(c("rent_eur") * 30, F.concat(c("title"), F.lit(" al mese")))},
           [{"a": "rent_eur * 3 - 500", "b": "rent_eur * 30", "no": "false", "yes": "true"},
            {"accepted": f"cast({S.accept('a', 'no', 'no')} as integer)", "monthly": f"cast({S.accept('b', 'no', 'yes')} as integer)"}])
projection("n4_rent_from_text", "posts", ["post_id"], lambda c: {"rent_eur": c("found")}, S.rent("message", "rent_eur"), ["rent_eur"], prepare=lambda d: amounts.with_rent(d, "message", "found"))
projection("n4_rent_from_html", "messages", ["message_id"], lambda c: {"rent_eur": c("found")}, S.rent("html_body", "rent_eur"), ["rent_eur"], prepare=lambda d: amounts.with_rent(d, "html_body", "found"))
projection("n5_area", "posts", ["post_id"], lambda c: {"area_sqm": amounts.area(c("message"))}, {"area_sqm": S.area("message")})
projection("n6_rooms", "messages", ["message_id"], lambda c: {"rooms": amounts.rooms(c("html_body"))}, {"rooms": S.rooms("html_body")})
projection("n7_rooms_from_words", "drafts", ["draft_id"],
           lambda c: {"words": amounts.rooms_from_words(c("title")), "prefix": amounts.rooms_from_prefix(F.concat((c("draft_id") % 9).cast("string"), F.lit("-room flat")))},
           {"words": S.room_words("title"), "prefix": f"try_cast({S.group("(cast(draft_id % 9 as varchar) || '-room flat')", V.ROOMS_TITLE_PREFIX)} as double)"})
projection("n8_condo_fee", "messages", ["message_id"], lambda c: {"fee": amounts.condo_fee(c("html_body"))}, {"fee": S.fee("html_body")})
projection("n9_total_cost", "drafts", ["draft_id"], lambda c: {"total": amounts.total_cost(c("rent_eur"), c("condo_fee_eur"))}, {"total": "coalesce(rent_eur + condo_fee_eur, rent_eur)"})
LAT, LNG = repr(float(C.reference_lat)), repr(float(C.reference_lng))
projection("n10_haversine", "gazetteer", ["query_key"],
           lambda c: {"meters": half_up(places.haversine_m(c("lat"), c("lng"), F.lit(float(C.reference_lat)), F.lit(float(C.reference_lng)))).cast("int")},
           {"meters": f"cast(floor({S.haversine('lat', 'lng', f'cast({LAT} as double)', f'cast({LNG} as double)')} + 0.5) as integer)"})


def bucket_sql(m: str) -> str:
    cases = " ".join(f"when {m} <= {reach} then {points}" for reach, points in C.buckets)
    return f"(case when {m} is null or {m} < 0 then {C.missing_score} {cases} else 0 end)"


projection("n11_distance_score", "drafts", ["draft_id"],
           lambda c: {"score": places.distance_score((c("draft_id") % 6000 - 50).cast("int"), C.buckets, C.missing_score)},
           [{"m": "draft_id % 6000 - 50"}, {"score": bucket_sql("m")}])
projection("n12_clamp", "drafts", ["draft_id"],
           lambda c: {"clamped": replies.clamp10(F.when(c("rent_eur").isNotNull(), c("area_sqm") / 4 - 9.125))},
           [{"v": "case when rent_eur is not null then area_sqm / 4 - 9.125 end"}, {"clamped": "cast(case when v is null then 0 else least(10, greatest(0, floor(v + 0.5))) end as integer)"}])


def clamp_sql(x: str) -> str:
    return f"cast(coalesce(least(10, greatest(0, floor(try_cast({x} as double) + 0.5))), 0) as integer)"


SCORES = {f"k_{k}": clamp_sql(f"json_extract_string(response, '$.{k}')") for k in V.REPLY_KEYS}
SUM = " + ".join(SCORES)
projection("n13_composite", "replies", ["draft_id"], lambda c: {"composite": replies.composite(c("scores"))},
           [SCORES, {"composite": f"cast(least(100, {SUM}) as integer)"}], prepare=SCORED)
_N = S.num
HARD = [
    {"txt": TEXT},
    {"fails": "concat_ws('; ', " + ", ".join(
        [f"case when contains(txt, {S.q(p.lower())}) then {S.q('avoid: ' + p)} end" for p in C.avoid]
        + [f"case when rooms < {C.rooms_min} or rooms > {C.rooms_max} then {_N('rooms')} || ' rooms — out of range ({C.rooms_min}–{C.rooms_max})' end",
           f"case when not (area_sqm > {C.area_min} and area_sqm < {C.area_max}) then {_N('area_sqm')} || ' m² — out of range ({C.area_min}–{C.area_max} m², strict)' end",
           f"case when not (rent_eur > {C.rent_min} and rent_eur < {C.rent_max}) then cast(rent_eur as varchar) || '€ — outside budget {C.rent_min}–{C.rent_max}€' end",
           f"case when rent_eur + condo_fee_eur > {C.total_max} then 'total ' || cast(rent_eur + condo_fee_eur as varchar) || '€ > {C.total_max}€' end"]) + ")"},
]
ZONES = "concat_ws(', ', " + ", ".join(
    "case when " + " or ".join(f"contains(txt, {S.q(w.lower())})" for w in (z.name, *z.aliases)) + f" then {S.q(z.name)} end" for z in C.zones) + ")"
LANDMARK = "(" + " or ".join(f"contains(txt, {S.q(m)})" for m in C.landmarks) + ")"
FLAGS = f"concat_ws('; ', case when {S.has('txt', V.RISK_PAYMENT)} then 'suspicious payment' end, case when {S.has('txt', V.RISK_MESSENGER)} then 'messenger-only contact' end, case when rent_eur < 400 then 'anomalously low price' end)"


def rule_steps(proximity: str | None = None, meters: str | None = None) -> list[dict]:
    """Rule score, reasons, flags as SQL over the columns of a listing."""
    rooms_ok, area_ok = f"rooms between {C.rooms_min} and {C.rooms_max}", f"area_sqm > {C.area_min} and area_sqm < {C.area_max}"
    rent_ok, total_ok = f"rent_eur > {C.rent_min} and rent_eur < {C.rent_max}", f"rent_eur + condo_fee_eur <= {C.total_max}"
    near = "null"
    if proximity:
        near = f"'📍 ' || case when {meters} is not null then {S.distance_text(meters)} || ' from {C.reference_name} (' || {proximity} || '/10)' else 'proximity ' || {proximity} || '/10 ({C.reference_name})' end"
    bonus = f"coalesce(floor({proximity} / 10.0 * {C.proximity_bonus} + 0.5), 0)" if proximity else "0"
    flag_count = f"(case when {S.has('txt', V.RISK_PAYMENT)} then 1 else 0 end + case when {S.has('txt', V.RISK_MESSENGER)} then 1 else 0 end + case when rent_eur < 400 then 1 else 0 end)"
    return [
        {"txt": TEXT}, {"zones": ZONES, "flags": FLAGS, "n_flags": flag_count},
        {"points": f"""50 + case when rooms is null then 0 when {rooms_ok} then 15 else -20 end
            + case when area_sqm is null then 0 when {area_ok} then 15 else -15 end
            + case when rent_eur is null then 0 when {rent_ok} then 15 else -25 end
            + case when rent_eur + condo_fee_eur is null then 0 when {total_ok} then 5 else -15 end
            + case when zones <> '' then 25 else -{C.zone_miss_penalty} end + case when {LANDMARK} then 8 else 0 end
            + {bonus} - 10 * n_flags""",
         "reasons": f"""concat_ws('; ',
            case when {rooms_ok} then {_N('rooms')} || ' rooms — ok' when rooms is not null then {_N('rooms')} || ' rooms — out of range' end,
            case when {area_ok} then {_N('area_sqm')} || ' m² — ok' when area_sqm is not null then {_N('area_sqm')} || ' m² — out of range ({C.area_min}–{C.area_max} m²)' end,
            case when {rent_ok} then cast(rent_eur as varchar) || '€ rent — within budget' when rent_eur is not null then cast(rent_eur as varchar) || '€ — outside budget {C.rent_min}–{C.rent_max}€' end,
            case when {total_ok} then 'total ' || cast(rent_eur + condo_fee_eur as varchar) || '€ with spese — ok'
                 when rent_eur + condo_fee_eur > {C.total_max} then 'total ' || cast(rent_eur + condo_fee_eur as varchar) || '€ > {C.total_max}€'
                 when rent_eur is not null and condo_fee_eur is null then {S.q(V.FEE_MISSING_REASON)} end,
            case when zones <> '' then 'zone: ' || zones else {S.q(V.ZONE_MISS_REASON)} end,
            case when {LANDMARK} then 'near metro/landmark' end, {near})"""},
        {"rule": "cast(greatest(0, least(100, points)) as integer)", "risk": "case when n_flags > 0 then 'high' else 'none' end"},
    ]


def rule_column(c, proximity=None, meters=None):
    return rules.rule_score(C, c("_text"), c("rooms"), c("area_sqm"), c("rent_eur"), c("condo_fee_eur"), proximity, meters)


def _with_rule(rows):
    c = F.col
    rule = rule_column(c, (c("draft_id") % 11).cast("int"), F.when(c("draft_id") % 3 > 0, (c("draft_id") % 4000).cast("int")))
    return scoring.with_search_text(rows).withColumn("r", rule)


def _flat_rule(c):
    return {"score": c("r.score"), "reasons": F.array_join("r.reasons", "; "), "risk_level": c("r.risk_level"), "risk_reasons": F.array_join("r.risk_reasons", "; "), "risk_source": c("r.risk_source")}


projection("n14_rule_score", "drafts", ["draft_id"], _flat_rule,
           [{"prox": "cast(draft_id % 11 as integer)", "met": "case when draft_id % 3 > 0 then cast(draft_id % 4000 as integer) end"}, *rule_steps("prox", "met")],
           ["rule as score", "reasons", "risk as risk_level", "flags as risk_reasons", "case when risk = 'none' then 'none' else 'rules' end as risk_source"], prepare=_with_rule)
projection("n15_risk_flags", "drafts", ["draft_id"],
           lambda c: {"flags": F.array_join(rules.risk_flags(c("_text"), c("rent_eur")), "; ")},
           [{"txt": TEXT}, {"flags": FLAGS}], prepare=scoring.with_search_text)
projection("n16_proximity_bonus", "drafts", ["draft_id"], lambda c: {"bonus": rules.proximity_bonus(c("draft_id") % 11, 15).cast("int")},
           {"bonus": "cast(floor((draft_id % 11) / 10.0 * 15 + 0.5) as integer)"})
WR, WM = f"cast({C.rules_weight} as double)", f"cast({C.model_weight} as double)"


def blend_sql(rule: str, comp: str) -> str:
    once = f"floor({rule} * {WR} + 0.5)"
    return f"cast(greatest(0, least(100, case when {comp} is null then {once} else floor({once} * {WR} + {comp} * {WM} + 0.5) end)) as integer)"


projection("n17_blend", "drafts", ["draft_id"],
           lambda c: {"score": rules.blend(C, F.pmod(c("draft_id"), F.lit(101)).cast("int"), F.when(c("draft_id") % 4 > 0, (c("draft_id") * 7 % 101).cast("int")))},
           [{"r": "draft_id % 101", "m": "case when draft_id % 4 > 0 then draft_id * 7 % 101 end"}, {"score": blend_sql("r", "m")}])
projection("n18_risk_merge", "replies", ["draft_id"],
           lambda c: {"level": rules.merged_risk_level(F.when(c("draft_id") % 5 == 0, F.lit("high")).otherwise(F.lit("none")), replies.risk_level(replies.document(c("response")))),
                      "reasons": F.array_join(rules.merged_risk_reasons(F.array(F.lit("a")), replies.risk_level(replies.document(c("response"))), F.array(F.concat(F.lit("m"), (c("draft_id") % 3).cast("string")))), ";")},
           [{"rl": "json_extract_string(response, '$.riskLevel')"},
            {"level": "case when rl = 'high' or draft_id % 5 = 0 then 'high' else 'none' end", "reasons": "case when rl = 'high' then 'a;m' || cast(draft_id % 3 as varchar) else 'a' end"}])

# --- JSON and arrays ---------------------------------------------------------
projection("j1_criteria_scores", "replies", ["draft_id"],
           lambda c: {k: c(f"scores.{k}") for k in V.RATING_KEYS},
           [SCORES], [*[f"k_{k} as {k}" for k in V.REPLY_KEYS], "0 as proximityToReference"], prepare=SCORED)
projection("j2_reply_result", "replies", ["draft_id"],
           lambda c: {"composite": c("m_composite"), "summary": c("m_summary"), "risk_level": c("m_risk_level"), "n_reasons": F.when(c("m_usable"), F.size("m_risk_reasons")), "reasons": F.array_join("m_risk_reasons", ";")},
           [SCORES, {"ok": "draft_id % 7 > 1"}],
           [f"case when ok then cast({SUM} as integer) end as composite", "case when ok then trim(json_extract_string(response, '$.summary')) end as summary",
            "case when ok then coalesce(json_extract_string(response, '$.riskLevel'), 'none') end as risk_level", "case when ok then case when draft_id % 3 = 0 then 2 else 0 end end as n_reasons",
            "case when ok then case when draft_id % 3 = 0 then 'first;second' else '' end end as reasons"],
           prepare=lambda d: replies.with_result(d.withColumn("reply", F.when(F.col("draft_id") % 7 == 0, F.lit('{"note":1}')).when(F.col("draft_id") % 7 == 1, F.lit("{broken")).otherwise(F.col("response"))), C, "reply", "m_"))
projection("j3_with_proximity", "replies", ["draft_id"],
           lambda c: {"composite": replies.composite(replies.with_proximity(c("scores"), F.when(c("draft_id") % 3 > 0, c("draft_id") % 14)))},
           [SCORES, {"composite": f"cast({SUM} + case when draft_id % 3 > 0 then least(10, draft_id % 14) else 0 end as integer)"}], prepare=SCORED)
LABELS = {k: label for k, label, _ in C.rating_labels}


def scores_line(total: str, proximity: str) -> str:
    parts = " || ', ' || ".join(f"'{LABELS[k]} ' || cast(k_{k} as varchar) || '/10'" for k in V.REPLY_KEYS)
    return f"'🤖 AI (' || cast({total} as varchar) || '/100): ' || {parts} || ', Proximity ' || cast({proximity} as varchar) || '/10'"


projection("j4_scores_text", "replies", ["draft_id"], lambda c: {"line": replies.scores_text(C, c("scores"))},
           [SCORES, {"line": scores_line(f"({SUM})", "0")}], prepare=SCORED)


def _merged(c):
    old = F.when(c("draft_id") % 2 == 0, F.array(F.lit("https://a.it/"), c("canonical_url"))).otherwise(F.array().cast("array<string>"))
    new = F.when(c("draft_id") % 3 == 0, c("canonical_url")).otherwise(F.concat(F.lit("https://b.it/"), c("draft_key")))
    return {"urls": F.array_join(merged_alternates(old, c("canonical_url"), new), " ")}


projection("j5_alternate_urls", "drafts", ["draft_id"], _merged,
           {"urls": "concat_ws(' ', nullif(case when draft_id % 2 = 0 then 'https://a.it/ ' || canonical_url else '' end, ''), case when draft_id % 3 > 0 then case when draft_id % 2 = 0 then '' else canonical_url || ' ' end || 'https://b.it/' || draft_key end)"})
projection("j6_text_array", "drafts", ["draft_id"],
           lambda c: (lambda a: {"size": F.size(a), "joined": F.array_join(a, "|")})(tables.text_array(
               F.when(c("draft_id") % 4 == 0, F.lit("not json")).when(c("draft_id") % 4 == 1, F.lit('{"a":1}')).otherwise(
                   F.concat(F.lit('["'), c("title"), F.lit('",'), c("draft_id").cast("string"), F.lit("]"))))),
           [{"arr": "draft_id % 4 > 1"}], ["case when arr then 2 else 0 end as size", "case when arr then title || '|' || cast(draft_id as varchar) else '' end as joined"])
projection("j8_matched_zones", "drafts", ["draft_id"],
           lambda c: {"zones": F.array_join(rules.matched_zones(C, c("_text")), ", ")},
           [{"txt": TEXT}, {"zones": ZONES}], prepare=scoring.with_search_text)

# --- predicates --------------------------------------------------------------
BODY = "coalesce(nullif(html_body, ''), text_body)"
SALE = f"(not {S.has(f"{BODY} || ' ' || subject", V.RENT_ALERT)} and {S.has(f"{BODY} || ' ' || subject", V.SALE_ALERT)})"
projection("p1_sale_alert", "messages", ["message_id"],
           lambda c: {"sale": alerts.is_sale_alert(c("subject"), alerts.body(c("html_body"), c("text_body")))}, {"sale": SALE})
projection("p2_monthly_hint", "posts", ["post_id"], lambda c: {"hint": amounts.has_monthly_hint(c("message"))}, {"hint": S.has("message", V.RENT_HINT)})
projection("p3_keeps_alert_draft", "drafts", ["draft_id"],
           lambda c: {"kept": alerts.keeps_draft(F.element_at(F.array(F.lit("a@idealista.it"), F.lit("b@casa.it"), F.lit("c@x.org")), (c("draft_id") % 3 + 1).cast("int")), c("title"), F.when(c("draft_id") % 2 == 0, c("location_hint")), F.when(c("draft_id") % 5 > 0, F.concat(c("raw_snippet"), F.lit(" 700 €/mese"))), c("rent_eur") * 3, F.when(c("draft_id") % 7 > 0, c("area_sqm")), c("draft_id") % 11 == 0)},
           [{"r": "rent_eur * 3", "h": "case when draft_id % 2 = 0 then location_hint end", "a": "case when draft_id % 7 > 0 then area_sqm end", "hint": "draft_id % 5 > 0"},
            {"kept": f"""coalesce(case when draft_id % 11 = 0 then false when draft_id % 3 = 0 then r is not null and hint
               when draft_id % 3 = 1 then r is not null and {S.meaningful('title')} and (a is not null or trim(coalesce(h, '')) <> '')
               else r is null or r <= 1500 or hint end, false)"""}])
projection("p4_student_post", "posts", ["post_id"], lambda c: {"student": posts.is_student(c("message"))}, {"student": S.has(S.collapse("message"), *V.STUDENT_MARKERS)})
CLEAN = [{"col0": S.collapse("message")}, *S.cut_before("col0", "cleaned", V.FEED_UI_MARKERS, 20)]
RENTAL = S.all_of("length(cleaned) >= 20", f"not ({S.has('cleaned', *V.SALE_MARKERS)} and not {S.has('cleaned', V.AFFITT)})", S.has("cleaned", *V.RENT_MARKERS))
TALK = S.all_of(S.has("cleaned", *V.CONVERSATION_MARKERS), f"not {S.has('cleaned', V.EXPLICIT_RENT)}", f"not {S.has('cleaned', V.AFFITT)}")
projection("p5_rental_post", "posts", ["post_id"], lambda c: {"rental": posts.looks_like_rental(c("clean_text"))}, [*CLEAN, {"rental": RENTAL}], prepare=CLEANED)
projection("p6_feed_noise", "posts", ["post_id"], lambda c: {"noise": posts.is_noise(c("message"))}, {"noise": S.has(S.collapse("message"), *V.FEED_UI_MARKERS)})
projection("p7_conversation", "posts", ["post_id"], lambda c: {"talk": posts.is_conversation(c("clean_text")), "priced": posts.names_price(c("message"))},
           [*CLEAN, {"talk": TALK, "priced": S.has("message", V.EXPLICIT_RENT)}], prepare=CLEANED)


def _gate_ready(rows):
    rows = rows.withColumn("gate", posts.clean(posts.gate_text(F.col("message"), F.lit("Annuncio"), null())))
    return amounts.with_rent(rows, "message", "r")


def _gated(c):
    url = F.when(c("post_id") % 2 == 0, c("permalink")).otherwise(F.lit("https://www.idealista.it/immobile/1/"))
    return {"kept": posts.keeps_draft(c("gate"), url, c("r"), amounts.rooms(c("message")), F.when(c("post_id") % 3 == 0, amounts.area(c("message"))), posts.place_hint(c("message")))}


projection("p8_keeps_post_draft", "posts", ["post_id"], _gated,
           [{"col0": S.collapse("message || ' Annuncio '")}, *S.cut_before("col0", "cleaned", V.FEED_UI_MARKERS, 20),
            *S.rent("message", "r"),
            {"rm": S.rooms("message"), "ar": f"case when post_id % 3 = 0 then {S.area('message')} end", "hint": f"left({S.strip(S.group('message', V.POST_PLACE, 0))}, 120)", "priced": S.has("cleaned", V.EXPLICIT_RENT)},
            {"kept": S.all_of(f"not {S.has('cleaned', *V.STUDENT_MARKERS)}", f"not {S.has('cleaned', *V.FEED_UI_MARKERS)}", f"not ({TALK})", RENTAL,
                              f"not (coalesce(r > 1500, false) and not {S.has('cleaned', V.RENT_HINT)})",
                              "post_id % 2 = 1 or ((coalesce(r between 200 and 1500, false) or priced) and (priced or (r is not null and (rm is not null or ar is not null or hint is not null))))")}], prepare=_gate_ready)
_TITLE_CLEAN = [{"name": "coalesce(message, '')"}, {"col0": S.collapse("name")}, *S.cut_before("col0", "cleaned", V.FEED_UI_MARKERS, 20)]
projection("p9_post_digest_gate", "posts", ["post_id"],
           lambda c: {"ready": posts.digest_ready(c("message"), c("clean_text"), c("r"), F.when(c("post_id") % 3 == 0, amounts.area(c("message"))), null().cast("double"), posts.place_hint(c("message")))},
           [*_TITLE_CLEAN, *S.rent("message", "r"), {"ar": f"case when post_id % 3 = 0 then {S.area('message')} end", "hint": f"left({S.strip(S.group('message', V.POST_PLACE, 0))}, 120)"},
            {"ready": S.all_of(f"not {S.has(S.collapse('name'), *V.FEED_UI_MARKERS)}", f"not ({TALK})", "coalesce(r >= 200, false)", "ar is not null or trim(coalesce(hint, '')) <> ''", "length(trim(name)) >= 15")}], prepare=lambda d: amounts.with_rent(CLEANED(d), "message", "r"))


def _fails(c):
    return rules.hard_failures(C, c("_text"), c("rooms"), c("area_sqm"), c("rent_eur"), c("condo_fee_eur"))


projection("p10_hard_failures", "drafts", ["draft_id"], lambda c: {"failures": F.array_join(_fails(c), "; ")}, HARD, ["fails as failures"], prepare=scoring.with_search_text)
projection("p11_meets_hard", "drafts", ["draft_id"], lambda c: {"ok": F.size(_fails(c)) == 0}, HARD, ["fails = '' as ok"], prepare=scoring.with_search_text)
projection("p12_sender_class", "messages", ["message_id"],
           lambda c: {"immobiliare": alerts.from_immobiliare(c("from_address"), c("subject")), "idealista": alerts.from_idealista(c("from_address")), "casa": alerts.from_casa(c("from_address"))},
           {"immobiliare": "contains(lower(from_address), 'immobiliare.it') or contains(lower(subject), 'listings for your search') or contains(lower(subject), 'nuovi annunci')",
            "idealista": "contains(lower(from_address), 'idealista')", "casa": "contains(lower(from_address), 'casa.it')"})
projection("p13_listing_page", "drafts", ["draft_id"],
           lambda c: {"own": urls.is_listing_page(c("canonical_url")), "tracked": urls.is_listing_page(F.replace(c("canonical_url"), F.lit("www."), F.lit("click."))), "link": urls.is_listing_page(c("listing_url"))},
           {"own": S.listing_page("canonical_url"), "tracked": S.listing_page("replace(canonical_url, 'www.', 'click.')"), "link": S.listing_page("listing_url")})
projection("p14_anchor_text", "drafts", ["draft_id"],
           lambda c: {"immobiliare": alerts.immobiliare_anchor(c("title")), "idealista": alerts.idealista_anchor(c("title")), "footer": alerts.idealista_anchor(F.lit("Vedi 12 foto"))},
           [{"t": S.collapse("title")}, {"immobiliare": S.all_of("length(t) >= 15", f"not {S.has('t', V.FOOTER_LINK)}", S.has("t", V.IMMOBILIARE_ANCHOR)),
            "idealista": S.all_of("length(t) >= 12", f"not {S.has('t', V.FOOTER_LINK)}", f"not {S.has('t', V.IDEALISTA_SKIP)}", S.has("t", V.IDEALISTA_ANCHOR)), "footer": "false"}])
_SOME_TITLE = "case post_id % 5 when 0 then 'Listing' when 1 then 'Casa 2' when 2 then concat('Vedi ', message) else message end"
projection("p15_meaningful_title", "posts", ["post_id"],
           lambda c: {"meaningful": alerts.is_meaningful_title(F.expr(_SOME_TITLE)), "call": alerts.is_call_to_action(F.concat(F.lit("Vedi "), (c("post_id") % 4).cast("string"), F.when(c("post_id") % 2 == 0, F.lit(" foto")).otherwise(F.lit(" piani"))))},
           [{"t": _SOME_TITLE}, {"meaningful": S.meaningful("t"), "call": "post_id % 2 = 0"}])
projection("p17_may_send", "listings", ["id"],
           lambda c: {"send": digest.may_send(c("sent_at"), c("price_changed_at"), c("dismissed_at"))},
           {"send": "dismissed_at is null and (sent_at is null or coalesce(sent_at < price_changed_at, false))"})
projection("p19_near_landmark", "drafts", ["draft_id"],
           lambda c: {"near": rules.near_landmark(C, c("_text"))}, [{"txt": TEXT}, {"near": LANDMARK}], prepare=scoring.with_search_text)
projection("d3_time_texts", "listings", ["id"],
           lambda c: {"day": F.date_format(c("last_seen_at"), "dd/MM/yyyy"), "plain": tables.plain_time(c("sent_at")), "iso": tables.iso(c("last_seen_at"))},
           {"day": "strftime(last_seen_at, '%d/%m/%Y')", "plain": "coalesce(strftime(sent_at, '%Y-%m-%d %H:%M:%S'), '—')", "iso": "strftime(last_seen_at, '%Y-%m-%dT%H:%M:%S.000Z')"})
projection("d1_cutoffs", "listings", ["id"],
           lambda c: (lambda s: {"cutoff": F.date_format(s, "yyyy-MM-dd HH:mm:ss"), "epoch": F.unix_seconds(s)})(c("last_seen_at") - F.make_interval(hours=F.lit(26))),
           [{"s": "last_seen_at - interval '26' hour"}, {"cutoff": "strftime(s, '%Y-%m-%d %H:%M:%S')", "epoch": "cast(epoch(s) as bigint)"}])
projection("d2_mail_date", "listings", ["id"],
           lambda c: {"parsed": F.date_format(landing.mail_date(F.date_format(c("last_seen_at"), "EEE, d MMM yyyy HH:mm:ss '+0200'")), "yyyy-MM-dd HH:mm:ss")},
           {"parsed": "strftime(last_seen_at - interval '2' hour, '%Y-%m-%d %H:%M:%S')"})
projection("t37_digest_header", "listings", ["id"],
           lambda c: {"header": cards.header(c("last_seen_at"), c("n"), c("n") + 1, c("n") % 10, c("n") % 3, F.when(c("n") % 5 == 0, cards.queued_note(c("n") % 10 + c("n") % 3, 2500)).otherwise(cards.deferred_note(c("n") % 4)))},
           {"header": "'📅 ' || strftime(last_seen_at, '%d/%m/%Y') || chr(10) || 'New: ' || n || ' · email duplicates skipped: ' || (n + 1) || chr(10) || 'Top ' || (n % 10) || case when n % 3 > 0 then ' + ' || (n % 3) || ' suspicious' else '' end || case when n % 5 = 0 then chr(10) || '📬 ' || (n % 10 + n % 3) || ' cards queued in BullMQ (staggered 2500 ms)' when n % 4 > 0 then chr(10) || '⏳ ' || (n % 4) || ' more in queue — next pipeline run' else '' end"})
