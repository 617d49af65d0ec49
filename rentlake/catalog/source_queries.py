"""Sources, sinks and row generators."""

from __future__ import annotations

from pyspark.sql import Observation
from pyspark.sql import functions as F

from rentlake import fixed_values as V
from rentlake.catalog import sqlkit as S
from rentlake.catalog.registry import ORACLES, oracle, query
from rentlake.catalog.views import table, view
from rentlake.functions import alerts, posts, urls
from rentlake.operators import anchors, feed, mail, scoring, tables
from rentlake.plans import front
from rentlake.session import fresh_folder
from rentlake.sources import landing
from rentlake.sources.store import Store

AS_OF = "2024-03-03 00:00:00"
DRAFT_KEEP = ("message_id", *mail.DRAFT_COLUMNS)


# --- sources -----------------------------------------------------------------
@query("s1_messages_since", oracle(
    f"select message_id, subject from messages where received_at >= timestamp '{AS_OF}' - interval '26' hour", "messages"))
def s1(spark, sf):
    return landing.since(view(spark, sf, "messages"), "received_at", F.lit(AS_OF).cast("timestamp"), 26).select("message_id", "subject")


@query("s1_landed_by_day", ORACLES["s1_messages_since"])
def s1_days(spark, sf):
    """The same lookback on a landing laid out by day of receipt, landed in two versions."""
    rows, store = view(spark, sf, "messages").select("message_id", "subject", "received_at"), Store(spark, fresh_folder(spark, "s1"))
    for version in (1, 2):
        landing.land(store, "messages", version, rows.where(F.col("message_id") % 2 == version - 1), "received_at")
    return landing.landed_since(store, "messages", "message_id bigint, subject string, received_at timestamp", "received_at", AS_OF, 26).select("message_id", "subject")


@query("s2_mime_bodies", """select page_id as message_id, html || '<p>ù</p>' as html_body, url as text_body from pages""")
def s2(spark, sf):
    pages = table(spark, sf, "pages")

    def part(path, mime, text):
        data = F.regexp_replace(F.translate(F.base64(F.encode(text, "UTF-8")), "+/", "-_"), "=+$", "")
        return pages.select(F.col("page_id").alias("message_id"), F.array(*map(F.lit, path)).alias("path"), F.lit(mime).alias("mime_type"), data.alias("data"))

    parts = (
        part([0, 2], "text/html", F.lit("<p>ù</p>")).unionByName(part([0, 1], "text/html", F.col("html")))
        .unionByName(part([1], "text/plain", F.col("url"))).unionByName(part([2], "image/png", F.col("url")))
    )
    return landing.bodies(parts).select("message_id", "html_body", "text_body")


@query("s3_header_lookup", """select page_id as message_id, url as subject, case when page_id % 3 = 0 then 'first' else '' end as sender, '' as missing from pages""")
def s3(spark, sf):
    def item(name, value):
        return F.struct(F.lit(name).alias("name"), value.alias("value"))

    both = F.array(item("SUBJECT", F.col("url")), item("From", F.lit("first")), item("from", F.lit("second")))
    headers = F.when(F.col("page_id") % 3 == 0, both).otherwise(F.array(item("subject", F.col("url"))))
    return table(spark, sf, "pages").withColumn("headers", headers).select(
        F.col("page_id").alias("message_id"), landing.header(F.col("headers"), "Subject").alias("subject"),
        landing.header(F.col("headers"), "from").alias("sender"), landing.header(F.col("headers"), "date").alias("missing"))


@query("s4_parse_input", """select page_id as message_id, case when page_id % 3 = 0 or html = '' then url else html end as body from pages""")
def s4(spark, sf):
    html = F.when(F.col("page_id") % 3 == 0, F.lit("")).otherwise(F.col("html"))
    return table(spark, sf, "pages").select(F.col("page_id").alias("message_id"), alerts.body(html, F.col("url")).alias("body"))


@query("s5_posts_across_groups", oracle(
    """, seen as (select post_id, group_id, message, post_id % 7 as nth, posted_at - post_id % 50 * interval '1' hour as posted_at from posts
       union all select post_id, 'other' as group_id, '' as message, 3 as nth, posted_at - post_id % 50 * interval '1' hour as posted_at from posts where post_id % 2 = 0),
     firsts as (select *, row_number() over (partition by post_id order by nth, group_id) as rn from seen)
     select post_id, group_id, message from firsts where rn = 1 and not (posted_at < timestamp '2024-02-29 12:00:00' and message = '')""", "posts"))
def s5(spark, sf):
    p = view(spark, sf, "posts").withColumn("posted_at", F.expr("posted_at - post_id % 50 * interval '1' hour"))
    a = p.select("post_id", (F.col("post_id") % 7).alias("nth"), "group_id", "message", "posted_at")
    b = p.where("post_id % 2 = 0").select("post_id", F.lit(3).cast("bigint").alias("nth"), F.lit("other").alias("group_id"), F.lit("").alias("message"), "posted_at")
    return feed.once_across_groups(a.unionByName(b), "nth", F.lit("2024-02-29 12:00:00").cast("timestamp")).select("post_id", "group_id", "message")


@query("s7_post_ledger", oracle(
    """select post_id, left(message, 500) as message, cast(case when contains(message, 'https://www.idealista.it') then 1 else 0 end as integer) as listings_found from posts""", "posts"))
def s7(spark, sf):
    p = view(spark, sf, "posts")
    kept = p.where(F.contains("message", F.lit("https://www.idealista.it"))).select("post_id")
    return tables.post_ledger(p, kept, AS_OF).select("post_id", "message", "listings_found")


_S9 = """select '{}' as id, '{}' as status, cast({} as integer) as messages_processed, cast({} as integer) as listings_parsed, cast({} as integer) as listings_new, '{}' as error_message, {} as finished"""


@query("s9_run_metrics", oracle(" union all ".join([
    _S9.format("r1", "completed", "(select count(*) from messages)", "(select count(*) from drafts)", "(select count(distinct canonical_url) from drafts)", "", "true"),
    _S9.format("r2", "failed", "(select count(*) from messages)", 0, 0, "no such table", "true"), _S9.format("r3", "running", 0, 0, 0, "", "false")]), "messages", "drafts"))
def s9(spark, sf):
    """A run that ended, one that failed on the way and one that still runs."""
    seen, parsed = Observation("messages"), Observation("drafts")
    view(spark, sf, "messages").observe(seen, F.count(F.lit(1)).alias("n")).write.format("noop").mode("overwrite").save()
    d = view(spark, sf, "drafts").observe(parsed, F.count(F.lit(1)).alias("n"))
    new = d.select("canonical_url").distinct().count()
    store = Store(spark, fresh_folder(spark, "runs"))
    counters = {"messages_processed": seen.get["n"], "listings_parsed": parsed.get["n"], "listings_new": new}
    for version in (1, 2, 3):
        store.write("runs", version, tables.run_row(spark, f"r{version}", AS_OF, None, {}))
    store.write("runs", 1, tables.run_row(spark, "r1", AS_OF, AS_OF, counters))
    store.write("runs", 2, tables.run_row(spark, "r2", AS_OF, AS_OF, {"messages_processed": seen.get["n"]}, "no such table"))
    schema = "id string, started_at timestamp, finished_at timestamp, status string, messages_processed int, listings_parsed int, listings_new int, error_message string"
    return store.read_all("runs", schema).select(
        "id", "status", "messages_processed", "listings_parsed", "listings_new", F.coalesce("error_message", F.lit("")).alias("error_message"), F.col("finished_at").isNotNull().alias("finished"))


def stored_listings(spark, sf):
    """The listing view with the columns it lacks."""
    rows = view(spark, sf, "listings")
    extra = {"address_raw": "string", "floor": "int", "has_lift": "boolean", "saved_at": "timestamp", "sent_message_id": "string"}
    return rows.select("*", *[F.lit(None).cast(t).alias(n) for n, t in extra.items()])


def stored_scores(spark, sf):
    one = [F.when(F.col(c).isNotNull(), F.array(c)).otherwise(F.array().cast("array<string>")) for c in ("reason", "risk_reason")]
    return view(spark, sf, "scores").select(
        "id", "listing_id", "score", one[0].alias("reasons"), "summary", "risk_level", one[1].alias("risk_reasons"), "risk_source", "model", "scored_at")


LATEST = "latest as (select * from (select *, row_number() over (partition by listing_id order by scored_at desc, id desc) as rn from scores) where rn = 1)"


@query("s10_export", oracle(
    f""", {LATEST} select l.id, coalesce(l.listing_url, l.canonical_url) as url, strftime(first_seen_at, '%Y-%m-%dT%H:%M:%S.000Z') as first_seen,
       strftime(sent_at, '%Y-%m-%dT%H:%M:%S.000Z') as sent, left(raw_snippet, 200) as snippet, s.score, s.risk_level as risk, s.reason as reasons,
       strftime(s.scored_at, '%Y-%m-%dT%H:%M:%S.000Z') as scored from listings l left join latest s on l.id = s.listing_id""", "listings", "scores"))
def s10(spark, sf):
    out = tables.export_view(scoring.with_latest(stored_listings(spark, sf), stored_scores(spark, sf)))
    k = F.col
    return out.select("id", "url", k("firstSeenAt").alias("first_seen"), k("sentAt").alias("sent"), k("rawSnippet").alias("snippet"),
                      "latestScore.score", k("latestScore.riskLevel").alias("risk"), F.array_join("latestScore.reasons", ";").alias("reasons"), k("latestScore.scoredAt").alias("scored"))


@query("s10_export_files", oracle(
    f"""select 'messages' as section, cast(message_id as varchar) as id, subject as a, strftime(received_at, '%Y-%m-%dT%H:%M:%S.000Z') as b, cast(length(from_address) as bigint) as n from messages
       union all select 'summary', t, null, null, c from (select 'listings' as t, (select count(*) from listings) as c union all select 'listing_scores', (select count(*) from scores)
         union all select 'processed_messages', (select count(*) from messages) union all select 'runs', (select count(*) from orders))
       union all (select 'runs', cast(o_orderkey as varchar), case when o_orderkey % 3 = 0 then 'failed' else 'completed' end, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.000Z'), o_custkey from orders order by o_orderdate desc, cast(o_orderkey as varchar) limit 20)
       union all select 'listings', id, left(raw_snippet, 200), strftime(last_seen_at, '%Y-%m-%dT%H:%M:%S.000Z'), n from listings""", "listings", "scores", "messages"))
def s10_files(spark, sf):
    """The whole export, written as JSON and read again."""
    k, path = F.col, fresh_folder(spark, "export")
    ledger = view(spark, sf, "messages").withColumns({"processed_at": F.lit(AS_OF).cast("timestamp"), "listings_found": F.length("from_address")})
    none = F.lit(None).cast("int")
    runs = table(spark, sf, "orders").select(
        k("o_orderkey").cast("string").alias("id"), k("o_orderdate").cast("timestamp").alias("started_at"), F.lit(None).cast("timestamp").alias("finished_at"),
        F.when(k("o_orderkey") % 3 == 0, "failed").otherwise("completed").alias("status"), k("o_custkey").alias("messages_processed"),
        *[none.alias(n) for n in ("listings_parsed", "listings_new", "duplicates_skipped", "listings_scored", "cards_sent")], F.lit(None).cast("string").alias("error_message"))
    scores = stored_scores(spark, sf)
    rows = stored_listings(spark, sf).withColumn("floor", k("n"))
    tables.export(path, scoring.with_latest(rows, scores), scores, ledger, runs)

    def part(name, fields, *columns):
        return spark.read.schema(fields).json(f"{path}/{name}").select(F.lit(name).alias("section"), *[c.alias(n) for c, n in zip(columns, ("id", "a", "b", "n"))])

    none = F.lit(None).cast("string")
    return (
        part("messages", "message_id string, subject string, receivedAt string, listingsFound bigint", k("message_id"), k("subject"), k("receivedAt"), k("listingsFound"))
        .unionByName(part("summary", "table_name string, n bigint", k("table_name"), none, none, k("n")))
        .unionByName(part("runs", "id string, status string, startedAt string, messagesProcessed bigint", k("id"), k("status"), k("startedAt"), k("messagesProcessed")))
        .unionByName(part("listings", "id string, rawSnippet string, lastSeenAt string, floor bigint", k("id"), k("rawSnippet"), k("lastSeenAt"), k("floor")))
    )


@query("s12_front_messages", oracle(
    f"""select cast(page_id as varchar) as message_id, url as subject, 'a' || page_id || '@x.it' as from_address, html as html_body, 'testo' as text_body, strftime(sent, '%Y-%m-%d %H:%M:%S') as received_at
      from (select *, timestamp '{AS_OF}' - page_id % 60 * interval '1' hour as sent from pages) where sent >= timestamp '{AS_OF}' - interval '26' hour"""
    , "messages"))
def s12(spark, sf):
    """Landed parts and headers to the messages of the lookback."""
    k, pages = F.col, table(spark, sf, "pages").withColumn("message_id", F.col("page_id").cast("string"))
    coded = lambda text: F.regexp_replace(F.translate(F.base64(F.encode(text, "UTF-8")), "+/", "-_"), "=+$", "")
    part = lambda at, mime, text: pages.select("message_id", F.array(F.lit(at)).alias("path"), F.lit(mime).alias("mime_type"), coded(text).alias("data"))
    item = lambda name, value: F.struct(F.lit(name).alias("name"), value.alias("value"))
    sent = F.lit(AS_OF).cast("timestamp") - F.make_interval(hours=(k("page_id") % 60).cast("int"))
    headers = pages.select("message_id", F.array(
        item("Subject", k("url")), item("FROM", F.concat(F.lit("a"), k("message_id"), F.lit("@x.it"))), item("Date", F.date_format(sent, "EEE, d MMM yyyy HH:mm:ss '+0000'"))).alias("headers"))
    found = front.new_messages(part(0, "text/html", k("html")).unionByName(part(1, "text/plain", F.lit("testo"))), headers, AS_OF)
    return found.withColumn("received_at", F.date_format("received_at", "yyyy-MM-dd HH:mm:ss")).select("message_id", "subject", "from_address", "html_body", "text_body", "received_at")


@query("s11_stored_tables", oracle("select id, rent_eur, n + 1 as n from listings", "listings"))
def s11(spark, sf):
    store = Store(spark, fresh_folder(spark, "store"))
    rows = view(spark, sf, "listings").select("id", "rent_eur", "n")
    schema = "id string, rent_eur int, n int"
    store.write("listings", 1, rows)
    store.write("listings", 2, store.read("listings", schema, before=2).withColumn("n", F.col("n") + 1))
    return store.read("listings", schema)


# --- row generators ----------------------------------------------------------
@query("e0_anchors", oracle(f"""
  , m as (select page_id, {', '.join(f"regexp_extract_all(html, {S.q(anchors.ANCHOR)}, {n}) as g{n}" for n in (1, 2, 3, 4))} from spelled_pages),
  i as (select *, unnest(range(len(g1))) as pos from m)
  select page_id, cast(pos as integer) as pos, coalesce(g1[pos + 1], '') || coalesce(g2[pos + 1], '') || coalesce(g3[pos + 1], '') as href, {S.collapse("regexp_replace(g4[pos + 1], '<[^>]*>', ' ', 'g')")} as text from i""", "spelled_pages"))
def e0(spark, sf):
    return anchors.flat_anchors(view(spark, sf, "spelled_pages"), "page_id", "html")


_TD = "regexp_extract(html_body, '<td>(.*?)</td>', 1)"
_TDS, _LINKS = "regexp_extract_all(html_body, '<td>(.*?)</td>', 1)", "regexp_extract_all(html_body, '<a [^>]*>(.*?)</a>', 1)"
# The anchor that counts: the first, or the second where its title is longer.
_NTH = "case when message_id % 8 = 5 then 2 else 1 end"


def _plain(x: str) -> str:
    return S.collapse(f"regexp_replace({x}, '<[^>]*>', '', 'g')")


_MESSAGE_BASE = [{"td": _plain(f"{_TDS}[{_NTH}]"), "link": S.collapse(f"{_LINKS}[{_NTH}]"), "href": "regexp_extract(html_body, 'href=\"([^\"]*)\"', 1)"}]
_GENERIC = [
    *_MESSAGE_BASE, {"casa": "message_id % 4 = 0"}, *S.canonical("href", "canonical_url"),
    {"context": f"left({S.collapse("subject || ' ' || td || ' ' || link")}, 500)", "body": f"case when casa then {S.strip(S.group('subject', V.SUBJECT_ALERT))} end", "block": "left(td, 600)"},
    *S.rent("context", "r1"), *S.rent("block", "r2"), *S.rent("body", "r3"),
    {"parts": "list_transform(string_split(body, '|'), lambda p: trim(p))"},
    {"s_hint": "nullif(left(case when len(parts) >= 3 then array_to_string(parts[3:], ', ') else parts[-1] end, 120), '')"},
    {"rent_eur": "coalesce(r1, case when casa then r2 end, r3)", "area_sqm": f"coalesce({S.area('context')}, case when casa then {S.area('block')} end, {S.area('body')})",
     "rooms": f"coalesce({S.rooms('context')}, {S.rooms('block')})", "condo_fee_eur": S.fee("context"),
     "location_hint": "coalesce(s_hint, case when not casa then left(td, 120) end)", "title": "left(link, 200)", "raw_snippet": "left(context, 400)",
     "source": "case when casa then 'casa.it' else 'idealista.it' end", "listing_url": "cast(null as varchar)", "external_id": "cast(null as varchar)"},
]
_DRAFT_SELECT = f"select {', '.join(DRAFT_KEEP)} from {{from}}"


@query("e1_generic_drafts", oracle(_DRAFT_SELECT + " where message_id % 4 in (0, 3)", "messages", steps=_GENERIC))
def e1(spark, sf):
    return mail.generic_drafts(mail.anchors_of(view(spark, sf, "messages")).where("route = 'generic'")).select(*DRAFT_KEEP)


_IDEALISTA = [
    *_MESSAGE_BASE, {"external_id": S.group("href", V.IMMOBILE_ID), "block": "left(td, 600)"}, *S.rent("block", "r"),
    {"canonical_url": "'https://www.idealista.it/immobile/' || external_id || '/'", "source": "'idealista.it'", "title": "left(link, 200)",
     "location_hint": f"coalesce(left({S.strip(S.group('link', V.HINT_AFTER_IN))}, 120), left(link, 120))",
     "rent_eur": f"case when {S.has('block', V.RENT_HINT)} then r end", "condo_fee_eur": S.fee("block"), "area_sqm": S.area("block"),
     "rooms": f"coalesce({S.rooms('block')}, {S.room_words('link')}, {S.room_words('block')})", "raw_snippet": "left(block, 400)",
     "sale": f"not {S.has("html_body || ' ' || subject", V.RENT_ALERT)} and {S.has("html_body || ' ' || subject", V.SALE_ALERT)}"},
    {"listing_url": "canonical_url"},
]


@query("e2_idealista_drafts", oracle(_DRAFT_SELECT + " where message_id % 4 = 1 and not sale", "messages", steps=_IDEALISTA))
def e2(spark, sf):
    return mail.idealista_drafts(mail.anchors_of(view(spark, sf, "messages")).where("route = 'idealista'")).select(*DRAFT_KEEP)


_CLICKS = [
    {"block": f"left({S.collapse(f"regexp_replace({_TD}, '<[^>]*>', '', 'g')")}, 500)", "link": S.collapse("regexp_extract(html_body, '<a [^>]*>(.*?)</a>', 1)"),
     "href": "regexp_extract(html_body, 'href=\"([^\"]*)\"', 1)"},
    *S.rent("block", "rent_eur"), {"area_sqm": S.area("block")},
    {"canonical_url": f"'https://www.immobiliare.it/annunci/alert-' || left(sha256(lower(link) || '|' || coalesce(cast(rent_eur as varchar), '') || '|' || coalesce({S.num('area_sqm')}, '')), 20) || '/'",
     "listing_url": "case when starts_with(href, 'http') then href else 'https://' || href end", "source": "'immobiliare.it'",
     "external_id": "left(regexp_extract(href, '/f/a/([^/~]+)', 1), 12)", "title": "left(link, 200)",
     "location_hint": f"left({S.group('link', V.HINT_AFTER_TYPE)}, 120)", "condo_fee_eur": S.fee("block"),
     "rooms": f"coalesce({S.rooms('block')}, {S.rooms('link')}, try_cast({S.group('link', V.ROOMS_TITLE_PREFIX)} as double))", "raw_snippet": "left(block, 400)"},
]


@query("e3_immobiliare_drafts", oracle(_DRAFT_SELECT, "clicks", steps=_CLICKS))
def e3(spark, sf):
    return mail.immobiliare_drafts(mail.anchors_of(view(spark, sf, "clicks"))).select(*DRAFT_KEEP)


@query("e4_anchor_blocks", oracle(
    f"""select message_id, {S.collapse(f"{_LINKS}[nth]")} as text, left({_plain(f"{_TDS}[least(nth, 2)]")}, 600) as block
      from messages, (select unnest([1, 2, 3]) as nth) where message_id % 4 in (0, 1, 3) and not (message_id % 4 = 1 and {S.has("html_body || ' ' || subject", V.SALE_ALERT)} and not {S.has("html_body || ' ' || subject", V.RENT_ALERT)})""", "messages"))
def e4(spark, sf):
    return mail.anchors_of(view(spark, sf, "messages")).select("message_id", "text", "block")


_URLS = f"list_transform(regexp_extract_all(message, {S.re2(V.POST_URL)}), lambda u: regexp_replace(u, '[.,;:!?)]+$', ''))"


@query("e5_post_urls", oracle(f"select post_id, unnest({_URLS}) as url from posts", "posts"))
def e5(spark, sf):
    return view(spark, sf, "posts").select("post_id", F.explode(urls.urls_in(F.col("message"))).alias("url"))


_FEED_KIND = "cast(split_part(page_id, '-', 1) as integer) + cast(split_part(page_id, '-', 2) as integer)"
_FEED = [
    {"kind": f"({_FEED_KIND}) % 4", "num": "cast(cast(split_part(page_id, '-', 1) as bigint) * 100 + cast(split_part(page_id, '-', 2) as bigint) as varchar)"},
    {"piece": """unnest(case when kind = 2 then [html[strpos(html, '>') + 1 : strpos(html, '</div> <div') - 1], regexp_extract(html, '</div> <div role="article">([\\s\\S]*)</div>\\s*$', 1)]
        when kind = 1 then [regexp_extract(html, '^<div role="article">([\\s\\S]*)</div>\\s*$', 1)] else [html] end)""", "nth": "unnest(case when kind = 2 then [0, 1] else [0] end)"},
    {"post_id": "case when nth = 1 then '9' || num else num end",
     "flat": f"left({S.collapse("replace(replace(regexp_replace(regexp_replace(piece, '(?i)<script[\\s\\S]*?</script>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '&amp;', '&'), '&#39;', '''')")}, 4000)"},
    *S.cut_before("flat", "cutted", V.FEED_CUT_MARKERS, 30),
    {"permalink": "'https://www.facebook.com/groups/' || group_id || '/posts/' || post_id || '/'", "message": "trim(cutted)"},
]


@query("e6_feed_posts", oracle("select page_id, post_id, permalink, message from {from}", "feed_pages", steps=_FEED))
def e6(spark, sf):
    return feed.posts_of_pages(view(spark, sf, "feed_pages")).select("page_id", "post_id", "permalink", "message")


_POST_DRAFT = [
    {"c0": S.collapse("message")}, *S.cut_before("c0", "txt", V.FEED_UI_MARKERS, 20),
    {"url": f"list_transform(regexp_extract_all(txt, {S.re2(V.POST_URL)}), lambda u: regexp_replace(u, '[.,;:!?)]+$', ''))[1]"},
    *S.canonical("url", "cu"),
    {"canonical_url": "coalesce(cu, permalink)", "listing_url": "coalesce(url, permalink)", "block": "case when url is not null then left(txt || ' ' || url, 500) else txt end"},
    *S.rent("block", "rent_eur"),
    {"line": "list_filter(list_transform(string_split_regex(txt, '[.\\n]'), lambda x: trim(x)), lambda x: length(x) > 10)[1]"},
    {"title": "coalesce(nullif(left(coalesce(line, left(txt, 120)), 200), ''), 'Facebook listing')", "location_hint": f"left({S.strip(S.group('block', V.POST_PLACE, 0))}, 120)",
     "condo_fee_eur": S.fee("block"), "area_sqm": S.area("block"), "rooms": S.rooms("block"), "raw_snippet": "left(block, 400)", "source": "'facebook.group'", "external_id": "cast(post_id as varchar)"},
]
_POST_KEEP = ("post_id", *mail.DRAFT_COLUMNS)


@query("s13_front_posts", oracle(
    """, seen as (select * from {from})
      select post_id, group_id, permalink, message from (select *, row_number() over (partition by post_id order by page_id, nth) as rn from seen) where rn = 1""", "feed_pages", steps=_FEED))
def s13(spark, sf):
    """Landed feed pages, the same page in two groups, to posts that come once."""
    pages = view(spark, sf, "feed_pages")
    again = pages.withColumn("page_id", F.concat("page_id", F.lit("-again")))
    return front.new_posts(pages.unionByName(again), "2024-03-01 12:00:00").select("post_id", "group_id", "permalink", "message")


@query("e7_post_drafts", oracle(f"select {', '.join(_POST_KEEP)} from {{from}} where url is not null or length(txt) >= 30", "posts", steps=_POST_DRAFT))
def e7(spark, sf):
    return feed.post_drafts(view(spark, sf, "posts")).select(*_POST_KEEP)


@query("e8_parser_route", oracle(
    "select message_id, case message_id % 4 when 2 then 'immobiliare' when 1 then 'idealista' else 'generic' end as route from messages", "messages"))
def e8(spark, sf):
    return mail.routed(view(spark, sf, "messages")).select("message_id", "route")


_IDS = "list_filter(string_split_regex(raw, '[,\\s]+'), lambda p: regexp_matches(p, '^\\d+$|^[a-zA-Z][a-zA-Z0-9_.-]{2,}$'))"


@query("e9_group_ids", f"""with r as (select page_id, page_id || ', ab c-d.e  ' || (page_id % 7) || ',7 -x my.slug,' || (page_id % 3) as raw from pages),
  i as (select page_id, {_IDS} as ids from r)
  select page_id, array_to_string(list_filter(ids, lambda x, i: list_position(ids, x) = i), ' ') as ids from i""")
def e9(spark, sf):
    n = F.col("page_id")
    raw = F.concat(n.cast("string"), F.lit(", ab c-d.e  "), (n % 7).cast("string"), F.lit(",7 -x my.slug,"), (n % 3).cast("string"))
    return table(spark, sf, "pages").select("page_id", F.array_join(posts.group_ids(raw), " ").alias("ids"))


@query("z1_union_of_feeds", oracle(
    """select 'message' as origin, count(*) as n from messages where message_id % 4 in (0, 3)
       union all select 'post' as origin, count(*) as n from posts where contains(message, 'https://')""", "messages", "posts"))
def z1(spark, sf):
    a = e1(spark, sf).withColumn("origin", F.lit("message"))
    b = feed.post_drafts(view(spark, sf, "posts").where(F.contains("message", F.lit("https://")))).withColumn("origin", F.lit("post"))
    return a.unionByName(b, allowMissingColumns=True).groupBy("origin").agg(F.count("*").alias("n"))


@query("z2_distinct_urls", oracle(f"select distinct unnest({_URLS}) as url from posts", "posts"))
def z2(spark, sf):
    return view(spark, sf, "posts").select(F.explode(F.array_distinct(urls.urls_in(F.col("message")))).alias("url")).distinct()
