"""Joins, aggregates, rankings, table upkeep, geo, scoring and digest jobs."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from rentlake import fixed_values as V
from rentlake.catalog import sqlkit as S
from rentlake.catalog.registry import ORACLES, oracle, query
from rentlake.catalog.scalar_queries import C, GEO_QUERY, HARD, HASH, LAT, LNG, PROMPT_STEPS, RENTAL, SALE, SCORES, SUM, TALK, TEXT, blend_sql, bucket_sql, rule_steps, scores_line
from rentlake.catalog.source_queries import _GENERIC, _IDEALISTA, _POST_DRAFT, AS_OF, LATEST, stored_listings, stored_scores
from rentlake.catalog.views import VIEWS, table, view, with_clause
from rentlake.functions import cards, keys, places, rules
from rentlake.operators import digest, duplicates, geocode, mentions, ranges, scoring, tables, upsert
from rentlake.operators.anchors import flat_anchors
from rentlake.operators.increments import Listings
from rentlake.operators.ledger import Ledger
from rentlake.operators.ordered import chunk, numbered, with_previous
from rentlake.operators.requests import Requests
from rentlake.plans import daily, ingest, rate
from rentlake.session import cut_lineage, fresh_folder, scratch
from rentlake.sources.store import Store

NOW = "2001-06-01 00:00:00"


# --- joins -------------------------------------------------------------------
@query("k1_unseen_messages", oracle("select message_id from messages where message_id % 3 <> 0", "messages"))
def k1(spark, sf):
    m = view(spark, sf, "messages")
    return tables.unseen(m, m.where("message_id % 3 = 0").select("message_id"), "message_id").select("message_id")


@query("k1_ledger_by_day", ORACLES["k1_unseen_messages"])
def k1_days(spark, sf):
    """The ledger by day of receipt; every third known id stands in it under another day."""
    rows = view(spark, sf, "messages").select("message_id", "received_at")
    ledger = Ledger(Store(spark, fresh_folder(spark, "k1")), "ledger", "message_id bigint, received_at timestamp", "message_id", "received_at", buckets=8)
    moved = F.when(F.col("message_id") % 9 == 0, F.col("received_at") - F.make_dt_interval(F.lit(40))).otherwise(F.col("received_at"))
    ledger.write(1, rows.where("message_id % 3 = 0").withColumn("received_at", moved))
    return ledger.unseen(rows).select("message_id")


KEYED = [{"street": S.street(S.blob("location_hint", "title", "raw_snippet"))},
         {"fingerprint": f"case when rent_eur >= 100 then street || '|r' || {S.whole('rooms')} || '|a' || {S.whole('area_sqm')} || '|€' || cast(rent_eur as varchar) end",
          "match_key": f"case when rent_eur >= 100 then street || '|r' || {S.whole('rooms')} || '|€' || cast(rent_eur as varchar) end", "hash": HASH}]


@query("k2_match_by_url", oracle("select d.draft_id, l.n from drafts d join listings l on d.canonical_url = l.canonical_url where l.n % 2 = 0", "drafts", "listings"))
def k2(spark, sf):
    known = view(spark, sf, "listings").where("n % 2 = 0").select("canonical_url", "n")
    return view(spark, sf, "drafts").join(known, "canonical_url").select("draft_id", "n")


@query("k3_match_by_fingerprint", oracle(
    """, ks as (select * from {from}), known as (select fingerprint, min(canonical_url) as target from ks where draft_id % 2 = 0 and fingerprint is not null group by fingerprint),
     urls as (select distinct canonical_url from ks where draft_id % 2 = 0)
     select draft_id, target from ks join known using (fingerprint) where draft_id % 2 = 1 and canonical_url not in (select canonical_url from urls)""",
    "drafts", steps=KEYED))
def k3(spark, sf):
    # Written once: both halves and the filters read the keys, which are dear to derive.
    d = cut_lineage(upsert.keyed(view(spark, sf, "drafts"), "draft_id").select("draft_id", "canonical_url", "fingerprint"))
    old, new = d.where("draft_id % 2 = 0"), d.where("draft_id % 2 = 1")
    known = old.where("fingerprint is not null").groupBy("fingerprint").agg(F.min("canonical_url").alias("target"))
    missed = new.where("fingerprint is not null").join(old.select("canonical_url").distinct(), "canonical_url", "left_anti")
    return missed.join(known, "fingerprint").select("draft_id", "target")


@query("k4_listing_latest_score", oracle(f", {LATEST} select l.id, s.score, s.risk_level from listings l left join latest s on l.id = s.listing_id", "listings", "scores"))
def k4(spark, sf):
    return scoring.with_latest(stored_listings(spark, sf), stored_scores(spark, sf)).select("id", F.col("s_score").alias("score"), F.col("s_risk_level").alias("risk_level"))


@query("k5_scored_listings", oracle("select id from listings l where exists (select 1 from scores s where s.listing_id = l.id and s.score % 5 = 0)", "listings", "scores"))
def k5(spark, sf):
    has = view(spark, sf, "scores").where("score % 5 = 0").select(F.col("listing_id").alias("id"))
    return view(spark, sf, "listings").join(has, "id", "left_semi").select("id")


PRIMARY = [{"street": S.street(S.blob("location_hint", "title", "raw_snippet"))},
           {"property_match_key": f"case when rent_eur >= 100 then street || '|r' || {S.whole('rooms')} || '|€' || cast(rent_eur as varchar) end"},
           {"first_id": "first_value(id) over (partition by property_match_key, dismissed_at is null order by first_seen_at, id)"},
           {"possible_duplicate_of_id": "case when dismissed_at is null and property_match_key is not null and first_id <> id then first_id end"}]


def linked_listings(spark, sf):
    rows = stored_listings(spark, sf).withColumn("possible_duplicate_of_id", F.lit(None).cast("string"))
    keyed = duplicates.backfill_match_keys(rows.withColumn("property_match_key", F.lit(None).cast("string")))
    # Stored, as the listing table is: linking reads it twice, and so do the jobs behind it.
    return cut_lineage(duplicates.reconcile(cut_lineage(keyed)))


@query("k6_with_primary", oracle(
    "select a.id, b.title as primary_title, b.canonical_url as primary_url from {from} a left join {from} b on a.possible_duplicate_of_id = b.id", "listings", steps=PRIMARY))
def k6(spark, sf):
    rows = digest.with_primary(linked_listings(spark, sf).drop("link_changed"))
    return rows.select("id", F.col("possible_duplicate_of.title").alias("primary_title"), F.col("possible_duplicate_of.canonical_url").alias("primary_url"))


GEO = [*GEO_QUERY, {"geo_key": S.fold("geo_query")}]
POINTS = """cache as (select query_key, lat, lng from (select *, row_number() over (partition by query_key order by lat, lng) as rn from gazetteer) where rn = 1),
 wide as (select query_key, lat, lng from (select *, row_number() over (partition by query_key order by lat, lng) as rn from places) where rn = 1)"""


# Streets the gazetteer knows, streets only the wider table knows, and unknown ones.
_TITLE2 = """case when n % 5 = 4 then concat('via nowhere ', cast(n as varchar(20)))
  when n % 2 = 0 then concat('via brandn', cast(n % 25 + 1 as varchar(20)), ' ', cast(n % 20 + 1 as varchar(20)))
  else concat('via brandn', cast((n + 30) % 60 + 1 as varchar(20)), ' ', cast((n + 30) % 20 + 1 as varchar(20))) end"""


def titled(rows):
    """Listings placed by a street title alone."""
    return rows.withColumn("title", F.expr(_TITLE2)).withColumn("location_hint", F.lit(None).cast("string"))


TITLED = [{"title2": _TITLE2}]
GEO_TITLED = [*TITLED, {"geo_query": "title2 || ', Torino, Italy'"}, {"geo_key": S.fold("geo_query")}]


@query("k7_geocode_cache", oracle(f", {POINTS} select l.id, c.lat, c.lng from {{from}} l left join cache c on l.geo_key = c.query_key", "listings", "gazetteer", "places", steps=GEO_TITLED))
def k7(spark, sf):
    keyed = geocode.with_query(titled(stored_listings(spark, sf)), C)
    points = geocode.one_point_per_key(view(spark, sf, "gazetteer"))
    return keyed.join(points, F.col("geo_key") == F.col("query_key"), "left").select("id", "lat", "lng")


@query("k8_fallback_places", oracle(
    f""", {POINTS} select l.id, case when c.query_key is not null then 'cache' when w.query_key is not null then 'gazetteer' end as found_source,
       coalesce(c.lat, w.lat) as lat, coalesce(c.lng, w.lng) as lng
     from {{from}} l left join cache c on l.geo_key = c.query_key left join wide w on l.geo_key = w.query_key""", "listings", "gazetteer", "places", steps=GEO_TITLED))
def k8(spark, sf):
    keyed = cut_lineage(geocode.with_query(titled(stored_listings(spark, sf)), C))
    empty = view(spark, sf, "places").limit(0)
    found = geocode.lookup(keyed, C, view(spark, sf, "gazetteer"), view(spark, sf, "places"), empty)
    return keyed.join(found, "geo_key", "left").select("id", "found_source", F.col("found_lat").alias("lat"), F.col("found_lng").alias("lng"))


_ZONE_ROWS = " union all ".join(f"select {i} as nth, {S.q(z.name)} as zone, {S.q(w.lower())} as word" for i, z in enumerate(C.zones) for w in dict.fromkeys((z.name.lower(), *z.aliases)))


@query("k9_zone_matches", oracle(f"""select zone, count(*) as n from (select distinct draft_key, zone from {{from}} join ({_ZONE_ROWS}) z on contains(txt, word)) group by zone""", "drafts", steps=[{"txt": TEXT}]))
def k9(spark, sf):
    rows = scoring.with_search_text(view(spark, sf, "drafts"))
    return rows.select(F.explode(rules.matched_zones(C, F.col("_text"))).alias("zone")).groupBy("zone").agg(F.count("*").alias("n"))


# Aliases by the hundred: whole street names, parts of words, numbers of two digits, the same word for several zones.
_ALIASES = """select distinct concat('zone ', cast(p_partkey%200 as varchar(20))) as zone,
 case p_partkey%4 when 0 then concat(replace(p_brand, '#', 'N'), ' ', cast(p_partkey%20+1 as varchar(20))) when 1 then concat('rand', substr(replace(p_brand, '#', 'n'), 6, 2))
  when 2 then cast(10+p_partkey%90 as varchar(20)) else concat('via ', lower(replace(p_brand, '#', 'n'))) end as word from part"""


@query("k9_zones_from_table", oracle(
    f"""select zone, count(*) as n, min(draft_id) as first_id, cast(sum(draft_id) as bigint) as ids
      from (select distinct draft_id, zone from (select draft_id, w.word from {{from}} join (select distinct lower(word) as word from ({_ALIASES}) p) w on contains(txt, w.word)) h
       join (select zone, lower(word) as word from ({_ALIASES}) p) z on h.word = z.word) m group by zone""", "drafts", steps=[{"txt": TEXT}]))
def k9_table(spark, sf):
    """Zones whose aliases are rows, found in all drafts."""
    table(spark, sf, "part").createOrReplaceTempView("part")
    aliases = spark.sql(_ALIASES)
    texts = scoring.with_search_text(view(spark, sf, "drafts")).select("draft_id", "_text")
    return mentions.zone_counts(texts, "draft_id", "_text", aliases)


# Three versions of the criteria with buckets of their own; the fourth has none.
_BUCKETS = "select s_suppkey%3 as version, s_suppkey*37%5000 as reach, s_suppkey%11 as points from supplier"


@query("k10_buckets_from_table", f"""with d as ({VIEWS['drafts'][1]}), v as (select draft_id, draft_id%4 as version, draft_id%6000-50 as m from d), b as ({_BUCKETS}),
  hit as (select u.version, u.m, arg_min(points, reach*1000+points) as points from (select distinct version, m from v) u join b on b.version = u.version and b.reach >= u.m group by u.version, u.m)
  select draft_id, cast(case when v.m < 0 then 5 else coalesce(points, 0) end as integer) as score from v left join hit on v.version = hit.version and v.m = hit.m""")
def k10_table(spark, sf):
    """Points by a table of buckets for each version of the criteria."""
    table(spark, sf, "supplier").createOrReplaceTempView("supplier")
    rows = view(spark, sf, "drafts").selectExpr("draft_id", "draft_id % 4 as version", "draft_id % 6000 - 50 as meters")
    return ranges.points(rows, "meters", spark.sql(_BUCKETS), "version").select("draft_id", "score")


@query("k10_distance_buckets", oracle(
    f"select {bucket_sql('m')} as score, count(*) as n from {{from}} group by 1", "drafts", steps=[{"m": "draft_id % 6000"}]))
def k10(spark, sf):
    score = places.distance_score((F.col("draft_id") % 6000).cast("int"), C.buckets, C.missing_score)
    return view(spark, sf, "drafts").groupBy(score.alias("score")).agg(F.count("*").alias("n"))


@query("k11_delete_scores", oracle("select id from scores s where not exists (select 1 from listings l where l.id = s.listing_id and l.n % 3 = 0)", "listings", "scores"))
def k11(spark, sf):
    return tables.scores_of_kept(view(spark, sf, "scores"), view(spark, sf, "listings").where("n % 3 = 0")).select("id")


# --- aggregates --------------------------------------------------------------
@query("a1_row_counts", oracle("select 'listings' as table_name, count(*) as n from listings union all select 'scores', count(*) from scores union all select 'messages', count(*) from messages", "listings", "scores", "messages"))
def a1(spark, sf):
    return tables.row_counts(**{n: view(spark, sf, n) for n in ("listings", "scores", "messages")})


@query("a2_match_keys", oracle("select distinct property_match_key from {from} where dismissed_at is null and property_match_key is not null", "listings", steps=PRIMARY))
def a2(spark, sf):
    return duplicates.distinct_match_keys(linked_listings(spark, sf))


def _ingested(spark, sf):
    """Messages and posts of which every fifth is known already, taken into an empty table."""
    m = view(spark, sf, "messages")
    p = view(spark, sf, "posts").withColumn("post_id", F.col("post_id").cast("string"))
    return ingest.ingest(
        upsert.empty_listings(spark), m, p, m.where("message_id % 5 = 0").select("message_id"), p.where("cast(post_id as bigint) % 5 = 0").select("post_id"), C, AS_OF,
    )


_STUDENT = S.has(S.collapse("message"), *V.STUDENT_MARKERS)
_LIMITS = [{"limit_text": TEXT}, {"fails": HARD[1]["fails"].replace("(txt,", "(limit_text,")}]
_MAIL_GATE = {"rental": f"""coalesce(not sale and case when message_id % 4 = 1 then rent_eur is not null and {S.has("raw_snippet || ' ' || coalesce(title, '')", V.RENT_HINT)}
    when message_id % 4 = 0 then rent_eur is not null and {S.meaningful('title')} and (area_sqm is not null or trim(coalesce(location_hint, '')) <> '')
    else coalesce(rent_eur <= 1500, true) or {S.has('raw_snippet', V.RENT_HINT)} end, false)"""}
_MAIL_OUT = "select message_id, canonical_url, received_at, rental, rental and fails = '' as kept from {from} where message_id % 5 > 0 and "
_POST_GATE = [
    {"gate0": S.collapse("message || ' ' || title || ' ' || raw_snippet")}, *S.cut_before("gate0", "cleaned", V.FEED_UI_MARKERS, 20), {"priced": S.has("cleaned", V.EXPLICIT_RENT)},
    {"rental": S.all_of(f"not {S.has('cleaned', *V.STUDENT_MARKERS)}", f"not {S.has('cleaned', *V.FEED_UI_MARKERS)}", f"not ({TALK})", RENTAL, f"not (coalesce(rent_eur > 1500, false) and not {S.has('cleaned', V.RENT_HINT)})",
                        "not contains(canonical_url, 'facebook.com') or ((coalesce(rent_eur between 200 and 1500, false) or priced) and (priced or (rent_eur is not null and (rooms is not null or area_sqm is not null or coalesce(location_hint, '') <> ''))))")},
]
# The drafts of these views meet by URL alone: each mail has a rent of its own, the posts name no street.
_OUTCOME = f"""mails as (select * from ({S.chain('', 'messages', [*_GENERIC, {'sale': SALE}, _MAIL_GATE, *_LIMITS], _MAIL_OUT + 'message_id % 4 in (0, 3)')})
    union all select * from ({S.chain('', 'messages', [*_IDEALISTA, _MAIL_GATE, *_LIMITS], _MAIL_OUT + 'message_id % 4 = 1 and not sale')})),
  told as ({S.chain('', 'posts', [*_POST_DRAFT, *_POST_GATE, *_LIMITS], "select post_id, canonical_url, posted_at, rental and fails = '' as kept from {from} where post_id % 5 > 0 and not " + _STUDENT + " and (url is not null or length(txt) >= 30)")}),
  merged as (select origin, row_number() over (partition by canonical_url order by moment, origin || '|' || nth || '|' || canonical_url) = 1 as is_new
    from (select 'message' as origin, canonical_url, received_at as moment, cast(message_id as varchar) as nth from mails where kept
      union all select 'post', canonical_url, posted_at, cast(post_id as varchar) from told where kept)),
  mail_counts as (select (select count(*) from messages where message_id % 5 > 0) as processed, (select count(*) from messages where message_id % 5 = 0) as skipped,
    count(*) filter (kept) as parsed, count(*) filter (not rental) as skipped_non_rent, count(*) filter (rental and not kept) as skipped_hard,
    (select count(*) from merged where origin = 'message' and is_new) as listings_new, (select count(*) from merged where origin = 'message' and not is_new) as duplicates from mails),
  post_counts as (select (select count(*) from posts where post_id % 5 > 0 and not {_STUDENT}) as processed, count(*) filter (kept) as parsed,
    (select count(*) from merged where origin = 'post' and is_new) as listings_new, (select count(*) from merged where origin = 'post' and not is_new) as duplicates,
    (select count(*) from posts where post_id % 5 > 0 and {_STUDENT}) as skipped_student, count(*) filter (not kept) as skipped_non_rent, (select count(*) from posts where post_id % 5 = 0) as skipped from told)"""
_MAIL_COUNTS = ("processed", "skipped", "parsed", "skipped_non_rent", "skipped_hard", "listings_new", "duplicates")
_POST_COUNTS = ("processed", "parsed", "listings_new", "duplicates", "skipped_student", "skipped_non_rent", "skipped")


@query("a3_message_counters", oracle(f", {_OUTCOME} select * from mail_counts", "messages", "posts"))
def a3(spark, sf):
    return _ingested(spark, sf).counts.select(*[F.col(f"messages_{n}").alias(n) for n in _MAIL_COUNTS])


@query("a4_post_counters", oracle(f", {_OUTCOME} select * from post_counts", "messages", "posts"))
def a4(spark, sf):
    return _ingested(spark, sf).counts.select(*[F.col(f"posts_{n}").alias(n) for n in _POST_COUNTS])


_FRESH = f"scored_at >= timestamp '{NOW}' - interval '7' day and last_seen_at <= scored_at"
_CLASS = f"""case when coalesce({_FRESH}, false) then 'cache' when fails <> '' then 'hard' else 'scored' end"""


@query("a5_scoring_counters", oracle(
    f""", {LATEST}, j as (select l.*, s.scored_at from {{from}} l left join latest s on l.id = s.listing_id where dismissed_at is null), k as (select {_CLASS} as outcome, sent_at from j)
     select count(*) as examined, count(*) filter (outcome = 'cache') as skipped_cache, count(*) filter (outcome = 'hard') as skipped_hard, count(*) filter (outcome = 'scored') as scored,
       count(*) filter (outcome = 'scored' and sent_at is not null) as geocoded, count(*) filter (outcome = 'scored' and sent_at is null) as geocode_missing from k""",
    "listings", "scores", steps=HARD))
def a5(spark, sf):
    rows = rate.classified(stored_listings(spark, sf), stored_scores(spark, sf), C, NOW)
    return scoring.counters(rows.withColumn("distance_to_ref_m", F.when(F.col("sent_at").isNotNull(), 1)))


@query("a6_found_per_message", oracle(
    "select p.page_id as message_id, cast(count(h) as integer) as listings_found from pages p left join (select page_id, unnest(regexp_extract_all(html, '(?is)<a\\b[^>]*?\\bhref=\"(/[^\"]*)\"', 1)) as h from pages) a on p.page_id = a.page_id group by 1", "messages"))
def a6(spark, sf):
    pages = table(spark, sf, "pages")
    found = flat_anchors(pages, "page_id", "html").where(F.startswith("href", F.lit("/"))).withColumnRenamed("page_id", "message_id")
    return tables.found_per(pages.select(F.col("page_id").alias("message_id")), found, "message_id")


@query("a7_run_totals", oracle(f", {_OUTCOME} select m.listings_new + p.listings_new as listings_new, m.duplicates + p.duplicates as duplicates from mail_counts m, post_counts p", "messages", "posts"))
def a7(spark, sf):
    return _ingested(spark, sf).counts.select("listings_new", "duplicates")


@query("a8_first_per_url", oracle("select canonical_url, draft_key from (select *, row_number() over (partition by canonical_url order by seen_at, draft_key) as rn from drafts) where rn = 1", "drafts"))
def a8(spark, sf):
    return view(spark, sf, "drafts").groupBy("canonical_url").agg(F.min(F.struct("seen_at", "draft_key")).alias("f")).select("canonical_url", "f.draft_key")


@query("a9_longest_title", oracle("select canonical_url, title from (select *, row_number() over (partition by canonical_url order by length(title) desc, seen_at, draft_key) as rn from drafts) where rn = 1", "drafts"))
def a9(spark, sf):
    rank = F.struct((-F.length("title")).alias("rank"), "seen_at", "draft_key")
    return view(spark, sf, "drafts").groupBy("canonical_url").agg(F.min_by("title", rank).alias("title"))


# --- rankings and digest -----------------------------------------------------
@query("w1_latest_score", oracle(f", {LATEST} select listing_id, id, score from latest", "scores"))
def w1(spark, sf):
    return scoring.latest_scores(stored_scores(spark, sf)).select("listing_id", "id", "score")


@query("w1_latest_by_runs", ORACLES["w1_latest_score"])
def w1_runs(spark, sf):
    """Newest scores kept up by three runs, the newest rows not in the last of them."""
    latest = scoring.LatestScores(Store(spark, fresh_folder(spark, "w1")), buckets=8, fold_every=2)
    rows = cut_lineage(stored_scores(spark, sf))
    for version in (1, 2, 3):
        latest.write(version, rows.where(F.pmod(F.xxhash64("id"), F.lit(3)) == version - 1))
    return latest.read().select("listing_id", "id", "score")


@query("a11_duplicate_skips", oracle("select count(*) as n from messages where received_at >= timestamp '2024-03-02 06:30:00' and message_id % 3 <> 0", "messages"))
def a11(spark, sf):
    """Drafts since a time that met a known listing, from a change feed laid out by day."""
    store = Store(spark, fresh_folder(spark, "a11"))
    store.write("changes", 1, view(spark, sf, "messages").selectExpr("received_at as seen_at", "message_id % 3 = 0 as is_new"), day="seen_at")
    return daily.duplicate_skips_since(store, "2024-03-02 06:30:00")


@query("t35_request_table", oracle(
    """select sha256(prompt) as request_id, cast(case when bool_or(draft_id % 2 = 0) then 1 else 2 end as integer) as asked_in, count(*) as listings from {from} group by prompt""",
    "drafts", steps=PROMPT_STEPS))
def t35_table(spark, sf):
    """Two runs ask about listings: half of them, then all; every text is asked once."""
    store = Store(spark, fresh_folder(spark, "t35"))
    requests, rows = Requests(store, buckets=8), view(spark, sf, "drafts").withColumn("id", F.col("draft_id").cast("string"))
    for version, part in ((1, rows.where("draft_id % 2 = 0")), (2, rows)):
        with scratch(spark):  # the questions of a run go when they are entered
            requests.ask(version, requests.questions(part, C), NOW)
    schema = "request_id string, prompt string"
    written = [spark.read.schema(schema).parquet(store.path("prompts", v)).select("request_id", F.lit(v).alias("asked_in")) for v in (1, 2)]
    listings = requests.asked.read().groupBy("request_id").agg(F.count("*").alias("listings"))
    return written[0].unionByName(written[1]).join(listings, "request_id", "left")


@query("w2_duplicate_primary", oracle("select id, possible_duplicate_of_id from {from}", "listings", steps=PRIMARY))
def w2(spark, sf):
    return linked_listings(spark, sf).select("id", "possible_duplicate_of_id")


DIGEST_VIEW = f"""{LATEST}, v as (select l.*, s.score, s.risk_level, s.reason, s.summary, s.risk_reason from listings l join latest s on l.id = s.listing_id where l.dismissed_at is null)"""


def digest_rows(spark, sf):
    rows = linked_listings(spark, sf).drop("link_changed").withColumn("distance_to_ref_m", (F.col("n") * 350).cast("int"))
    return digest.digest_view(rows, stored_scores(spark, sf))


@query("w3_digest_order", oracle(f", {DIGEST_VIEW} select id, score, risk_level from v order by risk_level = 'high', score desc, id limit 100", "listings", "scores"))
def w3(spark, sf):
    return digest.top(digest_rows(spark, sf), 100).select("id", "score", "risk_level")


_NO_SNIPPET = [dict(step) for step in HARD]
_NO_SNIPPET[0] = {"txt": f"lower({S.blob('cast(null as varchar)', 'location_hint', 'title')})"}
SKIP = f"""case when source = 'casa.it' and (rent_eur is null or not {S.meaningful('title')} or (area_sqm is null and trim(coalesce(location_hint, '')) = '')) then 'incomplete alert'
  when source = 'facebook.group' and not ({S.all_of(f"not {S.has(S.collapse('title'), *V.FEED_UI_MARKERS)}", f"not {S.has('title', *V.CONVERSATION_MARKERS)}", "coalesce(rent_eur >= 200, false)", "area_sqm is not null", "length(trim(title)) >= 15")}) then 'incomplete post'
  when fails <> '' then 'hard criteria' when score < 25 then 'low score' when rent_eur < 200 then 'low rent'
  when not (sent_at is null or coalesce(sent_at < price_changed_at, false)) then 'already sent' end"""
DIGEST_STEPS = [*PRIMARY, *_NO_SNIPPET]
JOINED = f"""{LATEST}, v as (select l.*, s.score, s.risk_level, s.reason, s.summary, s.risk_reason from {{from}} l join latest s on l.id = s.listing_id where l.dismissed_at is null),
  x as (select *, {SKIP} as skip_reason from v)"""


def digest_sql(body: str) -> str:
    return oracle(f", {JOINED} {body}", "listings", "scores", steps=DIGEST_STEPS)


@query("p16_skip_reasons", digest_sql("select id, skip_reason from x"))
def p16(spark, sf):
    return digest.with_skip_reason(digest_rows(spark, sf), C).select("id", "skip_reason")


@query("p18_score_freshness", oracle(f", {LATEST} select l.id, coalesce({_FRESH}, false) as fresh from listings l left join latest s on l.id = s.listing_id where dismissed_at is null", "listings", "scores"))
def p18(spark, sf):
    return scoring.candidates(stored_listings(spark, sf), stored_scores(spark, sf), F.lit(NOW).cast("timestamp")).select("id", "fresh")


@query("p20_active_only", oracle("select id from listings where dismissed_at is null", "listings"))
def p20(spark, sf):
    return view(spark, sf, "listings").where("dismissed_at is null").select("id")


CHOSEN = "chosen as (select * from x where skip_reason is null order by coalesce(risk_level = 'high', false), score desc, id limit 40)"
SPLIT = f"""{CHOSEN}, y as (select *, coalesce(risk_level = 'high', false) as suspicious, row_number() over (partition by risk_level = 'high' order by score desc, id) as place from chosen),
  z as (select *, count(*) filter (not suspicious) over () as normals from y), split as (select *, place > case when suspicious then greatest(12 - normals, 0) else 12 end as deferred from z)"""


@query("w4_digest_cut", digest_sql(f", {CHOSEN} select id, score, risk_level, title from chosen"))
def w4(spark, sf):
    return digest.selection(digest_rows(spark, sf), C, 40).select("id", "score", "risk_level", "title")


def split_rows(spark, sf, queue=False):
    return digest.batches(cut_lineage(digest.selection(digest_rows(spark, sf), C, 40)), 12, queue)


def both_modes(spark, sf, fn):
    """A selection written once and split for sending and for a queue."""
    chosen = cut_lineage(digest.selection(digest_rows(spark, sf), C, 40))
    parts = [fn(digest.batches(chosen, 12, queue)).withColumn("queue", F.lit(queue)) for queue in (False, True)]
    return parts[0].unionByName(parts[1])


BOTH = f"""{SPLIT.replace('split as (select *, place >', 'split as (select *, queue, not queue and place >').replace('from z)', 'from z, (select unnest([false, true]) as queue))')}"""


@query("w5_digest_split", digest_sql(f", {BOTH} select id, suspicious, cast(place as integer) as place, deferred, queue from split"))
def w5(spark, sf):
    return both_modes(spark, sf, lambda split: split.select("id", "suspicious", "place", "deferred"))


@query("a10_send_stats", digest_sql(f", {BOTH} select queue, count(*) filter (not suspicious and not deferred) as normal, count(*) filter (suspicious and not deferred) as suspicious, count(*) filter (deferred) as deferred from split group by queue"))
def a10(spark, sf):
    return both_modes(spark, sf, digest.send_stats)


_LINES = """lines as (select queue, 0 as part, 1 as place, cast(null as varchar) as listing_id from (select distinct queue from split) union all select queue, case when suspicious then 3 else 1 end, place, id from split where not deferred
  union all select distinct queue, 2, 1, null from split where suspicious and not deferred)"""


@query("w6_send_schedule", digest_sql(
    f", {BOTH}, {_LINES} select queue, cast(row_number() over (partition by queue order by part, place) - 1 as integer) as position, listing_id, strftime(timestamp '{NOW}' + (row_number() over (partition by queue order by part, place) - 1) * interval '2500' millisecond, '%H:%M:%S') as send_at from lines"))
def w6(spark, sf):
    def lines(split):
        rows = digest.schedule(split, "header", C.reference_name, NOW, 2500)
        return rows.select("position", "listing_id", F.date_format("send_at", "HH:mm:ss").alias("send_at"))

    return both_modes(spark, sf, lines)


@query("w9_digest_cards", digest_sql(f""", {BOTH}, counts as (select queue, count(*) filter (not suspicious and not deferred) as normal, count(*) filter (suspicious and not deferred) as suspicious, count(*) filter (deferred) as deferred from split group by queue)
  select queue, '📅 01/06/2001' || chr(10) || 'New: 5 · email duplicates skipped: 6' || chr(10) || 'Top ' || normal || case when suspicious > 0 then ' + ' || suspicious || ' suspicious' else '' end
    || case when queue then chr(10) || '📬 ' || (normal + suspicious) || ' cards queued in BullMQ (staggered 2500 ms)' when deferred > 0 then chr(10) || '⏳ ' || deferred || ' more in queue — next pipeline run' else '' end as header,
    1 + normal + suspicious + case when suspicious > 0 then 1 else 0 end as lines from counts"""))
def w9(spark, sf):
    """The plan's digest in both modes: its header, and how many lines it has."""
    rows = linked_listings(spark, sf).drop("link_changed").withColumn("distance_to_ref_m", (F.col("n") * 350).cast("int"))
    chosen = cut_lineage(digest.selection(digest.digest_view(rows, stored_scores(spark, sf)), C, 40))  # the same in both modes
    out = None
    for queue in (False, True):
        lines = rate.cards_of(chosen, C, NOW, 5, 6, per_run=12, queue=queue)
        one = lines.agg(F.max(F.when(F.col("position") == 0, F.col("text"))).alias("header"), F.count("*").alias("lines")).withColumn("queue", F.lit(queue))
        out = one if out is None else out.unionByName(one)
    return out


_CARD = f"""concat_ws(chr(10),
  case risk_level when 'high' then '🚨 ' when 'medium' then '⚠️ ' when 'low' then '⚠️ ' else '' end || '🏠 ' || score || '/100 — ' || title,
  case when p_id is not null then {S.q(V.DUPLICATE_LINE)} || p_title || chr(10) || '   ' || p_url end,
  concat_ws(', ', {S.num('rooms')} || ' rooms', {S.num('area_sqm')} || ' m²', location_hint),
  nullif(concat_ws(' · ', '💶 ' || rent_eur || ' €/mo', 'spese ' || condo_fee_eur || '€', case when condo_fee_eur is not null then 'total ~' || total_cost_eur || '€' end), ''),
  '📍 ' || {S.distance_text('(n * 350)')} || ' from {C.reference_name}', '💡 ' || nullif(trim(summary), ''), '✅ ' || reason, '⚠️ ' || risk_reason,
  {S.source_line('source', 'listing_url', 'canonical_url')}, coalesce('🔗 ' || {S.open_link('listing_url', 'canonical_url')}, {S.q(V.NO_LINK_LINE)}))"""
_PAIRED = "paired as (select v.*, b.id as p_id, b.title as p_title, b.canonical_url as p_url from v left join {from} b on v.possible_duplicate_of_id = b.id)"


@query("t32_listing_card", digest_sql(f", {_PAIRED} select id, {_CARD} as card from paired"))
def t32(spark, sf):
    rows = digest_rows(spark, sf)
    return rows.select("id", cards.card({n: F.col(n) for n in rows.columns}, C.reference_name).alias("card"))


@query("t33_duplicate_line", digest_sql(
    f", {_PAIRED} select id, case when p_id is not null then {S.q(V.DUPLICATE_LINE)} || p_title || chr(10) || '   ' || p_url end as line from paired"))
def t33(spark, sf):
    return digest_rows(spark, sf).select("id", cards.duplicate_line(F.col("possible_duplicate_of")).alias("line"))


@query("w7_newest_active", oracle("select id from listings where dismissed_at is null order by last_seen_at desc, id limit 100", "listings"))
def w7(spark, sf):
    return scoring.candidates(stored_listings(spark, sf), stored_scores(spark, sf), F.lit(NOW).cast("timestamp"), limit=100).select("id")


@query("w8_last_runs", oracle("select order_id as id from (select o_orderkey as order_id, o_orderdate from orders) order by o_orderdate desc, order_id limit 20", "messages"))
def w8(spark, sf):
    runs = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("started_at"))
    return tables.last_runs(runs, 20).select("id")


# --- upsert and upkeep -------------------------------------------------------
def shared_drafts(spark, sf):
    return view(spark, sf, "shared_drafts").drop("draft_id", "grp", "owner")


def _last(column: str) -> str:
    return f"arg_max({column}, (seen_at, draft_key)) filter ({column} is not null)"


# Who a draft belongs to, in two passes: the first URL of a group owns the key until it asks
# for another rent; the first foreign draft after that opens a listing and owns it from then on.
_WHEN = "struct_pack(a := seen_at, b := draft_key)"
TARGETS = [
    {"moment": _WHEN, "street": S.street(S.blob("location_hint", "title", "raw_snippet")), "hash": HASH, "total": "case when rent_eur is not null then rent_eur + coalesce(condo_fee_eur, 0) end"},
    {"freed": "min(case when canonical_url = owner and rent_eur % 10 = 7 then moment end) over (partition by grp)"},
    {"taken": "min(case when canonical_url <> owner and moment > freed then moment end) over (partition by grp)",
     "fingerprint": f"street || '|r' || {S.whole('rooms')} || '|a' || {S.whole('area_sqm')} || '|€' || cast(rent_eur as varchar)", "match_key": f"street || '|r' || {S.whole('rooms')} || '|€' || cast(rent_eur as varchar)"},
    {"heir": "max(case when moment = taken then canonical_url end) over (partition by grp)"},
    {"target": "case when canonical_url = owner or taken is null or moment < taken then owner else heir end"},
    {"is_new": "row_number() over (partition by target order by moment) = 1", "prev_rent": "lag(rent_eur) over (partition by target order by moment)", "prev_hash": "lag(hash) over (partition by target order by moment)"},
    {"price_changed": "coalesce(rent_eur <> prev_rent, false)", "material_changed": "coalesce(hash <> prev_hash, false)"},
]
_URL_OK = "listing_url is not null and trim(listing_url) <> ''"
_DAY = "'%Y-%m-%d %H:%M:%S'"
FOLD = oracle(f"""select target as canonical_url, {', '.join(f'{_last(n)} as {n}' for n in ('rent_eur', 'condo_fee_eur', 'area_sqm', 'rooms', 'location_hint', 'raw_snippet', 'source'))},
  {_last('total')} as total_cost_eur, {_last('fingerprint')} as listing_fingerprint, {_last('match_key')} as property_match_key, arg_max(hash, moment) as material_hash,
  arg_min(title, (-length(title), seen_at, draft_key)) as title, arg_max(listing_url, ({S.url_score('listing_url')}, seen_at, draft_key)) filter ({_URL_OK}) as listing_url,
  strftime(min(seen_at), {_DAY}) as first_seen, strftime(max(seen_at), {_DAY}) as last_seen, strftime(max(seen_at) filter (price_changed), {_DAY}) as price_changed_at
  from {{from}} group by target""", "shared_drafts", steps=TARGETS)
_FOLDED = ("rent_eur", "condo_fee_eur", "area_sqm", "rooms", "location_hint", "raw_snippet", "source", "total_cost_eur", "listing_fingerprint", "property_match_key", "material_hash", "title", "listing_url")


def folded(listings):
    times = {"first_seen": "first_seen_at", "last_seen": "last_seen_at", "price_changed_at": "price_changed_at"}
    return listings.select("canonical_url", *_FOLDED, *[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(n) for n, c in times.items()])


@query("u1_merge_new", oracle(f"select target as canonical_url, arg_min(title, (-length(title), seen_at, draft_key)) as title, count(*) filter (is_new) as opened, strftime(min(seen_at), {_DAY}) as first_seen from {{from}} group by target", "shared_drafts", steps=TARGETS))
def u1(spark, sf):
    merged = upsert.merge(upsert.empty_listings(spark), shared_drafts(spark, sf))
    opened = merged.changes.where("is_new").groupBy(F.col("target_url").alias("canonical_url")).agg(F.count("*").alias("opened"))
    return merged.listings.join(opened, "canonical_url").select("canonical_url", "title", "opened", F.date_format("first_seen_at", "yyyy-MM-dd HH:mm:ss").alias("first_seen"))


@query("u2_merge_fields", FOLD)
def u2(spark, sf):
    """Half of the drafts first, the other half on top of the stored result."""
    d = shared_drafts(spark, sf)
    early = F.col("seen_at") < F.lit("1998-01-01").cast("timestamp")
    first = upsert.merge(upsert.empty_listings(spark), d.where(early)).listings
    return folded(upsert.merge(first, d.where(~early)).listings)


@query("u3_price_changes", oracle(
    """select listing_key, obs_id, prev_rent, rent_eur from (select *, lag(rent_eur) over (partition by listing_key order by observed_at, obs_id) as prev_rent from observations) where prev_rent <> rent_eur""", "observations"))
def u3(spark, sf):
    rows, _ = numbered(view(spark, sf, "observations"), "observed_at", "obs_id")
    rows = with_previous(rows, ["listing_key"], chunk(), ["pos"], ["rent_eur"])
    return rows.where(F.col("prev_rent_eur") != F.col("rent_eur")).select("listing_key", "obs_id", F.col("prev_rent_eur").alias("prev_rent"), "rent_eur")


@query("u4_material_changes", oracle(
    f"""select draft_key, coalesce(prev <> hash, false) as changed from (select *, lag(hash) over (partition by canonical_url order by seen_at, draft_key) as prev from {{from}})""", "drafts", steps=[{"hash": HASH}]))
def u4(spark, sf):
    k = F.col
    rows = view(spark, sf, "drafts").withColumn("hash", keys.material_hash(k("rent_eur"), k("area_sqm"), k("rooms"), k("location_hint")))
    rows, _ = numbered(rows.select("draft_key", "seen_at", "canonical_url", "hash"), "seen_at", "draft_key")
    rows = with_previous(rows, ["canonical_url"], chunk(), ["pos"], ["hash"])
    return rows.select("draft_key", F.coalesce(k("prev_hash") != k("hash"), F.lit(False)).alias("changed"))


@query("u5_change_feed", oracle("select draft_key, target as target_url, is_new, price_changed, material_changed from {from}", "shared_drafts", steps=TARGETS))
def u5(spark, sf):
    merged = upsert.merge(upsert.empty_listings(spark), shared_drafts(spark, sf))
    return merged.changes.select("draft_key", "target_url", "is_new", "price_changed", "material_changed")


@query("u5_two_key_changes", oracle(
    """select count(*) as drafts, count(*) filter (is_new) as new, count(*) filter (price_changed) as price_changes, count(*) filter (canonical_url <> target) as by_second_key,
       count(distinct case when canonical_url <> target then canonical_url || target end) as alternates from {from}""", "shared_drafts", steps=TARGETS))
def u5_two_keys(spark, sf):
    """Counters of a merge under both keys; the general order-dependent rule is held to a replay in the tests."""
    drafts = shared_drafts(spark, sf)
    merged = upsert.merge(upsert.empty_listings(spark), drafts)
    c = F.col
    foreign = merged.changes.join(drafts.select("draft_key", "canonical_url"), "draft_key").select((c("canonical_url") != c("target_url")).alias("foreign"), "is_new", "price_changed")
    counts = foreign.agg(
        F.count("*").alias("drafts"), F.count(F.when(c("is_new"), 1)).alias("new"),
        F.count(F.when(c("price_changed"), 1)).alias("price_changes"), F.count(F.when(c("foreign"), 1)).alias("by_second_key"),
    )
    return counts.join(merged.alternate_urls.agg(F.count("*").alias("alternates")))  # one-row sides


@query("u6_backfill_match_keys", oracle("select id, case when n % 2 = 0 then 'kept' when dismissed_at is null then property_match_key end as property_match_key from {from}", "listings", steps=PRIMARY))
def u6(spark, sf):
    rows = stored_listings(spark, sf).withColumn("property_match_key", F.when(F.col("n") % 2 == 0, F.lit("kept")))
    return duplicates.backfill_match_keys(rows).select("id", "property_match_key")


@query("u7_links_changed", oracle("select count(*) filter (possible_duplicate_of_id is not null) as changed, count(*) as listings from {from}", "listings", steps=PRIMARY))
def u7(spark, sf):
    return linked_listings(spark, sf).agg(F.count(F.when(F.col("link_changed"), 1)).alias("changed"), F.count("*").alias("listings"))


@query("u7_links_by_batches", ORACLES["w2_duplicate_primary"])
def u7_batches(spark, sf):
    """The later half first, so the second batch brings older listings and moves links."""
    rows = stored_listings(spark, sf).withColumns({"possible_duplicate_of_id": F.lit(None).cast("string"), "property_match_key": F.lit(None).cast("string")})
    rows = cut_lineage(duplicates.backfill_match_keys(rows).withColumn("late", F.col("n") % 2 == 0))
    table = Listings(Store(spark, fresh_folder(spark, "u7")), buckets=8)
    rows = upsert.empty_listings(spark).withColumn("late", F.lit(None).cast("boolean")).unionByName(rows.select("late", *[c for c in upsert.empty_listings(spark).columns if c in rows.columns]), allowMissingColumns=True)
    for version, late in ((1, True), (2, False)):
        batch = rows.where(F.col("late") == late).drop("late")
        table.put(version, batch.limit(0), batch)
    return table.rows.read().select("id", "possible_duplicate_of_id")


@query("u8_mark_sent", oracle("select id, case when n % 2 = 0 then '2001-06-01 00:00:00' else strftime(sent_at, '%Y-%m-%d %H:%M:%S') end as sent, case when n % 5 = 0 then '2001-06-01 00:00:00' else strftime(dismissed_at, '%Y-%m-%d %H:%M:%S') end as dismissed from listings", "listings"))
def u8(spark, sf):
    rows = stored_listings(spark, sf)
    sent = rows.where("n % 2 = 0").select(F.col("id").alias("listing_id"), F.lit(NOW).cast("timestamp").alias("sent_at"), F.lit("m").alias("message_id"))
    marked = tables.mark_dismissed(tables.mark_sent(rows, sent), rows.where("n % 5 = 0").select(F.col("id").alias("listing_id")), NOW)
    fmt = "yyyy-MM-dd HH:mm:ss"
    return marked.select("id", F.date_format("sent_at", fmt).alias("sent"), F.date_format("dismissed_at", fmt).alias("dismissed"))


def located(spark, sf):
    """Listings by title against the gazetteers; every third one brings its own point."""
    own = F.col("n") % 3 == 0
    rows = titled(stored_listings(spark, sf)).withColumns({
        "lat": F.when(own, F.lit(45.07)), "lng": F.when(own, F.lit(7.65)), "geocode_source": F.lit(None).cast("string"),
        "geocoded_at": F.lit(None).cast("timestamp"), "distance_to_ref_m": F.lit(None).cast("int"), "proximity_score": F.lit(None).cast("int"),
    })
    return geocode.resolve(rows, C, view(spark, sf, "gazetteer"), view(spark, sf, "places"), view(spark, sf, "places").limit(0), AS_OF)


_METERS = f"cast(floor({S.haversine('la', 'ln', f'cast({LAT} as double)', f'cast({LNG} as double)')} + 0.5) as integer)"
LOCATED = f"""pts as (select l.*, case when n % 3 = 0 then 45.07 else coalesce(c.lat, w.lat) end as la, case when n % 3 = 0 then 7.65 else coalesce(c.lng, w.lng) end as ln,
    case when n % 3 = 0 then null when c.query_key is not null then 'cache' when w.query_key is not null then 'gazetteer' end as geocode_source
  from {{from}} l left join cache c on l.geo_key = c.query_key left join wide w on l.geo_key = w.query_key),
  measured as (select *, case when la is not null then {_METERS} end as meters from pts)"""


@query("g2_proximity", oracle(
    f", {POINTS}, {LOCATED} select id, geocode_source, meters as distance_to_ref_m, cast({bucket_sql('meters')} as integer) as proximity_score from measured",
    "listings", "gazetteer", "places", steps=GEO_TITLED))
def g2(spark, sf):
    return located(spark, sf).select("id", "geocode_source", "distance_to_ref_m", "proximity_score")


@query("g3_proximity_off", oracle("select id, n * 350 as distance_to_ref_m from listings", "listings"))
def g3(spark, sf):
    rows = stored_listings(spark, sf).withColumn("distance_to_ref_m", (F.col("n") * 350).cast("int"))
    none = view(spark, sf, "gazetteer")
    return geocode.resolve(rows, replace(C, geocoding_enabled=False), none, none, none).select("id", "distance_to_ref_m")


@query("u9_geo_write_back", oracle(
    f", {POINTS}, {LOCATED} select id, geocode_source, case when geocode_source is not null then '2024-03-03 00:00:00' end as geocoded_at from measured",
    "listings", "gazetteer", "places", steps=GEO_TITLED))
def u9(spark, sf):
    rows = stored_listings(spark, sf).withColumns({n: F.lit(None).cast(t) for n, t in {"lat": "double", "lng": "double", "geocode_source": "string", "geocoded_at": "timestamp", "distance_to_ref_m": "int", "proximity_score": "int"}.items()})
    done = rate.with_points(rows, located(spark, sf))
    return done.select("id", "geocode_source", F.date_format("geocoded_at", "yyyy-MM-dd HH:mm:ss").alias("geocoded_at"))


@query("u10_cache_misses", oracle(
    f", {POINTS}, {LOCATED} select distinct geo_key as query_key, la as lat, ln as lng from measured where geocode_source = 'gazetteer'", "listings", "gazetteer", "places", steps=GEO_TITLED))
def u10(spark, sf):
    return geocode.new_cache_rows(located(spark, sf), view(spark, sf, "gazetteer"), AS_OF).select("query_key", "lat", "lng")


@query("u11_rescore_reset", oracle("select id, cast(null as varchar) as sent from listings", "listings"))
def u11(spark, sf):
    rows, scores = tables.rescore_reset(stored_listings(spark, sf), stored_scores(spark, sf))
    kept = rows.join(scores.select(F.col("listing_id").alias("id")), "id", "left_anti")
    return kept.select("id", F.col("sent_at").cast("string").alias("sent"))


@query("u12_purge_click_hosts", oracle(
    """select 'listings' as table_name, count(*) as n from listings where not contains(coalesce(listing_url, ''), 'clicks.immobiliare.it')
       union all select 'scores', count(*) from scores s where not exists (select 1 from listings l where l.id = s.listing_id and contains(l.listing_url, 'clicks.immobiliare.it'))
       union all select 'ledger', count(*) from messages where not contains(from_address, 'immobiliare.it')""", "listings", "scores", "messages"))
def u12(spark, sf):
    # Listings take their click URL as canonical here, so that some are junk.
    junk = stored_listings(spark, sf).withColumn("canonical_url", F.coalesce("listing_url", "canonical_url"))
    kept, scores, ledger = tables.purge_click_hosts(junk, stored_scores(spark, sf), view(spark, sf, "messages"))
    return tables.row_counts(listings=kept, scores=scores, ledger=ledger)


@query("u13_portal_reset", oracle(
    """, r as (select *, coalesce(contains(source, 'idealista') or contains(source, 'casa.it'), false) as src from listings)
     select 'cleared' as what, count(*) filter (not (src or contains(canonical_url, 'immobiliare.it') or contains(canonical_url, 'idealista.it') or contains(canonical_url, 'casa.it')) and sent_at is not null) as n from r
     union all select 'scores', (select count(*) from scores s join r on r.id = s.listing_id where not (src or contains(canonical_url, 'immobiliare.it')))
     union all select 'ledger', count(*) from messages where not (contains(from_address, 'idealista') or contains(from_address, 'casa.it') or contains(from_address, 'immobiliare.it'))""", "listings", "scores", "messages"))
def u13(spark, sf):
    blank = {n: F.lit(None).cast(t) for n, t in {"lat": "double", "lng": "double", "geocode_source": "string", "geocoded_at": "timestamp", "distance_to_ref_m": "int", "proximity_score": "int"}.items()}
    rows, scores, ledger = tables.portal_reset(stored_listings(spark, sf).withColumns(blank), stored_scores(spark, sf), view(spark, sf, "messages"))
    return tables.row_counts(cleared=rows.where("sent_at is not null"), scores=scores, ledger=ledger).withColumnRenamed("table_name", "what")


# --- scoring run -------------------------------------------------------------
@query("s8_score_append", oracle(
    f"select id as listing_id, n + 1 as n, '{AS_OF}' as newest from listings", "listings"))
def s8(spark, sf):
    """Score rows of a run appended to the history."""
    old = stored_scores(spark, sf)
    new = scoring.score(located(spark, sf), C, None, AS_OF)
    return old.unionByName(new).groupBy("listing_id").agg(F.count("*").cast("int").alias("n"), F.max("scored_at").cast("string").alias("newest"))


def _score_sql() -> str:
    steps = [
        {"prox": "cast(n % 11 as integer)", "meters": "case when n % 4 > 0 then n * 350 end"}, *rule_steps("prox", "meters"),
        {"response": "reply"}, SCORES, {"usable": "response is not null"}, {"pk": "least(10, prox)"}, {"total": f"({SUM} + pk)"},
        {"score": blend_sql("rule", "(case when usable then total end)"), "line": scores_line("total", "pk"), "level": "json_extract_string(response, '$.riskLevel')", "reply_reasons": "json_type(response, '$.riskReasons') = 'ARRAY'"},
    ]
    base = """with_reply as (select l.*, r.reply from listings l left join (select canonical_url as listing_id, max(response) as reply from drafts join replies using (draft_id) group by 1) r on r.listing_id = l.id and l.n % 2 = 0)"""
    return S.chain(with_clause("listings", "drafts", "replies") + ",\n" + base, "with_reply", steps, """select id as listing_id, score,
        reasons || case when usable then '; ' || line else '' end as reasons, case when usable then trim(json_extract_string(response, '$.summary')) end as summary,
        case when level = 'high' or risk = 'high' then 'high' else 'none' end as risk_level, case when level = 'high' and reply_reasons then concat_ws('; ', nullif(flags, ''), 'first', 'second') else flags end as risk_reasons, case when usable then 'm1' end as model from {from}""")


@query("n17_scored_listings", _score_sql())
def n17(spark, sf):
    rows = stored_listings(spark, sf).withColumns({"proximity_score": (F.col("n") % 11).cast("int"), "distance_to_ref_m": F.when(F.col("n") % 4 > 0, (F.col("n") * 350).cast("int"))})
    even = rows.where("n % 2 = 0").select(F.col("id").alias("canonical_url"))
    drafts = view(spark, sf, "drafts").select("draft_id", "canonical_url").join(even, "canonical_url", "left_semi")
    answers = drafts.join(view(spark, sf, "replies"), "draft_id").select(F.col("canonical_url").alias("listing_id"), "response")
    scored = scoring.score(rows, C, answers, NOW, "m1")
    return scored.select("listing_id", "score", F.array_join("reasons", "; ").alias("reasons"), "summary", "risk_level", F.array_join("risk_reasons", "; ").alias("risk_reasons"), "model")
