"""Input views over the given tables, in SQL that both engines read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "pages", "conversations",
)

# name -> (views it reads, SQL)
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "drafts": ((), """
select l_orderkey*10+l_linenumber as draft_id,
 concat(cast(l_orderkey as varchar(20)), '-', cast(l_linenumber as varchar(20)), '-', cast(l_partkey as varchar(20)), '-', cast(l_suppkey as varchar(20)), '-', cast(cast(floor(l_extendedprice*100) as bigint) as varchar(20))) as draft_key,
 concat('https://www.', case l_suppkey%4 when 0 then 'idealista.it/immobile/' when 1 then 'casa.it/immobili/' when 2 then 'immobiliare.it/annunci/' else 'subito.it/affitto/' end, cast(l_partkey as varchar(20)), '/') as canonical_url,
 case l_suppkey%6 when 0 then concat('https://clicks.immobiliare.it/f/a/', cast(l_partkey as varchar(20)), '~~/x') when 1 then concat('https://www.idealista.it/immobile/', cast(l_partkey as varchar(20)), '/') when 2 then ' ' when 3 then concat('https://track.example.com/', cast(l_orderkey as varchar(20))) else null end as listing_url,
 case l_suppkey%4 when 0 then 'idealista.it' when 1 then 'casa.it' when 2 then 'www.Immobiliare.it' else null end as source,
 concat(case l_linenumber%3 when 0 then 'Trilocale' when 1 then 'Bilocale' else 'Studio' end, ' via ', replace(lower(p_brand),'#','n'), ' ', cast(l_suppkey%20+1 as varchar(20))) as title,
 case when l_orderkey%11=0 then null else concat(case n_regionkey when 0 then 'Cenisia' when 1 then 'San Donato' when 2 then 'Pozzo Strada' else 'Crocetta' end, ', Torino') end as location_hint,
 case when l_orderkey%13=0 then null else cast(200 + 25*((l_orderkey*7 + l_partkey)%32) as int) end as rent_eur,
 case when l_orderkey%3=0 then cast(l_linenumber*30 as int) else null end as condo_fee_eur,
 cast(30 + l_quantity as double) as area_sqm,
 cast(1 + l_linenumber%5 as double) as rooms,
 case l_suppkey%17 when 0 then 'contatta solo WhatsApp' when 1 then 'pagare prima con Western Union' when 2 then 'vicino Piazza Bernini' else 'ottimo stato' end as raw_snippet,
 cast(l_shipdate as timestamp) as seen_at
from lineitem join part on l_partkey=p_partkey join supplier on l_suppkey=s_suppkey join nation on s_nationkey=n_nationkey"""),
    # Drafts whose second key meets often: the URLs of a group describe one flat.  In two groups
    # of three the URL that came first asks for more rent from a known day on; from then on
    # the key is free, and the next foreign draft takes it over.  A group is the URLs of half of each eight
    # neighbouring parts; the URLs of the other half stay alone, so groups and listings grow with the input.
    "shared_drafts": (("drafts",), """
select draft_id, draft_key, canonical_url, listing_url, source, concat(title, ' in via gruppo', cast(grp as varchar(20)), ' 1') as title, location_hint,
 cast(500 + 10*(grp%40) + case when grp%3 > 0 and canonical_url = owner and seen_at >= cast('1995-06-01 00:00:00' as timestamp) then 7 else 0 end as int) as rent_eur,
 condo_fee_eur, area_sqm, rooms, raw_snippet, seen_at, grp, owner
from (select *, first_value(canonical_url) over (partition by grp order by seen_at, draft_key) as owner
 from (select draft_id, draft_key, canonical_url, listing_url, source, split_part(title, ' ', 1) as title, replace(location_hint, 'Pozzo Strada', 'Borgo Nuovo') as location_hint, condo_fee_eur, cast(60 as double) as area_sqm, cast(3 as double) as rooms, raw_snippet, seen_at,
   case when part%8 < 4 then part - part%8 else 10000000 + 4*part + supp%4 end as grp
  from (select *, cast(split_part(draft_key, '-', 3) as bigint) as part, cast(split_part(draft_key, '-', 4) as bigint) as supp from drafts) d) o) g"""),
    "posts": ((), """
select conv_id*100+turn as post_id, cast(conv_id%5 as varchar(20)) as group_id,
 concat('https://www.facebook.com/groups/', cast(conv_id%5 as varchar(20)), '/posts/', cast(conv_id*100+turn as varchar(20)), '/') as permalink,
 concat(case (conv_id+turn)%6 when 0 then 'Affitto trilocale 75 mq in Cenisia, Torino. 750 €/mese ' when 1 then 'Stanza singola per studenti, posto letto 350 € ' when 2 then 'Appartamento in vendita 200000 € ' when 3 then 'mi interessa 4m Like Reply ' when 4 then concat('Affitto bilocale 60 mq 620 € https://www.idealista.it/immobile/', cast(conv_id as varchar(20)), '/?utm_source=fb ') else '' end, text) as message,
 cast('2024-03-01 08:00:00' as timestamp) as posted_at
from conversations"""),
    # Three anchors a message: the listing, the same again (a tie or a longer title), a footer link.
    "messages": ((), """
select page_id as message_id,
 case page_id%4 when 0 then 'noreply@casa.it' when 1 then 'alert@idealista.it' when 2 then 'noreply@notifiche.immobiliare.it' else 'other@example.com' end as from_address,
 case when page_id%4=0 then concat('Un nuovo annuncio: ', cast(400+page_id as varchar(20)), ' € | ', cast(50+page_id%40 as varchar(20)), ' mq | Via Roma ', cast(page_id%30 as varchar(20)), ', Torino') when page_id%7=0 then 'Appartamenti in vendita a Torino' else 'nuovo annuncio' end as subject,
 concat('<table><tr><td><a href="https://www.', case page_id%4 when 0 then 'casa.it/immobili/' else 'idealista.it/immobile/' end, cast(page_id as varchar(20)), '/?utm_source=a&x=1">Trilocale in Via Roma, ', cast(page_id%30 as varchar(20)), ', Torino</a> ', cast(400+page_id as varchar(20)), ' €/mese ', cast(50+page_id%40 as varchar(20)), ' m² 3 locali spese ', cast(page_id%90 as varchar(20)), '€</td></tr></table><table><tr><td><a href=', chr(39), 'https://www.', case page_id%4 when 0 then 'casa.it/immobili/' else 'idealista.it/immobile/' end, cast(page_id as varchar(20)), '/?utm_term=b&x=1', chr(39), '>Trilocale ', case page_id%8 when 5 then 'luminoso ' else '' end, 'in Via Roma, ', cast(page_id%30 as varchar(20)), ', Torino</a> ', cast(410+page_id as varchar(20)), ' €/mese 77 m² 2 locali <a href="https://www.', case page_id%4 when 0 then 'casa.it/immobili/' else 'idealista.it/immobile/' end, cast(page_id as varchar(20)), '/?x=1">Vedi 5 foto</a></td></tr></table>', html) as html_body,
 '' as text_body,
 cast('2024-03-01 00:00:00' as timestamp) + page_id%60 * interval '1' hour as received_at
from pages"""),
    "clicks": ((), """
select page_id as message_id, 'noreply@notifiche.immobiliare.it' as from_address, 'nuovi annunci' as subject,
 concat('<table><tr><td><a href="', case when page_id%3=0 then '' else 'https://' end, 'clicks.immobiliare.it/f/a/click', cast(page_id as varchar(20)), 'abcdefghijk~~/AAA/">', cast(2+page_id%4 as varchar(20)), '-room flat via Roma ', cast(page_id%30 as varchar(20)), ', San Salvario</a> € ', cast(450+page_id%600 as varchar(20)), '/month ', cast(40+page_id%60 as varchar(20)), ' m² | ', cast(1+page_id%4 as varchar(20)), ' rooms spese ', cast(page_id%90 as varchar(20)), '€ <a href="https://clicks.immobiliare.it/f/a/zzz">SEE DETAILS</a></td></tr></table>', html) as html_body,
 '' as text_body, cast('2024-03-01 00:00:00' as timestamp) as received_at
from pages"""),
    "replies": ((), """
select l_orderkey*10+l_linenumber as draft_id, concat('{"budgetFit":', cast(l_linenumber*2 as varchar(20)), ',"sizeForFamily":', cast(l_orderkey%13 as varchar(20)), ',"targetZone":', case when l_partkey%2=0 then concat('"', cast(l_partkey%11 as varchar(20)), '"') else cast(l_partkey%11 as varchar(20)) end, ',"riskReasons":', case (l_orderkey*10+l_linenumber)%3 when 0 then '["first","second"]' when 1 then '"no array"' else 'null' end, ',"riskLevel":"', case when l_suppkey%9=0 then 'high' else 'none' end, '","summary":" tip ', cast(l_suppkey as varchar(20)), ' "}') as response from lineitem"""),
    "gazetteer": ((), """
select concat('via brandn', cast(s_suppkey%25+1 as varchar(20)), ' ', cast(s_suppkey%20+1 as varchar(20)), ' torino italy') as query_key, 45.0 + cast(s_suppkey%200 as double)/1000 as lat, 7.6 + cast(s_suppkey%100 as double)/1000 as lng from supplier"""),
    "places": ((), """
select concat('via brandn', cast(p_partkey%60+1 as varchar(20)), ' ', cast(p_partkey%20+1 as varchar(20)), ' torino italy') as query_key, 45.05 + cast(p_partkey%7 as double)/1000 as lat, 7.62 + cast(p_partkey%5 as double)/1000 as lng from part"""),
    "observations": ((), """
select user_id as listing_key, event_id as obs_id, cast(ts as timestamp) as observed_at, cast(300+floor(value) as int) as rent_eur, event_type as source from events"""),
    # One row per listing URL: the stored table most jobs read.
    "listings": (("drafts",), """
select canonical_url as id, canonical_url, max(listing_url) as listing_url,
 case when max(condo_fee_eur) = 210 then 'facebook.group' else min(source) end as source, min(title) as title,
 min(location_hint) as location_hint, max(rent_eur) as rent_eur, min(condo_fee_eur) as condo_fee_eur,
 cast(max(rent_eur) + coalesce(min(condo_fee_eur), 0) as int) as total_cost_eur, min(area_sqm) as area_sqm, max(rooms) as rooms,
 min(raw_snippet) as raw_snippet, min(seen_at) as first_seen_at, max(seen_at) as last_seen_at,
 case when count(*)%3=0 then max(seen_at) - interval '20' day end as price_changed_at,
 case when count(*)%4=0 then min(seen_at) + interval '30' day end as sent_at,
 case when count(*)%7=0 then max(seen_at) end as dismissed_at, cast(count(*) as int) as n
from drafts group by canonical_url"""),
    # Score history: one row per draft of the listing.
    "scores": (("drafts",), """
select draft_key as id, canonical_url as listing_id, cast((draft_id*7)%101 as int) as score,
 concat('reason ', cast(draft_id%5 as varchar(20))) as reason, concat(' tip ', cast(draft_id%9 as varchar(20)), ' ') as summary,
 case draft_id%10 when 0 then 'high' when 1 then 'medium' when 2 then 'low' else 'none' end as risk_level,
 case draft_id%10 when 0 then 'flag' end as risk_reason, case when draft_id%10 < 3 then 'rules' else 'none' end as risk_source,
 'model' as model, seen_at + interval '1' day as scored_at
from drafts"""),
    # Pages whose hrefs are spelled in double quotes, in single quotes or bare.
    "spelled_pages": ((), """
select page_id, case page_id%3 when 1 then replace(html, '"', chr(39)) when 2 then replace(replace(html, 'href="', 'href='), '">', '>') else html end as html from pages"""),
    "feed_pages": ((), """
select concat(cast(conv_id as varchar(20)), '-', cast(turn as varchar(20))) as page_id, cast(conv_id%5 as varchar(20)) as group_id,
 case (conv_id+turn)%4
  when 0 then concat('<html><body><a href="https://www.facebook.com/groups/', cast(conv_id%5 as varchar(20)), '/posts/', cast(conv_id*100+turn as varchar(20)), '/?ref=feed&amp;a=1">x</a><p>It&#39;s ', text, '</p></body></html>')
  when 1 then concat('<div role="article"><a href="/groups/', cast(conv_id%5 as varchar(20)), '/posts/', cast(conv_id*100+turn as varchar(20)), '/?c=1">link</a><div>', text, ' 7 Like Reply tail</div></div>')
  when 2 then concat('<div class="x" role="article"><a href="/groups/', cast(conv_id%5 as varchar(20)), '/posts/', cast(conv_id*100+turn as varchar(20)), '/?c=1">link</a><div>', text, '</div></div> <div role="article"><script>var a</script><a href="https://www.facebook.com/groups/', cast(conv_id%5 as varchar(20)), '/posts/9', cast(conv_id*100+turn as varchar(20)), '/?c=1&amp;d=2">link</a><div>Affitto bilocale &amp; box See translation more</div></div>')
  else concat('<div role="article">nothing here</div> <a href="/groups/', cast(conv_id%5 as varchar(20)), '/posts/', cast(conv_id*100+turn as varchar(20)), '/?z=1">a</a> <a href="/groups/', cast(conv_id%5 as varchar(20)), '/posts/', cast(conv_id*100+turn as varchar(20)), '/">b</a>') end as html,
 cast('2024-03-01 08:00:00' as timestamp) as scraped_at
from conversations"""),
}


def with_clause(*names: str, instead: dict[str, str] | None = None) -> str:
    """CTEs for the views and everything they read; ``instead`` gives other SQL for some of them."""
    done: list[str] = []

    def add(name: str) -> None:
        for dep in VIEWS[name][0]:
            add(dep)
        if name not in done:
            done.append(name)

    for name in names:
        add(name)
    return ",\n".join(f"{n} as ({(instead or {}).get(n, VIEWS[n][1])})" for n in done)


def _drafts_by_url() -> str:
    """The drafts laid out by URL, for Spark: narrow inputs travel once, texts are spelled where they are grouped."""
    head, tail = VIEWS["drafts"][1].split("\nfrom lineitem ")
    before, url = head.split(" as canonical_url", 1)[0].rsplit(",\n ", 1)
    inputs = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate, p_brand, n_regionkey"
    return f"{before},\n _url{head[len(before) + len(url) + 3:]}\nfrom (select /*+ REPARTITION(_url) */ {inputs}, {url} as _url from lineitem {tail}) by_url"


def _listings_by_hash() -> str:
    """The listings, for Spark: rows are sorted by a hash of their URL first, as URLs share too long a beginning."""
    return VIEWS["listings"][1].replace("group by canonical_url", "group by xxhash64(canonical_url), canonical_url")


def _shared_by_group() -> dict[str, str]:
    """The shared drafts, for Spark: narrow inputs travel once to their group, and its owner is found before texts are spelled."""
    head, tail = VIEWS["drafts"][1].split("\nfrom lineitem ")
    spelled = lambda column: head.split(f" as {column}", 1)[0].rsplit(",\n ", 1)[1]
    inputs = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate, p_brand, n_regionkey"
    group = "case when l_partkey%8 < 4 then l_partkey - l_partkey%8 else 10000000 + 4*l_partkey + l_suppkey%4 end"
    drafts = f"""{head}, _grp, _owner
from (select *, first_value({spelled("canonical_url")}) over (partition by _grp order by cast(l_shipdate as timestamp), _key) as _owner
 from (select *, {spelled("draft_key")} as _key from (select /*+ REPARTITION(_grp) */ {inputs}, {group} as _grp from lineitem {tail}) n) k) by_grp"""
    shared = VIEWS["shared_drafts"][1]
    before, rest = shared.split("\n   case when part%8", 1)
    shared = f"{before}\n   _grp as grp, _owner{rest.split(' as grp', 1)[1]}"
    window = "first_value(canonical_url) over (partition by grp order by seen_at, draft_key) as owner"
    return {"drafts": drafts, "shared_drafts": shared.replace(f"*, {window}", "*, _owner as owner")}


#: Views that group the drafts, and what they read instead.
_LAID_OUT = {
    "listings": {"drafts": _drafts_by_url(), "listings": _listings_by_hash()}, "scores": {"drafts": _drafts_by_url()},
    "shared_drafts": _shared_by_group(),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = f"with {with_clause(name, instead=_LAID_OUT.get(name))} select * from {name}"
    for t in TABLES:
        if f" {t}" in sql:
            table(spark, sf_dir, t).createOrReplaceTempView(t)
    return spark.sql(sql)
