"""Golden documents and brute-force checks of the operators."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from rentlake.operators import dom, feed, mail, upsert
from rentlake.operators.duplicates import reconcile
from rentlake.operators.ordered import numbered, with_next, with_previous

# Invented alerts, one for each way a message is read.
CARD = """<table><tr><td><a href='https://www.idealista.it/immobile/7001/?from=mail'>Vedi 5 foto</a>
<p><a href='https://www.idealista.it/immobile/7001/?from=mail'>Trilocale in Corso Prova, 21, Moncalieri</a></p>
<p>{price}</p><p>84 m² 3 stanze</p><a href="https://www.idealista.it/{kind}-case/moncalieri/">Altri annunci</a></td></tr></table>"""
CLICKS = """<table><tr><td><p><a href="https://clicks.immobiliare.it/f/a/tokenNumberOne~~/x/y">3-room flat via Inventata 12, Aurora, Turin</a></p>
Aurora € 640/month 66 m² | 3 rooms <a href="https://clicks.immobiliare.it/f/a/two~~/x/y">SEE DETAILS</a></td></tr>
<tr><td><a href="https://clicks.immobiliare.it/f/a/three~~/x/y">Disable search</a></td></tr></table>"""
PLAIN = '<div>Oggi</div><a href="https://www.idealista.it/affitto/808/?utm_campaign=k">2 locali, 48 m², Collegno, 590 €/mese, spese 35€</a>'


def messages(spark):
    rows = [
        ("rent", "alert", "x@idealista.it", CARD.format(price="780 €/mese", kind="affitto"), ""),
        ("sale", "alert", "x@idealista.it", CARD.format(price="210.000 €", kind="vendita"), ""),
        ("click", "5 new listings for your search", "x@y.org", CLICKS, ""),
        ("plain", "subject", "x@y.org", "", PLAIN),
    ]
    return spark.createDataFrame(rows, "message_id string, subject string, from_address string, html_body string, text_body string")


def test_message_drafts(spark):
    got = {r["message_id"]: r for r in mail.drafts(messages(spark)).collect()}
    assert set(got) == {"rent", "click", "plain"}
    rent, click, plain = got["rent"], got["click"], got["plain"]
    assert (rent["title"], rent["rent_eur"], rent["rooms"], rent["area_sqm"]) == ("Trilocale in Corso Prova, 21, Moncalieri", 780, 3, 84)
    assert rent["location_hint"] == "Corso Prova, 21, Moncalieri" and rent["parser"] == "idealista"
    assert (click["rent_eur"], click["rooms"], click["area_sqm"], click["external_id"]) == (640, 3, 66, "tokenNumberO")
    assert click["canonical_url"].startswith("https://www.immobiliare.it/annunci/alert-") and "Aurora" in click["location_hint"]
    assert (plain["canonical_url"], plain["rent_eur"], plain["condo_fee_eur"], plain["source"]) == ("https://www.idealista.it/affitto/808/", 590, 35, "idealista.it")


def test_another_portal_plugs_in(spark):
    """A portal the library does not know, put before the others; one without a parser is not read."""

    def casetta(anchors):
        known = anchors.where(F.contains("href", F.lit("casetta.example/")))
        blank = {n: F.lit(None).cast("string") for n in ("external_id", "location_hint")} | {n: F.lit(None).cast("double") for n in ("area_sqm", "rooms")} | {"condo_fee_eur": F.lit(None).cast("int")}
        facts = {"canonical_url": F.col("href"), "listing_url": F.col("href"), "source": F.lit("casetta"), "title": F.col("text"), "rent_eur": F.regexp_extract("block", r"(\d+) €", 1).cast("int"), "raw_snippet": F.col("block")}
        return known.withColumns(blank | facts).select("message_id", "received_at", "sale", "sender", *mail.DRAFT_COLUMNS)

    own = mail.Parser("casetta", lambda sender, subject: F.contains(sender, F.lit("@casetta")), casetta)
    html = "<p><a href='https://casetta.example/9'>Bilocale</a> 610 €</p><p><a href='https://other.example/'>x</a></p>"
    rows = messages(spark).unionByName(spark.createDataFrame([("new", "alert", "x@casetta.example", html, ""), ("null", None, None, html, "")], messages(spark).schema))
    got = {r["message_id"]: r for r in mail.drafts(rows, [own, *mail.PARSERS]).collect()}
    assert set(got) == {"rent", "click", "plain", "new"}
    assert (got["new"]["parser"], got["new"]["title"], got["new"]["rent_eur"], got["new"]["canonical_url"]) == ("casetta", "Bilocale", 610, "https://casetta.example/9")
    assert got["rent"]["parser"] == "idealista"
    assert [r["message_id"] for r in mail.drafts(rows, [own]).collect()] == ["new"]


def test_blocks_need_nesting():
    html = "<table><tr><td><div><p><a href='/immobile/1'>x<b>y</b></a></p> far</div>700 € <i>60 m²</i><td>other</table>"
    (_, href, text, block), = dom.scan("idealista", html)
    assert (href, text, block) == ("/immobile/1", "xy", "xy far700 € 60 m²")
    (_, _, _, block), = dom.scan("idealista", "<table><tr><td><a href='/immobile/1'>x</a> no facts</table> tail")
    assert block == "x no facts"


def posts_of(spark, html):
    pages = spark.createDataFrame([("p", "999", html, dt.datetime(2024, 1, 1))], "page_id string, group_id string, html string, scraped_at timestamp")
    return [(r["post_id"], r["permalink"], r["message"]) for r in feed.posts_of_pages(pages).orderBy("pos").collect()]


def test_feed_pages(spark):
    link = "https://www.facebook.com/groups/999/posts/{}/".format
    article = '<div class="k" role="article"><span>Ciao</span> <a href="/groups/999/posts/{}/?s=2">{}</a></div>\n'.format
    assert posts_of(spark, article(41, "Cerco &amp; trovo, dov&#39;è?")) == [("41", link(41), "Ciao Cerco & trovo, dov'è?")]
    outside = '<div role="article">solo testo</div><p><a href="https://www.facebook.com/groups/999/posts/52/?from=a&amp;b=1">vai</a></p>'
    assert posts_of(spark, outside)[0][:2] == ("52", link(52))
    assert posts_of(spark, '<div role="article">solo testo</div>') == []
    assert [p[0] for p in posts_of(spark, article(6, "uno") + article(6, "due") + article(7, "tre"))] == ["6", "7"]
    assert posts_of(spark, '<div role="article">vedi /groups/999/posts/63/ in breve</div>')[0][1] == link(63)


def test_post_drafts(spark):
    rows = [
        (1, "https://www.facebook.com/groups/1/posts/1/", "Si affitta casa 92 mq a Cenisia, Torino, 880€/mese. Foto: https://www.idealista.it/immobile/7002/, a presto"),
        (2, "https://www.facebook.com/groups/1/posts/2/", "Affitto monolocale 430 € in zona San Donato, da maggio"),
        (3, "p", "breve"),
    ]
    got = {r["post_id"]: r for r in feed.post_drafts(spark.createDataFrame(rows, "post_id int, permalink string, message string")).collect()}
    assert set(got) == {1, 2}
    assert got[1]["canonical_url"] == "https://www.idealista.it/immobile/7002/" and got[1]["rent_eur"] == 880 and got[1]["area_sqm"] == 92
    assert got[2]["canonical_url"].endswith("/posts/2/") and got[2]["location_hint"] == "San Donato"


def replay(rows, table):
    """The order-dependent rule, one draft at a time."""
    held = {u: [f, (0, s, u)] for u, f, s in table}
    out = {}
    for n, (key, _, url, f) in enumerate(sorted(rows, key=lambda r: (r[1], r[0]))):
        hits = [(held[v][1], v) for v in held if f is not None and held[v][0] == f]
        target = url if url in held else (min(hits)[1] if hits else None)
        if target is None:
            held[url] = [f, (1, n, url)]
        elif f is not None:
            held[target][0] = f
        out[key] = (target or url, target is None)
    return out


@pytest.mark.parametrize("seed,n_urls,n_keys,n_rows", [(1, 15, 4, 90), (5, 40, 3, 90), (9, 8, 6, 90), (2, 150, 9, 900)])
def test_two_key_identity_equals_replay(spark, seed, n_urls, n_keys, n_rows):
    rng, start = random.Random(seed), dt.datetime(2024, 1, 1)
    known = [None, *(f"f{i}" for i in range(n_keys))]
    rows = [(i, start + dt.timedelta(hours=rng.randint(0, 90)), f"u{rng.randrange(n_urls)}", rng.choice(known)) for i in range(n_rows)]
    table = [("u100", "f0", start - dt.timedelta(days=2)), ("u3", "f1", start - dt.timedelta(days=3)), ("u101", "f1", start - dt.timedelta(days=1)), ("u102", None, start)]
    drafts = spark.createDataFrame(rows, "draft_key int, seen_at timestamp, canonical_url string, fingerprint string")
    listings = spark.createDataFrame(table, "canonical_url string, listing_fingerprint string, first_seen_at timestamp")
    rows_in_order, total = numbered(drafts, "seen_at", "draft_key")
    got = {r["draft_key"]: (r["target_url"], r["opens"]) for r in upsert.resolve(rows_in_order, listings, total).collect()}
    assert got == replay(rows, table)


def draft(key, day, url, rent, title="Bilocale via Roma 1", **more):
    return {"draft_key": key, "seen_at": dt.datetime(2024, 1, day), "canonical_url": url, "rent_eur": rent, "title": title, "rooms": 2.0, "area_sqm": 60.0, **more}


SCHEMA = "draft_key string, seen_at timestamp, canonical_url string, rent_eur int, title string, rooms double, area_sqm double, condo_fee_eur int, listing_url string"


def test_merge_tracks_prices_and_other_urls(spark):
    first = spark.createDataFrame([draft("a", 1, "https://x.it/1", 600, condo_fee_eur=50)], SCHEMA)
    one = upsert.merge(upsert.empty_listings(spark), first)
    row = one.listings.first()
    assert (row["rent_eur"], row["total_cost_eur"], row["listing_fingerprint"]) == (600, 650, "via-roma-1|r2|a60|€600")
    more = spark.createDataFrame([
        draft("b", 2, "https://y.it/9", 600, "Bilocale lungo via Roma 1 centro", listing_url="https://www.idealista.it/immobile/9"),
        draft("c", 3, "https://x.it/1", 650), draft("d", 4, "https://y.it/9", 650), draft("e", 5, "https://z.it/5", 900, "Altro via Po 3"),
    ], SCHEMA)
    two = upsert.merge(one.listings, more)
    rows = {r["canonical_url"]: r for r in two.listings.collect()}
    assert set(rows) == {"https://x.it/1", "https://z.it/5"}
    kept = rows["https://x.it/1"]
    assert (kept["rent_eur"], kept["condo_fee_eur"], kept["total_cost_eur"]) == (650, 50, 650)
    assert kept["price_changed_at"] == dt.datetime(2024, 1, 3) and kept["last_seen_at"] == dt.datetime(2024, 1, 4)
    assert kept["title"] == "Bilocale lungo via Roma 1 centro" and kept["listing_url"].endswith("/9")
    changes = {r["draft_key"]: (r["is_new"], r["price_changed"], r["material_changed"]) for r in two.changes.collect()}
    assert changes == {"b": (False, False, False), "c": (False, True, True), "d": (False, False, False), "e": (True, False, False)}
    assert [(r["alternate_url"]) for r in two.alternate_urls.collect()] == ["https://y.it/9"]


def test_merge_again_changes_nothing(spark):
    rows = spark.createDataFrame([draft("a", 1, "https://x.it/1", 600), draft("b", 2, "https://x.it/1", 620), draft("c", 2, "https://w.it/1", 500, "via Po 2")], SCHEMA)
    once = upsert.merge(upsert.empty_listings(spark), rows).listings
    again = upsert.merge(once, rows.where("draft_key <> 'a'")).listings
    assert sorted(map(tuple, once.collect()), key=str) == sorted(map(tuple, again.collect()), key=str)


def test_neighbours_equal_windows(spark):
    rng = random.Random(3)
    rows = [(i, "hot" if rng.random() < 0.6 else f"k{rng.randrange(5)}", rng.choice([None, *range(5)])) for i in range(400)]
    df = spark.createDataFrame(rows, "pos int, k string, v int")
    chunk = F.shiftright("pos", 4)
    got = {r["pos"]: (r["prev_v"], r["next_v"]) for r in with_next(with_previous(df, ["k"], chunk, ["pos"], ["v"]), ["k"], chunk, ["pos"], ["v"]).collect()}
    for pos, key, _ in rows:
        same = [(p, v) for p, k, v in rows if k == key and v is not None]
        before, after = [v for p, v in same if p < pos], [v for p, v in same if p > pos]
        assert got[pos] == (before[-1] if before else None, after[0] if after else None)


def test_duplicate_links(spark):
    day = dt.datetime(2024, 1, 1)
    rows = [("b", "k", day, None, None), ("a", "k", day + dt.timedelta(1), None, None), ("c", "k", day, None, day), ("d", "solo", day, "b", None)]
    df = spark.createDataFrame(rows, "id string, property_match_key string, first_seen_at timestamp, possible_duplicate_of_id string, dismissed_at timestamp")
    got = {r["id"]: (r["possible_duplicate_of_id"], r["link_changed"]) for r in reconcile(df).collect()}
    assert got == {"b": (None, False), "a": ("b", True), "c": (None, False), "d": (None, True)}


def test_chunk_ends_join_rows_where_they_lie(spark, tmp_path):
    rows = spark.createDataFrame([(k, i, i * 10) for i, k in enumerate(["a", "b", "a", None, "b", "a"])], "k string, pos long, v int")
    path = str(tmp_path / "rows")
    rows.write.parquet(path)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = with_previous(spark.read.parquet(path), ["k"], F.floor(F.col("pos") / 2), ["pos"], ["v"])
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert {r["pos"]: r["prev_v"] for r in found.collect() if r["k"]} == {0: None, 1: None, 2: 0, 4: 10, 5: 20}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # all rows, their ends by chunk, these by key, and back: rows themselves move once
    assert plan.count("Exchange hashpartitioning") == 4 and "isnull(_chunk" not in plan


def test_anchors_go_out_in_small_frames(monkeypatch):
    import pandas as pd

    from rentlake.operators import anchors

    body = "".join(f'<a href="/x/{i}">t {i}</a>' for i in range(7))
    rows = [(i, dt.datetime(2024, 3, 1), "s", "f", "r", False, "every", body) for i in range(50)]
    batch = pd.DataFrame(rows, columns=["message_id", "received_at", "subject", "sender", "route", "sale", "scan", "body"])
    monkeypatch.setattr(anchors, "_FRAME", 20, raising=False)
    frames = list(anchors._scan_batches(iter([batch, batch.head(0)])))
    assert max(map(len, frames)) <= 26
    assert [(r.message_id, r.pos) for f in frames for r in f.itertuples()] == [(i, p) for i in range(50) for p in range(7)]
