"""Golden values of the column functions."""

import re

from pyspark.sql import functions as F

from rentlake import catalog, criteria, fixed_values
from rentlake.functions import alerts, amounts, keys, places, posts, replies, rules, urls
from tests.helpers import each, each_df


def test_rent_from_text(spark):
    cases = {
        "Affitto 850 €/mese": 850, "Aurora € 640/month": 640, "€ 1,200/month": 1200, "€ 1.200/month": 1200,
        "4 rooms, 2 baths": None, "€ 1.000/month 80 m²": 1000, "€ 1,000/month": 1000, "210.000 € 120 m²": None,
        "98.000 €": None, "800 € al mese": 800, "€ 50.000 senza mese": None, "€ 40 m² a 700 €": 700,
    }
    assert each_df(spark, lambda d: amounts.with_rent(d, "x", "r"), cases) == list(cases.values())


def test_amounts(spark):
    cases = {"1.200": 1200, "1,200": 1200, "1.000": 1000, "": None, "2.500,50": 2501, "1,234.56": 1235, "1.0": 1000, "12abc": 12}
    assert each_df(spark, lambda d: amounts.with_amounts(d, {"r": "x"}), cases) == list(cases.values())


def test_rooms_area_fee(spark):
    cases = {"4 locali nuovi": 4, "104 m² 4 stanze": 4, "66 m² | 3 rooms": 3, "5 camere": 5, "2,5 locali": 2.5, "x": None}
    assert each(spark, amounts.rooms, cases) == list(cases.values())
    assert each(spark, amounts.area, ["66 m²", "104 mq", "x"]) == [66, 104, None]
    assert each(spark, amounts.condo_fee, ["spese condominio 75 euro", "x"]) == [75, None]
    words = {"Monolocale luminoso": 1, "Bilocale": 2, "Trilocale": 3, "Quadrilocale": 4, "Villa": None}
    assert each(spark, amounts.rooms_from_words, words) == list(words.values())


def test_canonical_url(spark):
    cases = {
        "https://www.idealista.it/immobile/7001?utm_term=k": "https://www.idealista.it/immobile/7001",
        "https://www.casa.it/immobili/909/?k=v&utm_medium=m": "https://www.casa.it/immobili/909/",
        "https://casa.it/it/annunci/77?x": "https://www.casa.it/annunci/77/",
        "https://x.it:8080/a?b=1": "https://x.it:8080/a?b=1", "https://x.it:443/a": "https://x.it/a", "http://x.it:80": "http://x.it/", "http://x.it:443/": "http://x.it:443/",
        "https://x.it/a/../b": "https://x.it/b", "https://x.it/../a/./b/..": "https://x.it/a/", "https://x.it/a/%2E%2e/b/.": "https://x.it/b/",
        "https://x.it/affitto/città": "https://x.it/affitto/citt%C3%A0", "https://x.it/a%20b/c d": "https://x.it/a%20b/c%20d", "https://x.it/a?q=due%20locali&r=a+b": "https://x.it/a?q=due+locali&r=a+b",
        "https://x.it/?a=è~*&b=100%&c=a=b": "https://x.it/?a=%C3%A8%7E*&b=100%25&c=a%3Db", "https://x.it/?utm_source=1": "https://x.it/", "https://x.it\\a": "https://x.it/a",
        "not-a-url": None, "HTTPS://Ex.com#top": "https://ex.com/", "http://e.com/a?b&utm_term=1&c=2": "http://e.com/a?b=&c=2",
    }
    assert each(spark, urls.canonical, cases) == list(cases.values())


def test_listing_page(spark):
    cases = {
        "https://www.idealista.it/immobile/1/": True, "https://clicks.immobiliare.it/annunci/1": False, "https://www.click.casa.it/immobili/1": False,
        "https://www.immobiliare.it/affitto-case/torino/": True, "https://www.casa.it/blog/": False, "https://x.org/annunci/1": False,
        "https://www.casa.it/x#/immobili/1": False, None: False,
    }
    assert each(spark, urls.is_listing_page, cases) == list(cases.values())


def test_sources(spark):
    assert each(spark, urls.base_domain, ["clicks.immobiliare.it", "www.m.casa.it.", "m.it", "a.b.c.d"]) == ["immobiliare.it", "casa.it", None, "c.d"]
    assert each(spark, urls.url_score, ["https://clicks.immobiliare.it/x", "https://www.immobiliare.it/annunci/alert-a/", "https://www.idealista.it/immobile/1", "https://www.immobiliare.it/annunci/1", "http://a", "a"]) == [1, 2, 10, 8, 5, 0]


def test_street_key(spark):
    cases = {
        "loft in via inventata 7 aurora torino": "via-inventata-7", "casa via prova, 3 torino": "via-prova-3", "via modello torino": "via-modello",
        "Corso Così, 3B": "via-cosi-3b", "Bilocale Cenisia": None, "ovvia cosa": None,
    }
    assert each(spark, keys.street_key, cases) == list(cases.values())


def test_fingerprints_meet_across_portals(spark):
    rows = spark.createDataFrame(
        [("via Inventata 7, Aurora, Turin", "3-room flat via Inventata 7, Aurora, Turin", 600), ("Via Inventata, 7, Aurora, Torino", "Trilocale in Via Inventata, 7, Aurora, Torino", 600), (None, "Bilocale via Roma 1", 50), (None, "x", None)],
        "hint string, title string, rent int",
    )
    street = keys.street_key(keys.street_text(F.col("hint"), F.col("title"), F.lit(None).cast("string")))
    got = [r[0] for r in rows.select(keys.fingerprint(street, F.col("rent"), F.lit(3.0), F.lit(60.0))).collect()]
    assert got == ["via-inventata-7|r3|a60|€600"] * 2 + [None, None]


def test_places(spark):
    assert each(spark, places.distance_text, [650, 999, 1450, 1250, 1750, 1650, 12250], "int") == ["~650 m", "~999 m", "~1.4 km", "~1.3 km", "~1.8 km", "~1.6 km", "~12.3 km"]
    buckets = ((500, 10), (2000, 5))
    assert each(spark, lambda x: places.distance_score(x, buckets, 5), [100, 500, 501, 9000, -1, None], "int") == [10, 10, 5, 0, 5, 5]
    here = spark.range(1).select(places.haversine_m(F.lit(45.08), F.lit(7.64), F.lit(None).cast("double"), F.lit(7.6))).first()[0]
    assert here is None
    assert each(spark, places.tidy_query, ["Via Roma snc , , Torino", "a s.n.c. b"]) == ["Via Roma, Torino", "a . b"]


def test_alert_predicates(spark):
    assert each(spark, alerts.is_meaningful_title, ["Listing", "Vedi 5 foto", "Trilocale bello", "abc", None]) == [False, False, True, False, False]
    assert each(spark, alerts.idealista_anchor, ["Vedi 5 foto", "Quadrilocale in Corso Prova", "Bella casa in via Roma", "short"]) == [False, True, True, False]
    assert each(spark, lambda x: alerts.is_sale_alert(x, F.lit("")), ["in vendita", "in vendita e in affitto", "ciao"]) == [True, False, False]
    fields = each_df(spark, lambda d: alerts.with_subject_fields(d, "x", "s_").withColumn("r", F.struct("s_title", "s_rent_eur", "s_area_sqm", "s_location_hint")), ["Un nuovo annuncio: 1.310 € | 104 mq | Corso Prova, Moncalieri", "altro"])
    assert tuple(fields[0]) == ("104 m² — Corso Prova, Moncalieri", 1310, 104.0, "Corso Prova, Moncalieri")
    assert tuple(fields[1]) == (None, None, None, None)


def test_post_predicates(spark):
    assert each(spark, posts.is_student, ["Stanza singola per tutti", "vicino università libera", "solo studenti", ""]) == [True, False, True, False]
    cases = {"Affitto bilocale 800 euro zona Cenisia Like Reply See translation": "Affitto bilocale 800 euro zona Cenisia", "short Like Reply rest": "short Like Reply rest", "mi interessa molto questo 4m Like Reply": "mi interessa molto questo 4m"}
    assert each(spark, posts.clean, cases) == list(cases.values())
    assert each(spark, posts.is_conversation, ["mi interessa molto", "mi interessa, 500 €", "sono interessata affitto"]) == [True, False, False]
    assert each(spark, posts.group_ids, ["12, ab abc 12 x-1", "-z a.b"]) == [["12", "abc", "x-1"], ["a.b"]]
    assert each(spark, posts.post_title, ["Ok. Trilocale in centro. Bello", ""]) == ["Trilocale in centro", "Facebook listing"]


def test_replies(spark):
    c = criteria.load()
    texts = ['{"budgetFit":"7.5","sizeForFamily":12,"summary":" hi ","riskLevel":"high","riskReasons":["a"]}', '{"x":1}', "{broken", '{"budgetFit":null}', '{"budgetFit":-3,"summary":5}']
    got = each_df(spark, lambda d: replies.with_result(d, c, "x", "m_").withColumn("r", F.struct("m_composite", "m_summary", "m_risk_level", "m_risk_reasons")), texts)
    assert tuple(got[0]) == (18, "hi", "high", ["a"])
    assert [g[0] for g in got[1:]] == [None, None, None, 0] and got[4][1] is None


def test_criteria_read_at_once_are_those_read_one_by_one(spark):
    odd = ["3.5", '"4"', '" 5 "', "true", "null", '"x"', "[1]", '{"a":1}', "1e400", "-2", "99999999999999999999999", '"NaN"', '"-Infinity"', '""']
    texts = [f'{{"budgetFit":{a},"dataComplete":{b}}}' for a in odd for b in odd[:5]] + ["[1]", "7", "null", '"x"', "{}", '{"note":1}', "{broken", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "x string")
    c = F.col
    got = replies.with_result(rows, criteria.load(), "x", "m_").withColumn("doc", replies.document(c("x"))).cache()
    one = lambda key, kind: F.try_variant_get(c("doc"), f"$.{key}", kind)
    keys = fixed_values.REPLY_KEYS
    want_usable = F.coalesce(*[one(k, "string") for k in keys]).isNotNull()
    want = F.struct(*[replies.clamp10(one(k, "double")).alias(k) for k in keys], F.lit(0).alias("proximityToReference"))
    wrong = got.where(~c("m_usable").eqNullSafe(want_usable) | ~c("m_scores").eqNullSafe(F.when(want_usable, want)) | (replies.criteria_scores(c("doc")) != want))
    assert wrong.select("x", "m_usable", "m_scores").collect() == [] and got.where("m_usable").count() > 50


def test_reply_is_read_in_functions_that_the_jvm_compiles(spark, capsys):
    """The JVM only interprets a method of more than 8,000 bytes; reading key by key took 8,588."""
    catalog.QUERIES["j2_reply_result"](spark, "/root/testdata/sf0.001").explain("codegen")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) < 8000
    rows = spark.range(9).selectExpr("cast(id as string) as x", "cast(id as int) as p")
    replies.with_result(rows, criteria.load(), "x", "m_", F.col("p")).explain("codegen")  # 10,017 before
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) < 8000


def test_rule_score_and_blend(spark):
    c = criteria.load()
    row = spark.range(1).select(rules.rule_score(c, F.lit("cenisia vicino bernini"), F.lit(3.0), F.lit(70.0), F.lit(600), F.lit(100), F.lit(10), F.lit(400)).alias("r")).first()["r"]
    assert row["score"] == 100 and row["risk_level"] == "none" and row["reasons"][-1] == "📍 ~400 m from via Medici (10/10)"
    low = spark.range(1).select(rules.rule_score(c, F.lit("solo whatsapp"), F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(350), F.lit(None).cast("int")).alias("r")).first()["r"]
    assert low["risk_reasons"] == ["messenger-only contact", "anomalously low price"] and low["risk_source"] == "rules" and low["score"] == 25
    blended = spark.range(1).select(rules.blend(c, F.lit(80), F.lit(60)), rules.blend(c, F.lit(80), F.lit(None).cast("int")), rules.blend(c, F.lit(80), F.lit(60), False)).first()
    assert tuple(blended) == (49, 24, 66)


def test_prompt(spark):
    c = criteria.load()
    text = spark.range(1).select(replies.prompt(c, replies.listing_json(F.lit("Trilocale"), F.lit(750), F.lit(None).cast("int"), F.lit(70.0), F.lit(2.5), F.lit(None).cast("string"), F.lit("x")))).first()[0]
    assert '{"title":"Trilocale","rentEur":750,"totalCostEur":750,"areaSqm":70,"rooms":2.5,"snippet":"x"}' in text
    assert "area 50-90 m²" in text and "{{" not in text


def test_spaces_as_the_plain_patterns_take_them(spark):
    import random
    import re

    from rentlake.functions import regex

    rng = random.Random(3)
    odd = " \t\n\r\x0b\x0c\xa0 　﻿ab.€"
    texts = ["", " ", "\t", "a b", " a  b ", None] + ["".join(rng.choice(odd) for _ in range(rng.randrange(12))) for _ in range(400)]
    spaces = re.compile("[ \t\n\x0b\x0c\r" + regex._WIDE + " - ]+")
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", regex.collapse(F.col("t")), regex.strip(F.col("t")), regex.filled(F.col("t"))).collect()
    for t, collapsed, stripped, kept in rows:
        bare = None if t is None else re.sub(rf"\A{spaces.pattern}|{spaces.pattern}\Z", "", t)
        assert collapsed == (None if t is None else spaces.sub(" ", t).strip(" ")) and stripped == bare and kept == (t if bare else None)


def test_prompt_constants_are_put_in_once(spark):
    from dataclasses import replace

    from rentlake import criteria
    from rentlake.functions import replies

    c = criteria.load()
    payloads = ['{"title":"x"}', '{"title":"{{locale}} {{listingJson}}"}', "{}", "{", "{locale}}", None]
    for template in (c.rating_prompt, "{{listingJson}}", "a{{{listingJson}} {{locale}}", "{{lo{{listingJson}}cale}}{{listingJson}}", "none {{locale}}", "{{listingJson}}{locale}} }}"):
        with_template = replace(c, rating_prompt=template)
        rows = spark.createDataFrame([(p,) for p in payloads], "p string")
        plain = replies.fill(template, {"listingJson": F.col("p"), **replies.prompt_values(with_template)})
        assert [r[0] for r in rows.select(replies.prompt(with_template, F.col("p"))).collect()] == [r[0] for r in rows.select(plain).collect()]
    plan = spark.range(1).select(F.col("id").cast("string").alias("p")).select(replies.prompt(c, F.col("p")))._jdf.queryExecution().optimizedPlan().toString()
    head = c.rating_prompt.split("{{listingJson}}")[0]
    for key, value in replies.prompt_values(c).items():
        head = head.replace("{{" + key + "}}", value)
    assert head[-40:] in plan
