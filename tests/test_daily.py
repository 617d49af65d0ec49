"""A whole run over stored tables, twice."""

import datetime as dt

from rentlake import criteria
from rentlake.operators.upsert import LISTING_SCHEMA
from rentlake.plans import daily
from rentlake.sources.store import Store
from tests.test_operators import messages

POST = "Affitto trilocale 75 mq in Cenisia, via Po 4, Torino. 750 €/mese e 3 locali, libero subito"


def test_two_runs(spark, tmp_path):
    c = criteria.load()
    root = str(tmp_path / "tables")
    mails = messages(spark).selectExpr("*", "timestamp'2024-03-01 10:00:00' as received_at")
    posts = spark.createDataFrame(
        [("7", "1", "https://www.facebook.com/groups/1/posts/7/", POST, dt.datetime(2024, 3, 1, 9)), ("8", "1", "p", "solo studenti, posto letto 300 €", dt.datetime(2024, 3, 1, 9))],
        "post_id string, group_id string, permalink string, message string, posted_at timestamp",
    )
    points = spark.createDataFrame([("corso prova 21 moncalieri torino italy", 45.09, 7.64)], "query_key string, lat double, lng double")
    none = points.limit(0)
    first = daily.run(spark, root, 1, mails, posts, c, "2024-03-01 12:00:00", points, none)
    assert first["messages_processed"] == 4 and first["listings_new"] == first["listings_scored"] == first["listings_parsed"]
    store = Store(spark, root)
    listings = {r["canonical_url"]: r for r in store.read("listings", LISTING_SCHEMA).collect()}
    assert listings["https://www.idealista.it/immobile/7001/"]["distance_to_ref_m"] > 0
    assert store.read("post_ledger", daily.POST_LEDGER).where("listings_found = 0").count() == 1
    cards = spark.read.parquet(store.path("digest_cards", 1)).orderBy("position").collect()
    assert cards[0]["text"].startswith("📅 01/03/2024\nNew: ") and len(cards) > 1
    second = daily.run(spark, root, 2, mails, posts, c, "2024-03-01 15:00:00", points, none)
    assert (second["messages_processed"], second["listings_parsed"], second["listings_scored"]) == (0, 0, 0)
    assert store.versions("listings") == [1, 2]


def test_sent_cards_come_back_only_after_a_price_change(spark, tmp_path):
    c, root = criteria.load(), str(tmp_path / "tables")
    store, none = Store(spark, root), spark.createDataFrame([], "query_key string, lat double, lng double")
    posts = spark.createDataFrame([], "post_id string, group_id string, permalink string, message string, posted_at timestamp")
    first = messages(spark).selectExpr("*", "timestamp'2024-03-01 10:00:00' as received_at")
    dearer = first.where("message_id = 'rent'").selectExpr(
        "'rent2' as message_id", "subject", "from_address", "replace(html_body, '780', '760') as html_body", "text_body", "timestamp'2024-03-01 17:00:00' as received_at"
    )

    def cards(version):
        return {r["listing_id"]: r["text"] for r in spark.read.parquet(store.path("digest_cards", version)).where("listing_id is not null").collect()}

    daily.run(spark, root, 1, first, posts, c, "2024-03-01 12:00:00", none, none)
    sent = list(cards(1))
    listing = {r["canonical_url"]: r["id"] for r in store.read("listings", LISTING_SCHEMA).collect()}["https://www.idealista.it/immobile/7001/"]
    assert listing in sent
    receipts = spark.createDataFrame([(i, dt.datetime(2024, 3, 1, 12, 5), "m") for i in sent], "listing_id string, sent_at timestamp, message_id string")
    again = daily.run(spark, root, 2, first, posts, c, "2024-03-01 15:00:00", none, none, receipts=receipts)
    assert again["cards_sent"] == 0 and cards(2) == {}
    third = daily.run(spark, root, 3, first.unionByName(dearer), posts, c, "2024-03-01 18:00:00", none, none)
    assert list(cards(3)) == [listing] and "760" in cards(3)[listing] and third["messages_processed"] == 1
    # history is appended, not rewritten
    assert store.read("message_ledger", daily.MESSAGE_LEDGER).count() == 1 and store.read_all("message_ledger", daily.MESSAGE_LEDGER).count() == 5
    assert {r["status"] for r in store.read_all("runs", daily.RUNS).collect()} == {"completed"}
    gone = spark.createDataFrame([(listing,)], "listing_id string")
    daily.run(spark, root, 4, first, posts, c, "2024-03-01 21:00:00", none, none, dismissed=gone)
    assert cards(4) == {}
    # an old version run again reads what it read then
    daily.run(spark, root, 2, first, posts, c, "2024-03-01 15:00:00", none, none, receipts=receipts)
    assert cards(2) == {}


def test_failed_run_is_recorded(spark, tmp_path):
    store = Store(spark, str(tmp_path / "tables"))
    bad = spark.createDataFrame([("m",)], "message_id string")
    try:
        daily.run(spark, store.root, 1, bad, bad, criteria.load(), "2024-03-01 12:00:00", bad, bad)
    except Exception:
        pass
    row = store.read_all("runs", daily.RUNS).first()
    assert row["status"] == "failed" and row["error_message"]
