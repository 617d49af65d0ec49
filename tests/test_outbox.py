"""Cards are sent the right number of times, whatever is repeated or late."""

import datetime as dt
import random

from rentlake import criteria
from rentlake.operators.outbox import EVENT, Outbox
from rentlake.operators.upsert import LISTING_SCHEMA
from rentlake.plans import daily
from rentlake.sources.store import Store
from rentlake.streaming import feeds
from tests.test_operators import messages

NOW = "2024-03-02 00:00:00"


def at(hour):
    return dt.datetime(2024, 3, 1, hour)


def chosen(listing, price_hour=None):
    return listing, "chosen", at(1), None if price_hour is None else at(price_hour)


def test_stream_sends_each_card_once_a_reason(spark, tmp_path):
    store = Store(spark, str(tmp_path / "tables"))
    outbox = Outbox(store, buckets=2, fold_every=2)

    def landing(name, *rows):
        """Cards that this landing makes go out."""
        spark.createDataFrame(list(rows), EVENT).coalesce(1).write.parquet(str(tmp_path / "in" / name))
        before = set(store.versions("sends"))
        feeds.send_cards(feeds.landed(spark, str(tmp_path / "in" / "*"), EVENT), outbox, str(tmp_path / "checkpoint"), NOW)
        new = sorted(set(store.versions("sends")) - before)
        return sorted((r["listing_id"], r["reason"]) for v in new for r in spark.read.parquet(store.path("sends", v)).collect())

    assert landing("1", chosen("a"), chosen("b"), chosen("b"), chosen("c", 2), (None, "chosen", at(1), None)) == [("a", "first"), ("b", "first"), ("c", "first")]
    # the run is repeated: nothing more
    assert landing("2", chosen("a"), chosen("b"), chosen("c", 2)) == []
    # receipts; a listing is dismissed before it is chosen, another one in the same batch
    assert landing("3", ("a", "sent", at(3), None), ("b", "sent", at(3), None), ("d", "dismissed", at(3), None), chosen("e"), ("e", "dismissed", at(3), None)) == []
    assert landing("4", chosen("d"), chosen("a", 4), chosen("b", 2)) == [("a", "price")]  # b's price changed before it was sent
    # a second price change before the receipt of the first, which comes late
    assert landing("5", chosen("a", 6)) == [("a", "price")]
    assert landing("6", ("a", "sent", at(5), None), chosen("a", 6), chosen("a", 4)) == []
    # two changes at once make one card
    assert landing("7", ("a", "sent", at(7), None), chosen("a", 8), chosen("a", 9)) == [("a", "price")]
    assert landing("8", ("a", "dismissed", at(9), None), chosen("a", 10)) == []


def test_repeated_versions_and_retries(spark, tmp_path):
    outbox = Outbox(Store(spark, str(tmp_path)), retry_minutes=60, attempts=2, buckets=2)
    events = lambda *rows: spark.createDataFrame(list(rows), EVENT)
    cards = lambda rows: sorted((r["listing_id"], r["tries"]) for r in rows.collect())
    outbox.take(1, events(chosen("a"), chosen("b"), chosen("c")))
    for _ in range(2):
        assert cards(outbox.hand_out(2, "2024-03-01 02:00:00", events(("c", "dismissed", at(2), None)))) == [("a", 1), ("b", 1)]
    assert cards(outbox.hand_out(3, "2024-03-01 02:30:00")) == []
    outbox.take(4, events(("b", "sent", at(3), None)))
    assert cards(outbox.hand_out(5, "2024-03-01 03:00:00")) == [("a", 2)]
    assert cards(outbox.hand_out(6, "2024-03-01 09:00:00")) == []
    assert cards(outbox.take_and_hand_out(7, events(), NOW)) == []


def test_random_events_equal_a_replay(spark, tmp_path):
    rng, known = random.Random(7), {}
    outbox = Outbox(Store(spark, str(tmp_path)), buckets=3, fold_every=3)
    for version in range(1, 7):
        rows = [(rng.choice("abcdefgh"), rng.choice(["chosen", "chosen", "chosen", "sent", "dismissed"] if version > 3 else ["chosen", "sent"]), at(rng.randrange(24)), rng.choice([None, at(rng.randrange(24))])) for _ in range(8)]
        due = []
        for listing in sorted({r[0] for r in rows}):
            own = [r for r in rows if r[0] == listing]
            job = known.setdefault(listing, {"reasons": [], "sent": [], "gone": False, "handed": False})
            new = [r[3] or dt.datetime.min for r in own if r[1] == "chosen"]
            if new and (not job["reasons"] or max(new) > max(job["reasons"])):
                job["handed"] = False
            job["reasons"] += new
            job["sent"] += [r[2] for r in own if r[1] == "sent"]
            job["gone"] |= any(r[1] == "dismissed" for r in own)
            stale = job["sent"] and max(job["sent"]) >= max(job["reasons"] or [dt.datetime.min])
            if job["reasons"] and not (job["gone"] or stale or job["handed"]):
                job["handed"] = True
                due.append(listing)
        assert sorted(r["listing_id"] for r in outbox.take_and_hand_out(version, spark.createDataFrame(rows, EVENT), NOW).collect()) == due


def test_run_and_send(spark, tmp_path):
    c, store = criteria.load(), Store(spark, str(tmp_path))
    none = spark.createDataFrame([], "query_key string, lat double, lng double")
    posts = spark.createDataFrame([], "post_id string, group_id string, permalink string, message string, posted_at timestamp")
    first = messages(spark).selectExpr("*", "timestamp'2024-03-01 10:00:00' as received_at")
    dearer = first.where("message_id = 'rent'").selectExpr(
        "'rent2' as message_id", "subject", "from_address", "replace(html_body, '780', '760') as html_body", "text_body", "timestamp'2024-03-01 17:00:00' as received_at"
    )
    daily.run(spark, store.root, 1, first, posts, c, "2024-03-01 12:00:00", none, none, queue=True)
    daily.run(spark, store.root, 2, first, posts, c, "2024-03-01 12:30:00", none, none, queue=True)
    listing = {r["canonical_url"]: r["id"] for r in store.read("listings", LISTING_SCHEMA).collect()}["https://www.idealista.it/immobile/7001/"]
    queued = {r["listing_id"] for r in spark.read.parquet(store.path("digest_cards", 1)).where("listing_id is not null").collect()}
    late = sorted(queued - {listing})[:1]
    gone = spark.createDataFrame([(i,) for i in late], "listing_id string")
    sends = daily.send(spark, store.root, 3, c, "2024-03-01 13:00:00", dismissed=gone).orderBy("position").collect()
    assert {r["listing_id"] for r in sends} == queued - set(late) and listing in queued
    assert [r["position"] for r in sends] == list(range(len(sends))) and all(r["reason"] == "first" and "🏠" in r["text"] for r in sends)
    assert daily.send(spark, store.root, 4, c, "2024-03-01 13:05:00").count() == 0
    receipts = spark.createDataFrame([(r["listing_id"], dt.datetime(2024, 3, 1, 13, 10), "m") for r in sends], "listing_id string, sent_at timestamp, message_id string")
    daily.run(spark, store.root, 5, first.unionByName(dearer), posts, c, "2024-03-01 18:00:00", none, none, queue=True, receipts=receipts)
    (again,) = daily.send(spark, store.root, 6, c, "2024-03-01 18:05:00").collect()
    assert (again["listing_id"], again["reason"]) == (listing, "price") and "760" in again["text"]


def test_run_from_landed_input(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    none = spark.createDataFrame([], "query_key string, lat double, lng double")
    mails = messages(spark)
    parts = mails.selectExpr("message_id", "array(0) as path", "'text/html' as mime_type", "translate(base64(encode(html_body, 'UTF-8')), '+/', '-_') as data")
    parts = parts.unionByName(mails.selectExpr("message_id", "array(1) as path", "'text/plain' as mime_type", "translate(base64(encode(text_body, 'UTF-8')), '+/', '-_') as data"))
    sent = "struct('date' as name, 'Fri, 1 Mar 2024 10:00:00 +0000' as value)"
    headers = mails.selectExpr("message_id", f"array(struct('Subject' as name, subject as value), struct('From' as name, from_address as value), {sent}) as headers")
    html = "<div role='article'><a href='https://www.facebook.com/groups/1/posts/77/'>Affitto trilocale 75 mq in Cenisia, via Po 4, Torino. 750 €/mese e 3 locali, libero subito</a></div>"
    pages = spark.createDataFrame([("p", "1", dt.datetime(2024, 3, 1, 9), html), ("q", "2", dt.datetime(2024, 3, 1, 9), "")], "page_id string, group_id string, scraped_at timestamp, html string")
    counters = daily.run_landed(spark, store.root, 1, parts, headers, pages, criteria.load(), "2024-03-01 12:00:00", none, none, queue=True)
    # the same run over messages and posts finds as many messages, see test_daily
    assert counters["messages_processed"] == 4 and counters["posts_processed"] == 1 and counters["listings_new"] >= 2
    assert counters["cards_sent"] == daily.send(spark, store.root, 2, criteria.load(), "2024-03-01 12:10:00").count() > 0
