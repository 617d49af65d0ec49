"""Landings and ledgers by day: what is read, and that nothing is processed twice."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from rentlake import criteria
from rentlake.operators.ledger import Ledger
from rentlake.sources import landing
from rentlake.sources.store import Store
from rentlake.streaming import feeds
from tests.test_operators import messages

SCHEMA = "id string, at timestamp, note string"


def at(day, hour=0):
    return dt.datetime(2024, 3, day, hour)


def rows(spark, *values):
    return spark.createDataFrame([(i, t, "x") for i, t in values], SCHEMA)


def ids(df):
    return sorted(r["id"] for r in df.collect())


def partition_filters(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line.split("PartitionFilters: ")[1].split("]")[0] for line in plan.split("\n") if "PartitionFilters: " in line]


def test_landing_reads_the_days_of_the_lookback(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    landing.land(store, "m", 1, rows(spark, *[(f"d{d}", at(d, 12)) for d in range(1, 20)], ("none", None)), "at")
    landing.land(store, "m", 2, rows(spark, ("late", at(18, 1)), ("edge", at(17, 22)), ("before", at(17, 21))), "at")
    found = landing.landed_since(store, "m", SCHEMA, "at", "2024-03-19 00:00:00", 26)
    assert ids(found) == ["d18", "d19", "edge", "late"]
    assert found.columns == ["id", "at", "note"]
    assert {f.split("day=")[1][:10] for f in found.inputFiles()} == {"2024-03-17", "2024-03-18", "2024-03-19"}
    assert all("day" in f for f in partition_filters(found)) and partition_filters(found)
    assert ids(landing.landed_since(store, "nothing", SCHEMA, "at", "2024-03-19 00:00:00", 26)) == []
    # a landing that runs again replaces its rows on all days, and a broken one is not read
    landing.land(store, "m", 2, rows(spark, ("late", at(19, 1))), "at")
    assert ids(landing.landed_since(store, "m", SCHEMA, "at", "2024-03-19 00:00:00", 26)) == ["d18", "d19", "late"]
    broken = rows(spark, ("b", at(19))).withColumn("note", F.when(F.rand(1) >= 0, F.raise_error(F.lit("lost"))).cast("string"))
    with pytest.raises(Exception, match="lost"):
        landing.land(store, "m", 3, rows(spark, ("b0", at(18))).unionByName(broken), "at")
    assert store.versions("m") == [1, 2] and "b0" not in ids(store.read_all("m", SCHEMA))
    landing.land(store, "m", 3, rows(spark, ("b1", at(19))), "at")
    assert store.versions("m") == [1, 2, 3] and ids(store.read("m", SCHEMA)) == ["b1"]
    assert len(ids(store.read_all("m", SCHEMA, before=3))) == 21


def test_ledger_reads_the_days_of_the_batch_and_knows_all_ids(spark, tmp_path):
    ledger = Ledger(Store(spark, str(tmp_path)), "l", SCHEMA, "id", "at", buckets=16, fold_every=3)
    for version in range(1, 8):
        ledger.write(version, rows(spark, *[(f"{version}-{n}", at(version, n)) for n in range(4)]))
    ledger.write(8, rows(spark, ("undated", None), (None, at(8)), ("twice", at(2)), ("twice", at(3))))
    batch = rows(
        spark, ("7-1", at(7, 1)), ("new", at(7, 2)), ("new", at(7, 2)), ("1-2", at(7, 3)), ("undated", at(6)), ("2-1", None), ("fresh", None),
        (None, at(7)), ("twice", at(7)),
    )
    near = ledger.near(batch)
    assert {f.split("day=")[1].split("/")[0] for f in near.inputFiles()} == {"2024-03-06", "2024-03-07", "__HIVE_DEFAULT_PARTITION__"}
    assert all("day" in f for f in partition_filters(near))
    known = ledger.unseen(batch)
    assert sorted(r["id"] or "" for r in known.collect()) == ["", "fresh", "new", "new"]
    assert sorted(r["id"] or "" for r in ledger.unseen(batch, before=7).collect()) == ["", "7-1", "fresh", "new", "new", "twice", "undated"]
    assert ids(ledger.unseen(batch.limit(0))) == []
    # adding a version again replaces it
    ledger.write(8, rows(spark, ("undated", at(5))))
    assert sorted(r["id"] or "" for r in ledger.unseen(batch).collect()) == ["", "fresh", "new", "new", "twice"]


def test_messages_stream_parses_each_message_once(spark, tmp_path):
    store, c = Store(spark, str(tmp_path / "tables")), criteria.load()
    mails = messages(spark).selectExpr("*", "timestamp'2024-03-01 10:00:00' as received_at")
    schema = ", ".join(f"{n} {t}" for n, t in mails.dtypes)
    moved = mails.withColumn("received_at", F.lit("2024-03-20 10:00:00").cast("timestamp"))  # come back under another time
    for i, part in enumerate((mails.where("message_id <> 'rent'"), mails.unionByName(mails), moved)):
        part.coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
        feeds.message_stream(feeds.landed(spark, str(tmp_path / "in/*"), schema), store, str(tmp_path / "checkpoint"), c)
    whole = feeds.message_batch(mails, c)
    drafts = store.read_all("message_drafts", ", ".join(f"{n} {t}" for n, t in whole.dtypes))
    assert sorted(r["draft_key"] for r in drafts.collect()) == sorted(r["draft_key"] for r in whole.collect()) != []
    assert store.read_all("seen_messages", "message_id string").count() == mails.count()
