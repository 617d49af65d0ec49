"""Tables that batches change in place, against the same work on whole tables."""

import datetime as dt
import random

from pyspark.sql import functions as F

from rentlake.operators import duplicates, upsert
from rentlake.operators.increments import Listings
from rentlake.sources.keyed import Keyed
from rentlake.sources.store import Store
from rentlake.streaming import feeds
from tests.test_operators import SCHEMA


def test_keyed_table_over_fifty_batches(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    table = Keyed(store, "t", "k string, g string, n int", ["k", "g"], by="g", buckets=3, fold_every=5)
    rng, held, after = random.Random(7), {}, {}
    for version in range(1, 51):
        put = {(f"k{rng.randrange(30)}", f"g{rng.randrange(6)}"): rng.randrange(1000) for _ in range(4)}
        gone = {key for key in rng.sample(sorted(held), min(2, len(held))) if key not in put}
        rows = spark.createDataFrame([(*k, n) for k, n in put.items()], table.schema)
        table.write(version, rows, spark.createDataFrame(sorted(gone), "k string, g string") if gone else None)
        held = {k: n for k, n in (held | put).items() if k not in gone}
        after[version] = (held, rows, gone)
        assert len(store.versions("t")) <= 2 * 5 and len(store.versions("t_base")) <= 2
        if version % 25 in (0, 3):
            assert {(r.k, r.g): r.n for r in table.read().collect()} == held
    found = table.lookup(spark.createDataFrame([("g1",), ("g4",), (None,), ("none",)], "g string"))
    assert {(r.k, r.g): r.n for r in found.collect()} == {k: n for k, n in held.items() if k[1] in ("g1", "g4")}
    # the batch before runs again: it reads what it read then, and leaves the same table
    held, rows, gone = after[50]
    assert {(r.k, r.g): r.n for r in table.read(before=50).collect()} == after[49][0]
    table.write(50, rows, spark.createDataFrame(sorted(gone), "k string, g string") if gone else None)
    assert {(r.k, r.g): r.n for r in table.read().collect()} == held


def test_lookup_reads_only_the_parts_it_needs(spark, tmp_path):
    table = Keyed(Store(spark, str(tmp_path)), "t", "k int, n int", ["k"], buckets=16, fold_every=2)
    for version in (1, 2, 3):
        table.write(version, spark.range(200).select(F.col("id").cast("int").alias("k"), F.lit(version).alias("n")))
    found = table.lookup(spark.createDataFrame([(5,)], "k int"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.split("\n") if "PartitionFilters" in line]
    assert scans and all("bucket" in line.split("PartitionFilters")[1] for line in scans)
    assert [tuple(r) for r in found.collect()] == [(5, 3)]


def test_few_parts_are_written_by_many_tasks(spark, tmp_path):
    """As many as a large batch needs; a small one is still one file a part."""
    table = Keyed(Store(spark, str(tmp_path)), "t", "k int, n int", ["k"], buckets=2)
    rows = spark.range(2000).select(F.col("id").cast("int").alias("k"), F.lit(1).alias("n"))
    files = lambda version: len(spark.read.parquet(table.store.path("t", version)).inputFiles())
    table.write(1, rows)
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesce, "false")  # as if its rows were too many to be coalesced
    try:
        table.write(2, rows)
    finally:
        spark.conf.set(coalesce, "true")
    assert files(1) == 2 and files(2) > 4
    assert table.read().count() == 2000


def test_a_read_of_some_columns_reads_no_others(spark, tmp_path):
    table = Keyed(Store(spark, str(tmp_path)), "t", "k int, n int, wide string", ["k"], buckets=2)
    for version in (1, 2):
        table.write(version, spark.range(version, 4).selectExpr("cast(id as int) as k", f"{version} as n", "'w' as wide"), spark.range(1).selectExpr("cast(id as int) as k"))
    some = table.read().select("k", "n")
    assert "wide" not in some._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, some.collect())) == [(1, 1), (2, 2), (3, 2)]


def drafts(spark, rng, batch, n):
    rows = []
    for i in range(n):
        street, rent = rng.choice(["Roma 1", "Po 3", "Garibaldi 9"]), rng.choice([500, 500, 650, None])
        day = dt.datetime(2024, 1, 1) + dt.timedelta(hours=40 * batch + rng.randrange(40))
        rows.append((f"{batch}-{i}", day, f"https://x.it/{rng.randrange(25)}", rent, f"Bilocale via {street}", 2.0, rng.choice([60.0, 70.0]), None, None))
    return spark.createDataFrame(rows, SCHEMA)


def facts(listings):
    return sorted((r.asDict() for r in listings.collect()), key=lambda r: r["canonical_url"])


def test_merge_by_batches_equals_merge_of_the_whole(spark, tmp_path):
    rng, store = random.Random(11), Store(spark, str(tmp_path))
    table, whole = Listings(store, buckets=4, fold_every=2), upsert.empty_listings(spark)
    seen = {}
    for batch in range(1, 4):
        rows = drafts(spark, rng, batch, 22 if batch < 3 else 1)
        merged = table.merge(batch, rows)
        plain = upsert.merge(whole, rows)
        changes = lambda m: sorted(map(tuple, m.changes.collect()))
        assert changes(merged) == changes(plain)
        whole = duplicates.reconcile(duplicates.backfill_match_keys(plain.listings)).drop("link_changed")
        whole = spark.createDataFrame(whole.collect(), upsert.LISTING_SCHEMA)
        assert facts(table.rows.read()) == facts(whole)
        seen[batch] = rows
    # one draft, one written row (and the rows it links anew): not the table
    assert spark.read.parquet(store.path("listing_rows", 3)).count() < whole.count() / 3
    # a batch that runs again
    table.merge(3, seen[3])
    assert facts(table.rows.read()) == facts(whole)


def test_links_follow_deletes_new_keys_and_dismissals(spark, tmp_path):
    table = Listings(Store(spark, str(tmp_path)), buckets=4, fold_every=3)
    day = lambda n: dt.datetime(2024, 1, n)
    some = spark.createDataFrame([(f"u{i}", f"i{i}", f"k{i % 3}" if i % 7 else None, day(1 + i % 5), None) for i in range(24)], "canonical_url string, id string, property_match_key string, first_seen_at timestamp, dismissed_at timestamp")
    rows = upsert.empty_listings(spark).unionByName(some, allowMissingColumns=True)
    whole = duplicates.reconcile(rows).drop("link_changed")
    table.put(1, rows.limit(0), rows)
    assert facts(table.rows.read()) == facts(whole)
    oldest = {r.property_match_key: r.primary_id for r in duplicates.primaries(whole).collect()}
    changes = {
        2: lambda r: r.withColumn("dismissed_at", F.when(F.col("id") == oldest["k0"], F.lit(day(9))).otherwise(F.col("dismissed_at"))),
        3: lambda r: r.where(F.col("id") != oldest["k1"]),
        4: lambda r: r.withColumn("property_match_key", F.when(F.col("id").isin(oldest["k2"], "i3"), "k1").otherwise(F.col("property_match_key"))),
        5: lambda r: r.withColumn("dismissed_at", F.lit(None).cast("timestamp")),
    }
    for version, change in changes.items():
        stored = table.rows.read()
        changed = change(stored)

        touched = spark.createDataFrame(sorted({r["canonical_url"] for r in stored.exceptAll(changed).collect()}), "string").toDF("canonical_url")
        before = stored.join(touched, "canonical_url", "left_semi").select(*stored.columns)
        after = changed.join(touched, "canonical_url", "left_semi").select(*stored.columns)
        whole = duplicates.reconcile(change(spark.createDataFrame(whole.collect(), upsert.LISTING_SCHEMA))).drop("link_changed")
        table.put(version, before, after)
        assert facts(table.rows.read()) == facts(whole), version


def test_price_state_stays_bounded(spark, tmp_path, monkeypatch):
    """Many small batches: the events of a window over all, from a base and few changes."""
    monkeypatch.setattr(feeds, "Keyed", lambda *a: Keyed(*a, buckets=2, fold_every=3))
    rng, store = random.Random(3), Store(spark, str(tmp_path / "tables"))
    rows, schema = [], "listing_key string, obs_id string, observed_at timestamp, rent_eur int"
    for batch in range(6):
        own = [(rng.choice([None, "a", "b", "c", "d"]) if batch == 3 else rng.choice("abcd"), f"{batch}-{i}", dt.datetime(2024, 1, 1 + batch, i), rng.choice([None, 500, 500, 600])) for i in range(5)]
        rows += own
        spark.createDataFrame(own, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{batch}"))
        feeds.price_changes(feeds.landed(spark, str(tmp_path / "in/*"), schema), store, str(tmp_path / "checkpoint"))
    assert len(store.versions("price_state")) <= 6 and len(store.versions("price_state_base")) <= 2
    want, last = [], {}
    for key, obs, at, rent in sorted((r for r in rows if r[0]), key=lambda r: (r[2], r[1])):
        if rent is not None:
            if key in last and last[key] != rent:
                want.append((key, obs, last[key], rent))
            last[key] = rent
    events = store.read_all("price_events", "listing_key string, obs_id string, observed_at timestamp, prev_rent int, rent_eur int")
    assert sorted((e.listing_key, e.obs_id, e.prev_rent, e.rent_eur) for e in events.where("listing_key is not null").collect()) == sorted(want)
