"""What a merge leaves on disk, moves and gathers."""

import datetime as dt
import os
import time

from pyspark.sql import functions as F

from rentlake.catalog import views
from rentlake.operators import upsert
from rentlake.operators.increments import Listings
from rentlake.operators.ordered import numbered
from rentlake.session import any_size, cut_lineage, scratch, shared_dir
from rentlake.sources import keyed
from rentlake.sources.keyed import Keyed
from rentlake.sources.store import Store
from tests.test_operators import SCHEMA, draft

SF = "/root/testdata/sf0.001"


def some(spark):
    rows = [("a", 1, "https://x.it/1", 600), ("b", 2, "https://y.it/9", 600), ("c", 3, "https://x.it/1", 650), ("d", 4, "https://y.it/9", 600), ("e", 5, "https://z.it/5", 600)]
    return spark.createDataFrame([draft(*r) for r in rows], SCHEMA)


def written(spark):
    folder = f"{shared_dir(spark)}/rentlake"
    return set(os.listdir(folder)) if os.path.isdir(folder) else set()


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = [files.apply(i).getName() for i in range(files.size())]
    return {n for n in names if n.startswith("shuffle_")}


def test_shuffle_files_go_with_their_query(spark):
    before = shuffle_files(spark)
    table = cut_lineage(spark.range(1000).groupBy(F.col("id") % 7).count())
    for _ in range(50):
        if not (left := shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    assert not left and table.count() == 7


def test_blocks_of_scratch_hand_tables_on(spark):
    before = written(spark)
    with scratch(spark):
        with scratch(spark):
            cut_lineage(spark.range(1))
            kept, all_along = cut_lineage(spark.range(2), 1), cut_lineage(spark.range(3), 2)
        assert kept.count() == 2 and len(written(spark) - before) == 2
    assert all_along.count() == 3 and len(written(spark) - before) == 1


def test_a_merge_leaves_its_results_only(spark):
    rows, before = some(spark), written(spark)
    merged = upsert.merge(upsert.empty_listings(spark), rows)
    assert len(written(spark) - before) == 3
    assert (merged.listings.count(), merged.changes.count(), merged.alternate_urls.count()) == (2, 5, 2)


def test_identity_is_found_on_narrow_rows(spark, monkeypatch):
    seen, resolve = [], upsert.resolve
    monkeypatch.setattr(upsert, "resolve", lambda drafts, *rest: (seen.append(set(drafts.columns)), resolve(drafts, *rest))[1])
    upsert.merge(upsert.empty_listings(spark), some(spark))
    assert seen and not seen[0] & {"title", "raw_snippet", "listing_url", "location_hint", "match_key"}


def test_tables_of_any_size_are_not_gathered(spark):
    """Few or many listings: neither they nor what is found on the way goes through the driver."""
    rows, total = numbered(upsert.keyed(some(spark)), "seen_at", "draft_key")
    table = upsert.merge(upsert.empty_listings(spark), some(spark).where("draft_key = 'a'")).listings
    placed = cut_lineage(upsert.resolve(rows, table, total))
    for frame in (upsert.changes_of(placed, table), rows.join(any_size(placed.select("pos", "target_url")), "pos")):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        joins = [line for line in plan.splitlines() if "BroadcastHashJoin" in line and "part" not in line]  # rows per partition are few
        assert "SortMergeJoin" in plan and not joins
    late = {r["draft_key"]: r["target_url"] for r in placed.collect()}
    assert late == {"a": "https://x.it/1", "b": "https://x.it/1", "c": "https://x.it/1", "d": "https://y.it/9", "e": "https://y.it/9"}


def test_shared_drafts_travel_once_and_narrow(spark):
    laid_out = views.view(spark, SF, "shared_drafts")
    plain = spark.sql(f"with {views.with_clause('shared_drafts')} select * from shared_drafts")
    assert laid_out.dtypes == plain.dtypes
    assert laid_out.exceptAll(plain).count() == plain.exceptAll(laid_out).count() == 0 < plain.count()
    plan = laid_out._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len(moved) == 1 and "_grp" in moved[0]
    below = plan.split("Exchange hashpartitioning")[1]
    assert "draft_key" not in below and "https" not in below


def test_a_draft_in_the_order_of_time_opens_at_once(spark):
    day = dt.datetime(2024, 1, 1)
    drafts = spark.createDataFrame([(1, day, "u1", None), (2, day, "u2", "f"), (3, day, "u3", "f")], "draft_key int, seen_at timestamp, canonical_url string, fingerprint string")
    listings = spark.createDataFrame([("u3", "g", day)], "canonical_url string, listing_fingerprint string, first_seen_at timestamp")
    rows, total = numbered(drafts, "seen_at", "draft_key")
    got = {r["draft_key"]: (r["target_url"], r["opens"]) for r in upsert.resolve(rows, listings, total).collect()}
    assert got == {1: ("u1", True), 2: ("u2", True), 3: ("u3", False)}


def test_stored_listings_are_not_gathered(spark, tmp_path, monkeypatch):
    """Tables of stored listings are wide and mostly blank: their few columns look small enough to send to every task."""
    plans = []
    monkeypatch.setattr(Keyed, "_write", lambda self, table, version, rows, write=Keyed._write: (plans.append(rows._jdf.queryExecution().executedPlan().toString()), write(self, table, version, rows))[1])
    table, rows, before = Listings(Store(spark, str(tmp_path)), buckets=2), some(spark), written(spark)
    for version, part in ((1, rows.where("draft_key < 'c'")), (2, rows.where("draft_key >= 'c'"))):
        merged = table.merge(version, part)
    assert sum(r["rent_eur"] for r in table.rows.read().collect()) == 1250 and merged.changes.count() == 3
    assert len(written(spark) - before) == 6  # three results a batch
    assert plans and not [p for p in plans if "BroadcastHashJoin" in p]


def test_many_keys_looked_up_are_joined_where_they_lie(spark, tmp_path, monkeypatch):
    table = Keyed(Store(spark, str(tmp_path)), "t", "k int, n int", ["k"], buckets=2)
    table.write(1, spark.range(20).selectExpr("cast(id as int) as k", "1 as n"))
    join = lambda: table.lookup(spark.range(5, 30).selectExpr("cast(id as int) as k"))
    few = join()
    monkeypatch.setattr(keyed, "FEW", 10)
    many = join()
    named = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in named(few) and "BroadcastHashJoin" not in named(many)
    assert few.count() == many.count() == 15
