"""Views over the given tables as Spark reads them."""

import pytest
from pyspark.sql import functions as F

from rentlake.catalog import views
from rentlake.functions import keys
from rentlake.operators import duplicates, upsert
from rentlake.sources.keyed import Keyed
from rentlake.sources.store import Store

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["listings", "scores"])
def test_drafts_laid_out_by_url_give_the_same_rows(spark, name):
    laid_out = views.view(spark, SF, name)
    plain = spark.sql(f"with {views.with_clause(name)} select * from {name}")
    assert laid_out.dtypes == plain.dtypes
    assert laid_out.exceptAll(plain).count() == plain.exceptAll(laid_out).count() == 0 < plain.count()


def test_listings_travel_as_narrow_rows(spark):
    plan = views.view(spark, SF, "listings")._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and ("_url" in line or "canonical_url" in line)]
    assert len(moved) == 1 and "_url" in moved[0] and "canonical_url" not in moved[0]


def test_keys_keep_further_columns(spark):
    rows = spark.createDataFrame([(7, "k", "u", "Via Roma 1", 500)], "draft_id int, draft_key string, canonical_url string, title string, rent_eur int")
    got = upsert.keyed(rows.withColumn("seen_at", F.lit("2024-01-01").cast("timestamp")), "draft_id").first()
    assert got["draft_id"] == 7 and got["fingerprint"] == "via-roma-1|r?|a?|€500"


def test_listings_are_sorted_by_a_hash_of_their_url_first(spark):
    """URLs begin alike, so that each comparison of two of them reads both texts."""
    plan = views.view(spark, SF, "listings")._jdf.queryExecution().executedPlan().toString()
    sorts = [line.split("Sort [")[1] for line in plan.split("\n") if "Sort [" in line]
    assert sorts and not any(line.startswith("canonical_url") for line in sorts)


def test_a_match_key_derives_its_street_once(spark):
    rows = views.view(spark, SF, "listings").withColumn("property_match_key", F.lit(None).cast("string"))
    plan = duplicates.backfill_match_keys(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(") == 1
    blank = spark.createDataFrame([("Torino",), ("Via Po 3, Torino",), ("corso Dante",), (None,)], "t string")
    assert [r[0] for r in blank.select(keys.street_key(F.col("t"))).collect()] == [None, "via-po-3", "via-dante", None]


def test_a_lookup_in_an_empty_table_reads_nothing(spark, tmp_path):
    table = Keyed(Store(spark, str(tmp_path)), "t", "k string, v int", ["k"], buckets=2)
    wanted = spark.range(3).select(F.raise_error(F.lit("read")).cast("string").alias("k"))
    assert table.lookup(wanted).count() == 0
    table.write(1, spark.createDataFrame([("a", 1)], "k string, v int"))
    assert table.lookup(spark.createDataFrame([("a",)], "k string")).count() == 1


def test_both_modes_of_the_digest_share_one_selection(spark, monkeypatch):
    from rentlake.catalog import QUERIES
    from rentlake.operators import digest

    calls, select = [], digest.selection
    monkeypatch.setattr(digest, "selection", lambda *a, **k: calls.append(1) or select(*a, **k))
    assert QUERIES["w9_digest_cards"](spark, SF).count() == 2
    assert len(calls) == 1
