"""Queries and their SQL at the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as entry
from compare import _rows
from rentlake.catalog.views import TABLES

SF = "/root/testdata/sf0.001"
NAMES = (
    "t7_canonical_url", "t25_fingerprint", "n1_parse_amount", "n4_rent_from_text", "n14_rule_score", "j2_reply_result", "p8_keeps_post_draft",
    "e1_generic_drafts", "e3_immobiliare_drafts", "e6_feed_posts", "e7_post_drafts", "w2_duplicate_primary", "w4_digest_cut", "t32_listing_card",
    "u2_merge_fields", "u3_price_changes", "u5_change_feed", "u5_two_key_changes", "g2_proximity", "r4_price_change_stream", "e0_anchors", "e2_idealista_drafts",
    "a3_message_counters", "a4_post_counters", "s9_run_metrics", "s10_export_files", "s12_front_messages", "s13_front_posts", "w6_send_schedule", "w6_outbox", "w9_digest_cards",
)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    rel = duck.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(rel.columns, rel.fetchall())


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
