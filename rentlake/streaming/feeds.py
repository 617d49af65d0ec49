"""Structured Streaming twins of the polled feeds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rentlake.criteria import Criteria
from rentlake.operators.increments import Listings
from rentlake.operators.ledger import Ledger
from rentlake.operators.ordered import chunk, numbered, with_previous
from rentlake.operators.outbox import Outbox
from rentlake.plans import ingest as ingest_plan
from rentlake.session import cut_lineage, scratch
from rentlake.sources.keyed import Keyed
from rentlake.sources.store import Store

LOOKBACK = {"message_id": "26 hours", "post_id": "24 hours"}
PRICE_STATE = "listing_key string, rent_eur int, observed_at timestamp, obs_id string"


def landed(spark: SparkSession, folder: str, schema: str, files_per_trigger: int | None = None, pattern: str | None = None) -> DataFrame:
    """Landed parquet files as a stream."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.parquet(folder)


def once(stream: DataFrame, key: str, time: str, lookback: str | None = None) -> DataFrame:
    """Each id once; rows older than the lookback behind the newest are late and dropped."""
    return stream.withWatermark(time, lookback or LOOKBACK[key]).dropDuplicatesWithinWatermark([key])


def run_available(writer, checkpoint: str) -> StreamingQuery:
    """Process what has landed, then stop."""
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def price_changes(stream: DataFrame, store: Store, checkpoint: str) -> StreamingQuery:
    """Observed rents to price-change events.

    The last known rents are a keyed table: a batch looks up its own listings and writes only
    those, and reads a base and a bounded number of changes.  A batch compares inside itself with the chunked
    ``with_previous`` and takes the state where a listing appears for the first time, so
    one busy listing does not fill a task, and a batch that runs again reads and writes the
    same versions.
    """
    event = "listing_key string, obs_id string, observed_at timestamp, prev_rent int, rent_eur int"
    at = F.struct("observed_at", "obs_id")
    state = Keyed(store, "price_state", PRICE_STATE, ["listing_key"])

    def newest(rows: DataFrame) -> DataFrame:
        state = F.max_by(F.struct("rent_eur", "observed_at", "obs_id"), at).alias("s")
        return rows.where("rent_eur is not null").groupBy("listing_key").agg(state).select("listing_key", "s.*")

    def apply(batch: DataFrame, batch_id: int) -> None:
        version = batch_id + 1
        with scratch(store.spark):
            rows, _ = numbered(batch.select("listing_key", "obs_id", "observed_at", F.col("rent_eur").cast("int")), "observed_at", "obs_id")
            known = state.lookup(rows, before=version)
            inside = with_previous(rows, ["listing_key"], chunk(), ["pos"], ["rent_eur"])
            last = known.select("listing_key", F.col("rent_eur").alias("old_rent"))
            compared = inside.join(last, "listing_key", "left").withColumn("prev_rent", F.coalesce("prev_rent_eur", "old_rent"))
            changed = compared.where(F.col("rent_eur") != F.col("prev_rent"))
            store.write("price_events", version, changed.selectExpr(*[f"cast({d.split()[0]} as {d.split()[1]})" for d in event.split(", ")]))
            state.write(version, newest(known.unionByName(rows.select(*known.columns)).where("listing_key is not null")))

    return run_available(stream.writeStream.foreachBatch(apply), checkpoint)


def resend_state(events: DataFrame, kind: Column, key: str, time: str) -> DataFrame:
    """Running sent and price-changed times per listing; ``due`` while the card is to go out.

    Both times are maxima, so this is a streaming aggregate that combines before the
    shuffle; write it in update mode.
    """
    sent = F.max(F.when(kind == "sent", F.col(time)))
    priced = F.max(F.when(kind == "price", F.col(time)))
    state = events.groupBy(key).agg(sent.alias("sent_at"), priced.alias("price_changed_at"))
    due = F.col("sent_at").isNull() | F.coalesce(F.col("sent_at") < F.col("price_changed_at"), F.lit(False))
    return state.withColumn("due", due)


def send_cards(stream: DataFrame, outbox: Outbox, checkpoint: str, as_of: str, first: int = 1) -> StreamingQuery:
    """Outbox events batch by batch; what a batch makes due goes to ``sends``, a version a batch from ``first`` on.

    A batch reads and writes the listings its events name, and one that runs again hands out the same cards.
    """
    store = outbox.store

    def apply(batch: DataFrame, batch_id: int) -> None:
        version = batch_id + first
        with scratch(store.spark):
            store.write("sends", version, outbox.take_and_hand_out(version, batch, as_of))

    return run_available(stream.writeStream.foreachBatch(apply), checkpoint)


def merge_drafts(stream: DataFrame, store: Store, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """Drafts merged batch by batch into ``Listings``, which read and write what the batch touches; a batch
    that runs again starts from the same version."""
    listings = Listings(store, buckets)

    def apply(batch: DataFrame, batch_id: int) -> None:
        version = batch_id + 1
        with scratch(store.spark):
            merged = listings.merge(version, batch)
            store.write("changes", version, merged.changes)
            store.write("alternate_urls", version, merged.alternate_urls)

    return run_available(stream.writeStream.foreachBatch(apply), checkpoint)


def unseen_rows(stream: DataFrame, ledger: Ledger, checkpoint: str, sink: Callable[[DataFrame, int], None], first: int = 1) -> StreamingQuery:
    """Rows the ledger does not hold yet, handed to ``sink`` with the version to write, then entered.

    Batches take the versions from ``first`` on.  A batch that runs again looks at older versions only, so
    the sink gets the same rows for the same version; of rows with one id in a batch, one goes on.
    """
    key = ledger.key

    def apply(batch: DataFrame, batch_id: int) -> None:
        version = batch_id + first
        with scratch(ledger.store.spark):
            one = batch.where(F.col(key).isNotNull()).dropDuplicates([key]).unionByName(batch.where(F.col(key).isNull()))
            new = cut_lineage(ledger.unseen(cut_lineage(one), before=version))
            sink(new, version)
            ledger.write(version, new)

    return run_available(stream.writeStream.foreachBatch(apply), checkpoint)


def message_stream(stream: DataFrame, store: Store, checkpoint: str, c: Criteria) -> StreamingQuery:
    """Landed messages, each parsed once; kept drafts go to ``message_drafts`` and ids to ``seen_messages``."""
    ledger = Ledger(store, "seen_messages", "message_id string, received_at timestamp", "message_id", "received_at")
    return unseen_rows(stream, ledger, checkpoint, lambda new, version: store.write("message_drafts", version, message_batch(new, c)))


def message_batch(batch: DataFrame, c: Criteria) -> DataFrame:
    """Kept drafts of one batch of messages, with the time their message was received."""
    drafts = cut_lineage(ingest_plan.message_drafts(batch, c)).where("kept")
    return drafts.withColumn("draft_key", F.concat_ws("|", F.lit("message"), "message_id", "canonical_url"))
