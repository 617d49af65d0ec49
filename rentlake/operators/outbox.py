"""Cards waiting to be sent, each with a reason: the first time, or a price change at some time.

One row a listing holds its newest reason, when that was queued and handed to the sender, and the newest receipt
and the earliest dismissal known.  The same reason queued again changes nothing; a newer one makes the card wait
anew, so two price changes before the sender comes by make one card.  Whether a card still is to go out is
asked when the sender takes it: not if the listing was dismissed, or sent at or after its newest reason.

Events are (listing_id, kind, at, reason_at): ``chosen`` queues a listing for its price change at ``reason_at``, null for the first
time; ``sent`` is a receipt and ``dismissed`` a dismissal at ``at``.  Events may come in any order and more than
once; those without a listing, and receipts or dismissals without a time, are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rentlake.operators.digest import may_send
from rentlake.session import cut_lineage
from rentlake.sources.keyed import Keyed
from rentlake.sources.store import Store

EVENT = "listing_id string, kind string, at timestamp, reason_at timestamp"
_ROW = (
    "listing_id string, reason_at timestamp, queued_at timestamp, handed_at timestamp, tries int, "
    "sent_at timestamp, dismissed_at timestamp"
)


def chosen_events(selection: DataFrame, as_of: str) -> DataFrame:
    """Events that queue the listings of a digest selection."""
    at = F.lit(as_of).cast("timestamp")
    return selection.select(F.col("id").alias("listing_id"), F.lit("chosen").alias("kind"), at.alias("at"), F.col("price_changed_at").alias("reason_at"))


def receipt_events(receipts: DataFrame) -> DataFrame:
    """Events of (listing_id, sent_at)."""
    return receipts.select("listing_id", F.lit("sent").alias("kind"), F.col("sent_at").alias("at"), F.lit(None).cast("timestamp").alias("reason_at"))


def dismissal_events(dismissed: DataFrame, as_of: str) -> DataFrame:
    """Events of (listing_id)."""
    return dismissed.select("listing_id", F.lit("dismissed").alias("kind"), F.lit(as_of).cast("timestamp").alias("at"), F.lit(None).cast("timestamp").alias("reason_at"))


class Outbox:
    """``retry_minutes`` after it was handed out without a receipt, a card goes out again, ``attempts`` times in all; None: never."""

    def __init__(self, store: Store, retry_minutes: int | None = None, attempts: int = 5, buckets: int = 64, fold_every: int = 16):
        self.store, self.retry_minutes, self.attempts = store, retry_minutes, attempts
        self.rows = Keyed(store, "outbox", _ROW, ["listing_id"], buckets=buckets, fold_every=fold_every)

    def _with(self, known: DataFrame, events: DataFrame) -> DataFrame:
        """Known rows with the events worked in."""
        k = F.col
        of = lambda kind, value: F.when(k("kind") == kind, k(value))
        news = events.where("listing_id is not null").groupBy("listing_id").agg(
            F.max(of("chosen", "reason_at")).alias("_reason"), F.count(F.when(k("kind") == "chosen", 1)).alias("_chosen"),
            F.max(of("chosen", "at")).alias("_queued"), F.max(of("sent", "at")).alias("_sent"), F.min(of("dismissed", "at")).alias("_gone"),
        )
        both = known.join(news, "listing_id", "full_outer")
        later = k("_reason").isNotNull() & F.coalesce(k("_reason") > k("reason_at"), F.lit(True))
        anew = (F.coalesce("_chosen", F.lit(0)) > 0) & (k("tries").isNull() | later)
        return both.select(
            "listing_id", F.greatest("reason_at", "_reason").alias("reason_at"),
            F.when(anew, k("_queued")).otherwise(k("queued_at")).alias("queued_at"),
            F.when(~anew, k("handed_at")).alias("handed_at"),
            F.when(anew, F.lit(0)).otherwise(k("tries")).alias("tries"),  # null: never chosen
            F.greatest("sent_at", "_sent").alias("sent_at"), F.least("dismissed_at", "_gone").alias("dismissed_at"),
        )

    def _due(self, now: Column) -> Column:
        first = F.col("handed_at").isNull()
        if self.retry_minutes is not None:
            late = F.col("handed_at") <= now - F.make_interval(mins=F.lit(self.retry_minutes))
            first = first | (late & (F.col("tries") < self.attempts))
        waits = F.col("tries").isNotNull() & first
        return waits & may_send(F.col("sent_at"), F.col("reason_at"), F.col("dismissed_at"))

    def _handed(self, rows: DataFrame, now: Column) -> DataFrame:
        """Rows with ``due``; due ones are stamped as handed out."""
        marked = rows.withColumn("due", self._due(now))
        stamp = {"handed_at": F.when(F.col("due"), now).otherwise(F.col("handed_at")), "tries": F.col("tries") + F.col("due").cast("int")}
        return cut_lineage(marked.withColumns(stamp))

    def _taken(self, version: int, rows: DataFrame) -> DataFrame:
        self.rows.write(version, rows)
        sending = F.when(F.col("sent_at").isNull(), F.lit("first")).otherwise(F.lit("price")).alias("reason")
        return rows.where("due").select("listing_id", sending, "reason_at", "queued_at", "handed_at", "tries")

    def take(self, version: int, events: DataFrame) -> None:
        """Work events in, as ``version``; reads and writes the listings they name."""
        written = cut_lineage(events.select("listing_id", "kind", "at", "reason_at"))
        self.rows.write(version, self._with(self.rows.lookup(written, version), written))

    def hand_out(self, version: int, as_of: str, events: DataFrame | None = None) -> DataFrame:
        """All cards due now, once ``events`` are worked in; ``version`` marks them as handed out.

        Reads the whole outbox and writes what changes.  Run again, it gives the same cards.
        """
        now = F.lit(as_of).cast("timestamp")
        if events is None:
            return self._taken(version, self._handed(self.rows.read(version).where(self._due(now)), now))
        written = cut_lineage(events.select("listing_id", "kind", "at", "reason_at"))
        named = written.select("listing_id").distinct().withColumn("_named", F.lit(True))
        rows = self._with(self.rows.read(version), written).join(named, "listing_id", "left")
        return self._taken(version, self._handed(rows.where(F.col("_named") | self._due(now)).drop("_named"), now))

    def take_and_hand_out(self, version: int, events: DataFrame, as_of: str) -> DataFrame:
        """Work events in and hand out what is due of the listings they name, in one write."""
        written = cut_lineage(events.select("listing_id", "kind", "at", "reason_at"))
        rows = self._with(self.rows.lookup(written, version), written)
        return self._taken(version, self._handed(rows, F.lit(as_of).cast("timestamp")))
