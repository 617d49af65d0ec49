"""One scheduled run over the stored tables."""

from __future__ import annotations

import datetime as dt
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rentlake.criteria import Criteria
from rentlake.functions import cards
from rentlake.operators import digest, geocode, scoring, tables
from rentlake.operators.ledger import Ledger
from rentlake.operators.ordered import numbered
from rentlake.operators.outbox import Outbox, chosen_events, dismissal_events, receipt_events
from rentlake.operators.requests import Requests
from rentlake.operators.scoring import SCORE_SCHEMA, LatestScores
from rentlake.operators.upsert import LISTING_SCHEMA
from rentlake.plans import front
from rentlake.plans import ingest as ingest_plan
from rentlake.plans import rate as rate_plan
from rentlake.session import cut_lineage, scratch, tune
from rentlake.sources.landing import since
from rentlake.sources.store import Store

MESSAGE_LEDGER = "message_id string, subject string, from_address string, received_at timestamp, processed_at timestamp, listings_found int"
POST_LEDGER = "post_id string, group_id string, permalink string, message string, posted_at timestamp, processed_at timestamp, listings_found int"
POINTS = "query_key string, query_raw string, lat double, lng double, source string, created_at timestamp"


RUNS = (
    "id string, started_at timestamp, finished_at timestamp, status string, messages_processed int, listings_parsed int, "
    "listings_new int, duplicates_skipped int, listings_scored int, cards_sent int, error_message string"
)


def duplicate_skips_since(store: Store, time: str) -> DataFrame:
    """Drafts since a time (text in UTC) that met a known listing; only the days from then on are read."""
    schema = "seen_at timestamp, is_new boolean"
    return tables.duplicate_skips_since(store.read_days("changes", schema, first=dt.datetime.fromisoformat(time).date()), time)


def ledgers(store: Store) -> tuple[Ledger, Ledger]:
    """Of messages and of posts."""
    return Ledger(store, "message_ledger", MESSAGE_LEDGER, "message_id", "received_at"), Ledger(store, "post_ledger", POST_LEDGER, "post_id", "posted_at")


def run(
    spark: SparkSession, root: str, version: int, messages: DataFrame, posts: DataFrame, c: Criteria, as_of: str,
    gazetteer: DataFrame, fallback: DataFrame, model_replies: DataFrame | None = None,
    message_hours: int = 26, post_hours: int = 24, receipts: DataFrame | None = None, dismissed: DataFrame | None = None,
    queue: bool = False, answers: DataFrame | None = None,
) -> dict[str, int]:
    """Ingest, link, score and lay out the digest; returns the run counters.

    Every stage reads the versions before ``version`` and writes ``version``, so running it
    again after a failure gives the same tables.  Listings are a snapshot per version; ledgers,
    scores, points, alternate URLs, changes and runs are appended, a version holding the rows of its run.
    ``receipts`` (listing_id, sent_at, message_id) says which cards were sent since the last
    run and ``dismissed`` (listing_id) which listings nobody wants to see again.
    With ``queue`` the chosen cards wait in the outbox, from which ``send`` takes them.
    ``answers`` (request_id, response, replied_at) are the model's answers to ``prompts`` of earlier runs, or None
    where no model is asked; with them, also an empty table, the run writes the questions that are new, and scores listings again when
    their answer is there.
    """
    tune(spark)
    store = Store(spark, root)
    counters: dict[str, int] = {}
    store.write("runs", version, tables.run_row(spark, str(version), as_of, None, counters))
    try:
        with scratch(spark):
            _run(spark, store, version, messages, posts, c, as_of, gazetteer, fallback, model_replies, message_hours, post_hours, receipts, dismissed, queue, answers, counters)
        store.write("runs", version, tables.run_row(spark, str(version), as_of, as_of, counters))
    except Exception as error:
        store.write("runs", version, tables.run_row(spark, str(version), as_of, as_of, counters, str(error)[:2000]))
        raise
    return counters


def run_landed(
    spark: SparkSession, root: str, version: int, parts: DataFrame, headers: DataFrame, pages: DataFrame, c: Criteria, as_of: str,
    gazetteer: DataFrame, fallback: DataFrame, message_hours: int = 26, post_hours: int = 24, **options,
) -> dict[str, int]:
    """``run`` from what has landed: MIME parts and headers of messages, and feed pages."""
    tune(spark)
    with scratch(spark):
        messages = cut_lineage(front.new_messages(parts, headers, as_of, message_hours))
        posts = cut_lineage(front.new_posts(pages, as_of, post_hours))
        return run(spark, root, version, messages, posts, c, as_of, gazetteer, fallback, message_hours=message_hours, post_hours=post_hours, **options)


def send(
    spark: SparkSession, root: str, version: int, c: Criteria, as_of: str, receipts: DataFrame | None = None,
    dismissed: DataFrame | None = None, delay_ms: int = 2500, retry_minutes: int | None = None,
) -> DataFrame:
    """Cards that are to go out now, from the outbox, one every ``delay_ms``; also written as ``sends``.

    Versions are those of ``run`` and count on: a send takes one of its own.  What is in the outbox is checked
    again against ``receipts`` and ``dismissed`` known by now, and a card shows the listing as it now stands; a
    listing that is gone or dismissed in the listing table makes none.  Running a version again gives the same cards.
    """
    tune(spark)
    store = Store(spark, root)
    outbox = Outbox(store, retry_minutes)
    with scratch(spark):
        news = [e for e in (
            None if receipts is None else receipt_events(receipts), None if dismissed is None else dismissal_events(dismissed, as_of),
        ) if e is not None]
        due = outbox.hand_out(version, as_of, reduce(DataFrame.unionByName, news) if news else None)
        listings = store.read("listings", LISTING_SCHEMA, before=version)
        view = digest.digest_view(listings, LatestScores(store).read(before=version))
        rows, _ = numbered(view.join(due, F.col("id") == F.col("listing_id")), "queued_at", *digest.rank_order())
        wait = F.make_interval(secs=F.col("pos") * F.lit(max(0, delay_ms) / 1000).cast("decimal(18,6)"))
        row = {n: F.col(n) for n in rows.columns}
        store.write("sends", version, rows.select(
            "listing_id", "reason", F.col("pos").alias("position"), (F.lit(as_of).cast("timestamp") + wait).alias("send_at"),
            cards.card(row, c.reference_name).alias("text"),
        ))
    return spark.read.parquet(store.path("sends", version))


def _run(spark, store, version, messages, posts, c, as_of, gazetteer, fallback, model_replies, message_hours, post_hours, receipts, dismissed, queue, answers, counters) -> None:
    now = F.lit(as_of).cast("timestamp")
    listings = store.read("listings", LISTING_SCHEMA, before=version)
    if receipts is not None:
        listings = tables.mark_sent(listings, receipts)
    if dismissed is not None:
        listings = tables.mark_dismissed(listings, dismissed, as_of)
    latest, requests = LatestScores(store), Requests(store)
    old_scores = cut_lineage(latest.read(before=version))
    mail_ledger, post_ledger = ledgers(store)
    cache = store.read_all("geocode_cache", POINTS, before=version)

    result = ingest_plan.ingest(
        listings, since(messages, "received_at", now, message_hours), since(posts, "posted_at", now, post_hours),
        partial(mail_ledger.unseen, before=version), partial(post_ledger.unseen, before=version), c, as_of,
    )
    mail_ledger.write(version, cut_lineage(result.message_ledger))
    post_ledger.write(version, cut_lineage(result.post_ledger))
    store.write("changes", version, result.merge.changes, day="seen_at")
    store.write("alternate_urls", version, result.merge.alternate_urls)
    store.write("linked", version, result.listings)
    linked = spark.read.schema(LISTING_SCHEMA).parquet(store.path("linked", version))
    counts = result.counts.first().asDict()
    counters |= {
        "messages_processed": counts["messages_processed"], "listings_parsed": counts["messages_parsed"] + counts["posts_parsed"],
        "listings_new": counts["listings_new"], "duplicates_skipped": counts["duplicates"],
        **{n: counts[n] for n in counts if n.startswith(("messages_skipped", "posts_"))},
    }

    if answers is not None:
        requests.answer(version, answers)
        # A listing whose answer has come counts as not scored.
        again = requests.answered(version, answers)
        old_scores = old_scores.join(again, "listing_id", "left_anti").select(*old_scores.columns)
    located = cut_lineage(rate_plan.located(linked, old_scores, c, cache, gazetteer, fallback, as_of))
    if answers is not None:
        questions = requests.questions(located, c)
        found = requests.replies(questions, version + 1)
        model_replies = found if model_replies is None else found.unionByName(model_replies, allowMissingColumns=True)
        requests.ask(version, questions, as_of)
    store.write("listing_scores", version, scoring.score(located, c, model_replies, as_of))
    latest.write(version, store.read("listing_scores", SCORE_SCHEMA, before=version + 1))
    store.write("listings", version, rate_plan.with_points(linked, located))
    if c.proximity_enabled:
        store.write("geocode_cache", version, geocode.new_cache_rows(located, cache, as_of))
    counters["listings_scored"] = store.read("listing_scores", SCORE_SCHEMA, before=version + 1).count()

    current = store.read("listings", LISTING_SCHEMA, before=version + 1)
    all_scores = latest.read(before=version + 1)
    lines = rate_plan.digest_cards(current, all_scores, c, as_of, counters["listings_new"], counters["duplicates_skipped"], queue=queue)
    store.write("digest_cards", version, lines)
    if queue:
        chosen = current.join(spark.read.parquet(store.path("digest_cards", version)).select(F.col("listing_id").alias("id")), "id", "left_semi")
        events = chosen_events(chosen, as_of)
        if receipts is not None:
            events = events.unionByName(receipt_events(receipts))
        if dismissed is not None:
            events = events.unionByName(dismissal_events(dismissed, as_of))
        Outbox(store).take(version, events)
    counters["cards_sent"] = spark.read.parquet(store.path("digest_cards", version)).where("listing_id is not null").count()
