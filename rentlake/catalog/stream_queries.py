"""Streams run over the given tables until all that has landed is processed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentlake.catalog.registry import ORACLES, query
from rentlake.catalog.state_queries import folded, shared_drafts
from rentlake.catalog.views import table, view
from rentlake.operators.increments import Listings
from rentlake.operators.ledger import Ledger
from rentlake.operators.outbox import EVENT, Outbox
from rentlake.session import fresh_folder
from rentlake.sources.store import Store
from rentlake.streaming import feeds


def _schema(df: DataFrame) -> str:
    return ", ".join(f"{n} {t}" for n, t in df.dtypes)


def event_stream(spark, sf) -> DataFrame:
    rows = feeds.landed(spark, sf, _schema(table(spark, sf, "events")), pattern="events.parquet")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def _appended(spark, stream: DataFrame, root: str) -> DataFrame:
    out = f"{root}/out"
    feeds.run_available(stream.writeStream.format("parquet").option("path", out).outputMode("append"), f"{root}/checkpoint")
    return spark.read.schema(_schema(stream)).parquet(out)


@query("r1_lookback_stream", "select event_id, user_id from events")
def r1(spark, sf):
    stream = feeds.once(event_stream(spark, sf), "event_id", "ts", feeds.LOOKBACK["message_id"])
    return _appended(spark, stream.select("event_id", "user_id"), fresh_folder(spark, "r1"))


@query("r2_exactly_once", "select distinct user_id, event_id from events where event_id % 4 > 0")
def r2(spark, sf):
    """The feed arrives twice, and a ledger knows every fourth id already."""
    twice = event_stream(spark, sf).union(event_stream(spark, sf))
    root = fresh_folder(spark, "r2")
    store = Store(spark, root)
    ledger = Ledger(store, "ledger", "event_id bigint, ts timestamp", "event_id", "ts", buckets=8)
    ledger.write(1, table(spark, sf, "events").where("event_id % 4 = 0").select("event_id", F.col("ts").cast("timestamp").alias("ts")))
    once = feeds.once(twice, "event_id", "ts", "26 hours")
    feeds.unseen_rows(once, ledger, f"{root}/checkpoint", lambda new, version: store.write("seen", version, new.select("user_id", "event_id")), first=2)
    return store.read_all("seen", "user_id bigint, event_id bigint")


@query("r3_merge_stream", None)
def r3(spark, sf):
    """Two landings of drafts, each merged when it arrives."""
    drafts = shared_drafts(spark, sf)
    root = fresh_folder(spark, "r3")
    store = Store(spark, f"{root}/tables")
    early = F.col("seen_at") < F.lit("1998-01-01").cast("timestamp")
    for name, part in (("a", drafts.where(early)), ("b", drafts.where(~early))):
        part.write.parquet(f"{root}/in/{name}")
        stream = feeds.landed(spark, f"{root}/in/*", _schema(drafts))
        feeds.merge_drafts(stream, store, f"{root}/checkpoint", buckets=8)
    return folded(Listings(store, 8).rows.read())


ORACLES["r3_merge_stream"] = ORACLES["u2_merge_fields"]


@query("r4_price_change_stream", ORACLES["u3_price_changes"])
def r4(spark, sf):
    """Three landings in time order; the same rows as the batch window."""
    rows = view(spark, sf, "observations").selectExpr("cast(listing_key as string) as listing_key", "cast(obs_id as string) as obs_id", "observed_at", "rent_eur")
    root = fresh_folder(spark, "r4")
    store = Store(spark, f"{root}/tables")
    cuts = ["1970-01-01", "2024-01-06", "2024-01-14", "2999-01-01"]
    for i, (low, high) in enumerate(zip(cuts, cuts[1:])):
        rows.where((F.col("observed_at") >= low) & (F.col("observed_at") < high)).write.parquet(f"{root}/in/{i}")
        feeds.price_changes(feeds.landed(spark, f"{root}/in/*", _schema(rows)), store, f"{root}/checkpoint")
    events = store.read_all("price_events", "listing_key string, obs_id string, observed_at timestamp, prev_rent int, rent_eur int")
    return events.selectExpr("cast(listing_key as bigint) as listing_key", "cast(obs_id as bigint) as obs_id", "prev_rent", "rent_eur")


@query("r5_resend_stream", """select user_id, strftime(max(ts) filter (event_type = 'click'), '%Y-%m-%d %H:%M:%S') as sent, strftime(max(ts) filter (event_type = 'view'), '%Y-%m-%d %H:%M:%S') as priced,
  max(ts) filter (event_type = 'click') is null or coalesce(max(ts) filter (event_type = 'click') < max(ts) filter (event_type = 'view'), false) as due
  from events where event_type in ('click', 'view') group by user_id""")
def r5(spark, sf):
    kind = F.when(F.col("event_type") == "click", F.lit("sent")).otherwise(F.lit("price"))
    events = event_stream(spark, sf).where(F.col("event_type").isin("click", "view"))
    state = feeds.resend_state(events, kind, "user_id", "ts")
    root = fresh_folder(spark, "r5")
    store = Store(spark, root)
    query_ = state.writeStream.outputMode("update").foreachBatch(lambda batch, i: store.write("state", i + 1, batch))
    feeds.run_available(query_, f"{root}/checkpoint")
    fmt = "yyyy-MM-dd HH:mm:ss"
    rows = store.read_all("state", "user_id bigint, sent_at timestamp, price_changed_at timestamp, due boolean")
    newest = rows.groupBy("user_id").agg(F.max(F.struct(F.coalesce(F.greatest("sent_at", "price_changed_at")).alias("at"), "sent_at", "price_changed_at", "due")).alias("s"))
    return newest.select("user_id", F.date_format("s.sent_at", fmt).alias("sent"), F.date_format("s.price_changed_at", fmt).alias("priced"), "s.due")


@query("r6_late_data", "select event_id from events where ts > (select max(ts) - interval '3' day from events)")
def r6(spark, sf):
    """The newest days land first; everything older that lands afterwards is late."""
    rows = table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    newest = rows.agg(F.max("ts").alias("newest"))
    recent = rows.join(newest).where("ts > newest - interval '3' day").drop("newest")  # one-row side
    root = fresh_folder(spark, "r6")
    out = None
    for name, part in (("a", recent), ("b", rows)):
        part.write.parquet(f"{root}/in/{name}")
        stream = feeds.once(feeds.landed(spark, f"{root}/in/*", _schema(rows)), "event_id", "ts", "26 hours")
        out = _appended(spark, stream.select("event_id"), root)
    return out



@query("w6_outbox", """with rows_ as (
    select user_id * 100 + day(ts) // 3 as listing, ts, case event_type when 'view' then 'chosen' when 'click' then 'sent' when 'signup' then 'dismissed' end as kind,
      case when event_id % 7 > 0 then ts end as reason_at, event_id % 3 as landing
    from events where event_type in ('view', 'click', 'signup') and user_id is not null),
  landed as (select listing, landing, count(*) filter (kind = 'chosen') > 0 as chosen, max(reason_at) filter (kind = 'chosen') as reason_at,
      max(ts) filter (kind = 'sent') as sent_at, count(*) filter (kind = 'dismissed') > 0 as dismissed from rows_ group by listing, landing),
  known as (select listing, landing, chosen, reason_at,
      max(reason_at) over (partition by listing order by landing) as newest,
      max(reason_at) over (partition by listing order by landing rows between unbounded preceding and 1 preceding) as before,
      coalesce(bool_or(chosen) over (partition by listing order by landing rows between unbounded preceding and 1 preceding), false) as queued,
      max(sent_at) over (partition by listing order by landing) as sent_at,
      bool_or(dismissed) over (partition by listing order by landing) as dismissed from landed)
  select listing, cast(landing + 1 as integer) as landing, case when sent_at is null then 'first' else 'price' end as reason, strftime(newest, '%Y-%m-%d %H:%M:%S') as reason_at
  from known where chosen and (not queued or coalesce(reason_at, timestamp '1900-01-01') > coalesce(before, timestamp '1900-01-01'))
    and not dismissed and (sent_at is null or coalesce(sent_at < newest, false))""")
def w6_outbox(spark, sf):
    """Three landings in no order of time and the first one again; views choose a card, clicks are receipts, signups dismiss."""
    kind = F.when(F.col("event_type") == "view", "chosen").when(F.col("event_type") == "click", "sent").when(F.col("event_type") == "signup", "dismissed")
    rows = table(spark, sf, "events").select(
        F.expr("cast(user_id * 100 + day(ts) div 3 as string)").alias("listing_id"), kind.alias("kind"), F.col("ts").cast("timestamp").alias("at"),
        F.when(F.col("event_id") % 7 > 0, F.col("ts").cast("timestamp")).alias("reason_at"), (F.col("event_id") % 3).alias("landing"),
    ).where("kind is not null and listing_id is not null")
    root = fresh_folder(spark, "w6")
    outbox = Outbox(Store(spark, f"{root}/tables"), buckets=8)
    for i, landing in enumerate((0, 1, 2, 0)):
        rows.where(F.col("landing") == landing).drop("landing").write.parquet(f"{root}/in/{i}")
        feeds.send_cards(feeds.landed(spark, f"{root}/in/*", EVENT), outbox, f"{root}/checkpoint", "2030-01-01 00:00:00")
    sends = spark.read.option("basePath", f"{root}/tables/sends").parquet(*[outbox.store.path("sends", v) for v in outbox.store.versions("sends")])
    return sends.select(F.col("listing_id").cast("bigint").alias("listing"), F.col("version").cast("int").alias("landing"), "reason", F.date_format("reason_at", "yyyy-MM-dd HH:mm:ss").alias("reason_at"))
