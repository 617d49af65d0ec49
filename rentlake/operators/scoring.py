"""Latest scores, score freshness and the scoring of listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rentlake.criteria import Criteria
from rentlake.functions import replies, rules
from rentlake.session import cut_lineage
from rentlake.sources.keyed import Keyed
from rentlake.sources.store import Store

SCORE_SCHEMA = """
    id string, listing_id string, score int, reasons array<string>, summary string,
    risk_level string, risk_reasons array<string>, risk_source string, model string,
    scored_at timestamp
"""


def latest_scores(scores: DataFrame) -> DataFrame:
    """Newest score per listing, ties by id; combined before the shuffle."""
    rest = [n for n in scores.columns if n not in ("listing_id", "scored_at", "id")]
    at = F.struct("scored_at", "id")
    newest = scores.groupBy("listing_id").agg(F.max(at).alias("_at"), F.max_by(F.struct(*rest), at).alias("_row"))
    return newest.select("listing_id", "_at.*", "_row.*").select(*scores.columns)


class LatestScores:
    """The newest score of each listing, kept up by the scores of each run: a run reads and writes what it scored, not the history."""

    def __init__(self, store: Store, buckets: int = 64, fold_every: int = 16):
        self.table = Keyed(store, "latest_scores", SCORE_SCHEMA, ["listing_id"], buckets=buckets, fold_every=fold_every)

    def read(self, before: int | None = None) -> DataFrame:
        return self.table.read(before)

    def write(self, version: int, scores: DataFrame) -> None:
        """Take in scores; older ones than the stored never replace them.  Scores of no listing are left out."""
        new = cut_lineage(latest_scores(scores.where("listing_id is not null").select(*self.table.columns)))
        known = self.table.lookup(new, version)
        self.table.write(version, latest_scores(new.unionByName(known)))


def with_latest(listings: DataFrame, scores: DataFrame, how: str = "left") -> DataFrame:
    """Listings next to their newest score, columns prefixed with ``s_``."""
    latest = latest_scores(scores)
    named = latest.select(*[F.col(n).alias(f"s_{n}") for n in latest.columns])
    return listings.join(named, F.col("id") == F.col("s_listing_id"), how)


def is_fresh(last_seen: Column, scored_at: Column, as_of: Column, days: int) -> Column:
    """Scored within the cache time and not seen since."""
    since = as_of - F.make_interval(days=F.lit(days))
    return F.coalesce((scored_at >= since) & (last_seen <= scored_at), F.lit(False))


def candidates(listings: DataFrame, scores: DataFrame, as_of: Column, days: int = 7, limit: int | None = None) -> DataFrame:
    """Active listings with the class the scoring run puts them in; ``limit`` keeps the newest."""
    active = listings.where("dismissed_at is null")
    if limit is not None:
        active = active.orderBy(F.col("last_seen_at").desc(), "id").limit(limit)
    fresh = is_fresh(F.col("last_seen_at"), F.col("s_scored_at"), as_of, days)
    return with_latest(active, scores).withColumn("fresh", fresh)


def with_search_text(df: DataFrame, out: str = "_text") -> DataFrame:
    k = F.col
    return df.withColumn(out, rules.search_text(k("raw_snippet"), k("location_hint"), k("title")))


def hard_ok(c: Criteria, text: str = "_text") -> Column:
    """Expects the search text as a column."""
    k = F.col
    return rules.meets_hard(c, k(text), k("rooms"), k("area_sqm"), k("rent_eur"), k("condo_fee_eur"))


def score(located: DataFrame, c: Criteria, model_replies: DataFrame | None, as_of: str, model: str = "model") -> DataFrame:
    """Score rows for listings that carry distance and proximity.

    ``model_replies`` holds (listing_id, response) and may hold ``replied_at``: the newest
    reply of a listing counts, of equally new ones the largest text.  A listing without a
    usable reply is scored by the rules alone.
    """
    k = F.col
    staged = with_search_text(located).withColumn(
        "_rule",
        rules.rule_score(
            c, k("_text"), k("rooms"), k("area_sqm"), k("rent_eur"), k("condo_fee_eur"),
            k("proximity_score"), k("distance_to_ref_m"),
        ),
    )
    if model_replies is None:
        staged = staged.withColumn("_reply", F.lit(None).cast("string"))
    else:
        time = F.col("replied_at") if "replied_at" in model_replies.columns else F.lit(None).cast("timestamp")
        one = model_replies.groupBy("listing_id").agg(F.max_by("response", F.struct(time, "response")).alias("_reply"))
        staged = staged.join(one.withColumnRenamed("listing_id", "_lid"), k("id") == k("_lid"), "left")
    proximity = k("proximity_score") if c.proximity_enabled else None
    staged = replies.with_result(staged, c, "_reply", "m_", proximity)
    asked = F.coalesce(k("m_usable"), F.lit(False))
    none = F.array().cast("array<string>")
    stamp = F.lit(as_of).cast("timestamp")
    return staged.select(
        F.substring(F.sha2(F.concat_ws("|", k("id"), F.lit(as_of)), 256), 1, 24).alias("id"),
        k("id").alias("listing_id"),
        rules.blend(c, k("_rule.score"), k("m_composite")).alias("score"),
        F.concat(k("_rule.reasons"), F.when(asked, F.array(k("m_line"))).otherwise(none)).alias("reasons"),
        F.nullif(k("m_summary"), F.lit("")).alias("summary"),
        rules.merged_risk_level(k("_rule.risk_level"), k("m_risk_level")).alias("risk_level"),
        rules.merged_risk_reasons(k("_rule.risk_reasons"), k("m_risk_level"), k("m_risk_reasons")).alias("risk_reasons"),
        k("_rule.risk_source").alias("risk_source"),
        F.when(asked, F.lit(model)).alias("model"),
        stamp.alias("scored_at"),
    )


def prompts(listings: DataFrame, c: Criteria) -> DataFrame:
    """Prompt text per listing, to be answered elsewhere and read back as replies."""
    k = F.col
    payload = replies.listing_json(
        k("title"), k("rent_eur"), k("condo_fee_eur"), k("area_sqm"), k("rooms"), k("location_hint"), k("raw_snippet")
    )
    return listings.select(k("id").alias("listing_id"), replies.prompt(c, payload).alias("prompt"))


def counters(classified: DataFrame) -> DataFrame:
    """Scoring counters from a table with ``outcome`` (cache, hard, scored) and ``distance_to_ref_m``."""
    def count(condition):
        return F.count(F.when(condition, 1))

    scored = F.col("outcome") == "scored"
    return classified.agg(
        F.count("*").alias("examined"),
        count(F.col("outcome") == "cache").alias("skipped_cache"),
        count(F.col("outcome") == "hard").alias("skipped_hard"),
        count(scored).alias("scored"),
        count(scored & F.col("distance_to_ref_m").isNotNull()).alias("geocoded"),
        count(scored & F.col("distance_to_ref_m").isNull()).alias("geocode_missing"),
    )
