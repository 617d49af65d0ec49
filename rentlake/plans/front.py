"""From landed raw input to the messages and posts that a run takes in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentlake.operators import feed
from rentlake.sources import landing


def new_messages(parts: DataFrame, headers: DataFrame, as_of: str, hours: int = 26) -> DataFrame:
    """Messages of the lookback, put together from their landed MIME parts and headers."""
    return landing.since(landing.messages(parts, headers, as_of), "received_at", F.lit(as_of).cast("timestamp"), hours)


def new_posts(pages: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    """Posts of the lookback from landed feed pages; a post shared to several groups comes once."""
    since = F.lit(as_of).cast("timestamp") - F.make_interval(hours=F.lit(hours))
    found = feed.posts_of_pages(pages).withColumn("sighting", F.struct("posted_at", "page_id", "pos"))
    return feed.once_across_groups(found, "sighting", since).select("post_id", "group_id", "permalink", "message", "posted_at")
