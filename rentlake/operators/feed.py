"""Group feed pages to posts, and posts to listing drafts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rentlake import fixed_values as V
from rentlake.functions import amounts, posts, urls
from rentlake.functions.regex import collapse, cut, exploded, js

_POST_LINK = r"(?i)/groups/([^/\"<>\s]+)/posts/(\d+)"
_HREF = r'(?i)href="([^"]*)"'


def _post_id(text: Column, group_id: Column) -> Column:
    """Number of the first link to a post of this group."""
    groups = F.regexp_extract_all(text, F.lit(_POST_LINK), F.lit(1))
    numbers = F.regexp_extract_all(text, F.lit(_POST_LINK), F.lit(2))
    at = F.array_position(F.transform(groups, F.lower), F.lower(group_id))
    return F.when(at > 0, F.try_element_at(numbers, at.cast("int")))


def _hrefs(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(_HREF), F.lit(1))


def _firsts(array: str, key: str) -> Column:
    """Elements whose key occurs for the first time."""
    keys = F.transform(array, lambda x: x[key])
    return F.filter(array, lambda x, i: F.array_position(keys, x[key]) == i + 1)


def posts_of_pages(pages: DataFrame) -> DataFrame:
    """Posts of the article blocks, else of the whole page; bare links if that finds none.

    A page is one row, so the choice between the three readings is made inside the row, and
    so are repeated posts dropped: nothing is shuffled.
    """
    html = F.col("html")
    blocks = F.regexp_extract_all(html, F.lit(js(V.ARTICLE)), F.lit(1))
    chunks = F.when(F.size(blocks) > 0, blocks).otherwise(F.array(html))
    staged = pages.select(
        "page_id", "group_id", "scraped_at", "html",
        F.transform(chunks, lambda c: F.struct(c.alias("chunk"), _post_id(c, F.col("group_id")).alias("post_id"))).alias("found"),
    ).withColumn("found", F.filter("found", lambda f: f["post_id"].isNotNull()))
    links = F.transform(
        _hrefs(html),
        lambda h: F.struct(F.lit(None).cast("string").alias("chunk"), _post_id(h, F.col("group_id")).alias("post_id"), h.alias("href")),
    )
    rows = F.when(
        F.size("found") > 0,
        F.transform("found", lambda f: F.struct(f["chunk"].alias("chunk"), f["post_id"].alias("post_id"), F.lit(None).cast("string").alias("href"))),
    ).otherwise(F.filter(links, lambda f: f["post_id"].isNotNull()))
    kept = staged.withColumn("rows", rows)
    first = exploded(kept, ["page_id", "group_id", "scraped_at"], _firsts("rows", "post_id"), "p").select(
        "page_id", "group_id", "scraped_at", "pos", "p.*"
    )
    mark = F.lower(F.concat(F.lit("/groups/"), F.col("group_id"), F.lit("/posts/"), F.col("post_id")))
    own = F.try_element_at(F.filter(_hrefs(F.col("chunk")), lambda h: F.contains(F.lower(h), mark)), F.lit(1))
    href = posts.decode_href(F.coalesce(own, F.col("href"), F.lit("")))
    message = posts.cut_at_comments(cut(collapse(posts.strip_html(F.col("chunk"))), 4000))
    return first.select(
        "page_id", "group_id", "post_id", "pos",
        urls.post_permalink(href, F.col("group_id"), F.col("post_id")).alias("permalink"),
        F.coalesce(message, F.lit("")).alias("message"),
        F.col("scraped_at").alias("posted_at"),
    )


def once_across_groups(found: DataFrame, order: str, since: Column) -> DataFrame:
    """First sighting of each post; old posts without text are dropped."""
    others = [c for c in found.columns if c not in ("post_id", order)]
    return (
        found.groupBy("post_id")
        .agg(F.min(F.struct(order, *others)).alias("p"))
        .select("post_id", "p.*")
        .where(~((F.col("posted_at") < since) & (F.length("message") == 0)))
    )


def post_drafts(found: DataFrame) -> DataFrame:
    """One draft per portal URL of a post, else one for the post itself if it says enough.

    ``found`` has one row per post.
    """
    staged = found.withColumn("text", posts.clean(F.col("message"))).withColumn("links", urls.urls_in(F.col("text")))
    pairs = F.transform("links", lambda u: F.struct(urls.canonical(u).alias("canonical_url"), u.alias("url")))
    kept = F.filter(pairs, lambda p: p["canonical_url"].isNotNull() & urls.is_portal_or_listing(p["canonical_url"]))
    staged = staged.withColumn("links", kept)
    own = F.array(F.struct(F.col("permalink").alias("canonical_url"), F.lit(None).cast("string").alias("url")))
    rows = F.when(F.size("links") > 0, F.col("links")).when(F.length("text") >= 30, own)
    carried = ["post_id", "permalink", "message", "text", *(c for c in ("posted_at",) if c in found.columns)]
    first = exploded(staged.withColumn("rows", rows), carried, _firsts("rows", "canonical_url"), "l").select(*carried, "pos", "l.*")
    linked = cut(F.concat_ws(" ", "text", "url"), 500)
    block = F.col("block")
    target = F.coalesce(F.col("url"), F.col("permalink"))
    read = first.withColumn("block", F.when(F.col("url").isNotNull(), linked).otherwise(F.col("text")))
    return amounts.with_rent(read, "block", "rent_eur").select(
        "post_id",
        "canonical_url",
        F.when(F.startswith(target, F.lit("http")), target).otherwise(F.col("permalink")).alias("listing_url"),
        F.lit(V.POST_SOURCE).alias("source"),
        F.col("post_id").cast("string").alias("external_id"),
        posts.post_title(F.col("text")).alias("title"),
        posts.place_hint(block).alias("location_hint"),
        "rent_eur",
        amounts.condo_fee(block).alias("condo_fee_eur"),
        amounts.area(block).alias("area_sqm"),
        amounts.rooms(block).alias("rooms"),
        cut(block, 400).alias("raw_snippet"),
        *carried[2:3],
        *carried[4:],
    )
