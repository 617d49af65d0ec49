"""Landed messages, MIME parts, headers and feed pages."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rentlake.functions.regex import js
from rentlake.sources.store import Store

MESSAGES = "message_id string, subject string, from_address string, received_at timestamp, html_body string, text_body string"
FEED_PAGES = "page_id string, group_id string, html string, scraped_at timestamp"


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def since(rows: DataFrame, column: str, as_of: Column, hours: int) -> DataFrame:
    """Rows not older than the lookback; the filter reaches the scan."""
    return rows.where(F.col(column) >= as_of - F.make_interval(hours=F.lit(hours)))


def land(store: Store, table: str, version: int, rows: DataFrame, time: str) -> None:
    """Add a landing, laid out by day of ``time``; landing a version again replaces it."""
    store.write(table, version, rows, day=time)


def landed_since(store: Store, table: str, schema: str, time: str, as_of: str, hours: int) -> DataFrame:
    """Landed rows not older than the lookback; older days are neither listed nor read.

    ``as_of`` is a time as text in UTC.  Rows without a time are never recent.
    """
    first = (dt.datetime.fromisoformat(as_of) - dt.timedelta(hours=hours)).date()
    rows = store.read_days(table, schema, first=first)
    return since(rows, time, F.lit(as_of).cast("timestamp"), hours)


def bodies(parts: DataFrame) -> DataFrame:
    """HTML and plain text per message: parts in document order, decoded and joined."""
    data = F.translate(F.col("data"), "-_", "+/")
    text = F.unbase64(data).cast("string")
    known = parts.where(F.col("mime_type").isin("text/html", "text/plain") & (F.length("data") > 0)).withColumn("text", text)

    def joined(mime: str) -> Column:
        rows = F.collect_list(F.when(F.col("mime_type") == mime, F.struct("path", "text")))
        return F.array_join(F.transform(F.array_sort(rows), lambda r: r["text"]), "")

    return known.groupBy("message_id").agg(
        joined("text/html").alias("html_body"), joined("text/plain").alias("text_body")
    )


def header(headers: Column, name: str) -> Column:
    """First header of that name, upper or lower case alike; '' if there is none."""
    hits = F.filter(headers, lambda h: F.lower(h["name"]) == name.lower())
    return F.coalesce(F.try_element_at(hits, F.lit(1))["value"], F.lit(""))


def mail_date(text: Column) -> Column:
    """Date header without its weekday; NULL if it does not parse."""
    bare = F.regexp_replace(text, js(r"^[A-Za-z]{3},\s*"), "")
    return F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss Z"))


def messages(parts: DataFrame, headers: DataFrame, as_of: str) -> DataFrame:
    """Message table from the landed parts and headers."""
    date = mail_date(F.nullif(header(F.col("headers"), "date"), F.lit("")))
    return headers.join(bodies(parts), "message_id", "left").select(
        "message_id",
        header(F.col("headers"), "subject").alias("subject"),
        header(F.col("headers"), "from").alias("from_address"),
        F.coalesce(date, F.lit(as_of).cast("timestamp")).alias("received_at"),
        F.coalesce("html_body", F.lit("")).alias("html_body"),
        F.coalesce("text_body", F.lit("")).alias("text_body"),
    )
