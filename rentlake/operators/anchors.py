"""Anchors as rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentlake.functions import alerts
from rentlake.functions.regex import collapse, exploded
from rentlake.operators import dom

# An href in double quotes, in single quotes or bare, and what the anchor holds.
ANCHOR = r"""(?is)<a\b[^>]*?\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))[^>]*>(.*?)</a>"""


def flat_anchors(pages: DataFrame, key: str, html: str) -> DataFrame:
    """Position, href and text of every anchor of regular HTML, without leaving the JVM."""
    part = [F.regexp_extract_all(F.col(html), F.lit(ANCHOR), F.lit(n)) for n in (1, 2, 3, 4)]
    found = F.arrays_zip(*[p.alias(n) for p, n in zip(part, ("double", "single", "bare", "inner"))])
    return exploded(pages, [key], found, "a").select(
        key, "pos", F.concat("a.double", "a.single", "a.bare").alias("href"),
        collapse(F.regexp_replace(F.col("a.inner"), "<[^>]*>", " ")).alias("text"),
    )


_CARRIED = ("message_id", "received_at", "subject", "sender", "route", "sale")


#: Anchors of a frame that goes out, and one document's more at most.
_FRAME = 2000


def _scan_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [*_CARRIED, "pos", "href", "text", "block"]
    for batch in batches:
        rows = []
        for scan, html, *carried in zip(batch["scan"], batch["body"], *(batch[c] for c in _CARRIED)):
            rows.extend((*carried, *anchor) for anchor in dom.scan(scan, html))
            if len(rows) >= _FRAME:
                yield pd.DataFrame(rows, columns=columns)
                rows = []
        yield pd.DataFrame(rows, columns=columns)


def message_anchors(messages: DataFrame) -> DataFrame:
    """Anchors with context of routed messages; what parsers need of the message rides along."""
    casa = alerts.from_casa(F.col("from_address"))
    received = F.col("received_at") if "received_at" in messages.columns else F.lit(None)
    wanted = messages.select(
        "message_id",
        received.cast("timestamp").alias("received_at"),
        F.coalesce("subject", F.lit("")).alias("subject"),
        F.coalesce("from_address", F.lit("")).alias("sender"),
        "route",
        F.col("sale") if "sale" in messages.columns else F.lit(False).alias("sale"),
        F.when((F.col("scan") == "generic") & casa, F.lit("casa")).otherwise(F.col("scan")).alias("scan"),
        "body",
    )
    key_type = messages.schema["message_id"].dataType.simpleString()
    return wanted.mapInPandas(
        _scan_batches,
        f"message_id {key_type}, received_at timestamp, subject string, sender string, route string, sale boolean, pos int, href string, text string, block string",
    )
