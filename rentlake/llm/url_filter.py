"""URL filter by a dated list: which entry was in force when a page was fetched.

An entry names a host, a domain with all below it, or a path below a host.  The entries of a
pattern follow one another: each holds from its date until the next entry of the pattern or
its own expiry.  A capture asks for every pattern it could match; entries and questions are put
in one order of time, and each question takes the last entry before it (an as-of join).
Positions are cut into chunks and only chunk ends travel, so a host with a third of all
captures fills no task.  Of the entries in force the most specific decides.

Defined cases: at equal times an entry holds for the capture, and of entries of one pattern at
one time the largest id comes last; an entry without pattern, kind, action or date is left
out; a capture without a URL that names a host, or without a time, gets ``none``; repeated
rows are judged one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rentlake.operators.ordered import chunk, numbered, with_previous
from rentlake.session import cut_lineage

#: Kinds of patterns, the more specific the higher.
KINDS = {"domain": 1, "host": 2, "path": 3}
#: Action that ends what an earlier entry of the pattern said.
REMOVE = "remove"

_AUTHORITY = r"(?i)\A\s*[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?"


def host(url: Column) -> Column:
    """Lower-case host; null if the URL names none."""
    return F.nullif(F.regexp_replace(F.lower(F.regexp_extract(url, _AUTHORITY + r"([^/?#:@\s]+)", 1)), r"\.\z", ""), F.lit(""))


def path(url: Column) -> Column:
    return F.regexp_extract(url, _AUTHORITY + r"[^/?#]+([^?#]*)", 1)


def patterns(url: Column) -> Column:
    """All patterns a URL can match: (kind, pattern)."""
    name, labels = host(url), F.split(host(url), r"\.")
    pair = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("pattern"))
    ends = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: pair("domain", F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    segments = F.filter(F.split(path(url), "/"), lambda x: x != "")
    n = F.size(segments)
    paths = F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: pair("path", F.concat_ws("/", name, F.array_join(F.slice(segments, F.lit(1), i), "/")))))
    return F.when(name.isNotNull(), F.concat(F.array(pair("host", name)), ends, F.coalesce(paths, F.array().cast("array<struct<kind: string, pattern: string>>"))))


def judge(captures: DataFrame, entries: DataFrame, key: str = "page_id", url: str = "url", fetched: str = "fetched_at") -> DataFrame:
    """One row per capture: key, url, time, ``verdict`` (the action in force, or none), ``kind``, ``pattern`` and ``entry_id``.

    ``entries`` has entry_id, kind, pattern, action, listed_at and expires_at (may be null).
    """
    c = F.col
    rows = captures.select(c(key).alias("key"), c(url).alias("url"), c(fetched).cast("timestamp").alias("at"))
    rows = cut_lineage(rows.withColumn("row", F.monotonically_increasing_id()))
    dated = entries.select("kind", "pattern", c("listed_at").cast("timestamp").alias("at"), F.struct("entry_id", "action", c("expires_at").cast("timestamp").alias("until")).alias("entry"))
    dated = dated.where(c("kind").isin(*KINDS) & c("pattern").isNotNull() & c("at").isNotNull() & c("entry.action").isNotNull())
    asked = rows.where(c("at").isNotNull()).select("row", "at", F.explode(patterns(c("url"))).alias("p")).select("row", "at", "p.*")
    listed = dated.select("kind", "pattern").distinct()
    asked = asked.join(listed, ["kind", "pattern"], "left_semi")
    both = dated.unionByName(asked, allowMissingColumns=True).withColumns({"late": c("row").isNotNull(), "entry_id": c("entry.entry_id")})
    ordered, _ = numbered(both, "at", "late", "entry_id")
    found = with_previous(ordered, ["kind", "pattern"], chunk(), ["pos"], ["entry"]).where("late")
    e = c("prev_entry")
    in_force = found.where(e.isNotNull() & (e["action"] != REMOVE) & (e["until"].isNull() | (e["until"] > c("at"))))
    rank = F.lit(0)
    for kind, n in KINDS.items():
        rank = F.when(c("kind") == kind, F.lit(n)).otherwise(rank)
    best = in_force.groupBy("row").agg(F.max(F.struct(rank.alias("rank"), F.length("pattern").alias("size"), "kind", "pattern", e["action"].alias("action"), e["entry_id"].alias("entry_id"))).alias("b"))
    return rows.join(best, "row", "left").select(
        c("key").alias(key), c("url").alias(url), c("at").alias(fetched), F.coalesce("b.action", F.lit("none")).alias("verdict"), c("b.kind").alias("kind"), c("b.pattern").alias("pattern"), c("b.entry_id").alias("entry_id")
    )
