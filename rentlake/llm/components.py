"""Connected components of links that no machine could hold together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentlake.session import cut_lineage


def _is_star(links: DataFrame) -> bool:
    """Whether every node has one smaller partner, and no partner has one of its own."""
    ends = links.select(F.col("u").alias("node"), F.lit(1).alias("up")).unionAll(links.select("v", F.lit(0)))
    return ends.groupBy("node").agg(F.sum("up").alias("ups"), F.min("up").alias("least")).where("ups > 1 or (ups = 1 and least = 0)").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for the ends of ``links`` (a, b): the smallest node reachable.

    Alternating stars: every node hangs its larger, then its smaller partners on the smallest
    of them.  Each round is two aggregates and two joins over the links and is written to
    the shared folder; the number of rounds grows with the logarithm of the longest path.
    A null end is no link; a link from a node to itself makes it a component.
    """
    links = links.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u is not null and v is not null")
    alone = links.where("u = v").select(F.col("u").alias("node"))
    links = cut_lineage(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while not _is_star(links):
        both = links.unionAll(links.select("v", "u"))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = large.where("u <> v").distinct()
        least = links.groupBy("u").agg(F.min("v").alias("m"))
        small = links.join(least, "u")
        hung = small.select("u", F.col("m").alias("v")).unionAll(small.where("v <> m").select("v", "m"))
        links = cut_lineage(hung.distinct())
    found = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    ends = found.select("component").distinct().select(F.col("component").alias("node"), "component")
    lone = alone.distinct().join(found.unionAll(ends), "node", "left_anti").select("node", F.col("node").alias("component"))
    return found.unionAll(ends).unionAll(lone)
