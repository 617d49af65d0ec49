"""Values of neighbouring rows and first rows per key, safe for hot keys.

A plain window puts a whole key into one task.  Here rows are numbered in their order and
a key is cut into chunks of at most ``CHUNK`` positions: rows look inside their chunk, and
only the chunk ends, at most one per key and chunk, travel between chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rentlake.session import any_size, cut_lineage

#: Positions in a chunk of the order.
CHUNK = 1 << 16


def numbered(rows: DataFrame, *order: str, outlives: int = 0) -> tuple[DataFrame, int]:
    """Rows written in their order with dense positions ``pos`` 0..n-1, and n; ``outlives`` as in ``cut_lineage``."""
    spark = rows.sparkSession
    tagged = cut_lineage(rows.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()), outlives)
    part = F.shiftright("_id", 33)
    sizes = tagged.groupBy(part.alias("part")).count().orderBy("part").collect()  # one row per partition
    starts, total = [], 0
    for row in sizes:
        starts.append((row["part"], total))
        total += row["count"]
    offsets = F.broadcast(spark.createDataFrame(starts, "part long, start long"))  # one row per partition
    within = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return tagged.join(offsets, part == F.col("part")).withColumn("pos", F.col("start") + within).drop("_id", "part", "start"), total


def chunk() -> Column:
    return F.floor(F.col("pos") / CHUNK)


def _neighbour(df: DataFrame, keys, chunk: Column, order, values, backwards: bool) -> DataFrame:
    keys, order = list(keys), list(order)
    flip = (lambda c: F.col(c).desc()) if backwards else (lambda c: F.col(c).asc())
    rows = df.withColumn("_chunk", chunk)
    near = Window.partitionBy(*keys, "_chunk").orderBy(*map(flip, order)).rowsBetween(Window.unboundedPreceding, -1)
    at = F.struct(*order)
    pick = F.min_by if backwards else F.max_by
    ends = rows.groupBy(*keys, "_chunk").agg(
        *[pick(F.col(v), F.when(F.col(v).isNotNull(), at)).alias(f"_end_{v}") for v in values]
    )
    far = Window.partitionBy(*keys).orderBy(flip("_chunk")).rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.col("_chunk").alias("_c"),
        *[F.last(f"_end_{v}", ignorenulls=True).over(far).alias(f"_carry_{v}") for v in values],
    )
    inside = rows.select("*", *[F.last(v, ignorenulls=True).over(near).alias(f"_in_{v}") for v in values])
    # Plain equality, in the order of the window's keys: rows lie right for the join already.
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & (F.col(k) == F.col(f"_k{i}"))
    same = same & (F.col("_chunk") == F.col("_c"))
    name = "next" if backwards else "prev"
    return inside.join(any_size(carry), same, "left").select(
        *df.columns, *[F.coalesce(f"_in_{v}", f"_carry_{v}").alias(f"{name}_{v}") for v in values]
    )


def with_previous(df: DataFrame, keys, chunk: Column, order, values) -> DataFrame:
    """Add ``prev_<value>``: the last known value of the rows before, per key."""
    return _neighbour(df, keys, chunk, order, values, backwards=False)


def with_next(df: DataFrame, keys, chunk: Column, order, values) -> DataFrame:
    """Add ``next_<value>``: the first known value of the rows after, per key."""
    return _neighbour(df, keys, chunk, order, values, backwards=True)
