"""Points of a value by a table of buckets.

Bucket ends and the distinct values are put into one order, where the bucket of a value is the first end at or
above it.  The order is cut into chunks, so neither many values nor many buckets of one version fill a task, and no value
is compared with all buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rentlake.operators.ordered import chunk, numbered, with_next


def points(rows: DataFrame, value: str, buckets: DataFrame, version: str, missing: Column | None = None, out: str = "score") -> DataFrame:
    """Add the points of the first bucket (``version``, ``reach``, ``points``) that reaches the value, 0 beyond all.

    Of buckets with one reach the fewest points count.  A value that is null, negative or not finite gets ``missing``.
    A bucket without reach or points is none; rows whose version is null or has no buckets lie beyond all.
    """
    v = F.col(value).cast("double")
    usable = F.coalesce((v >= 0) & ~F.isnan(v) & (v < float("inf")), F.lit(False))
    values = rows.where(usable & F.col(version).isNotNull()).select(F.col(version).alias("_version"), v.alias("_at")).distinct()
    ends = buckets.where("reach is not null and points is not null").select(F.col(version).alias("_version"), F.col("reach").cast("double").alias("_at"), F.col("points").cast("int").alias("_points"))
    # A value stands before an end at the same place, and of such ends the one with fewest points first.
    both = values.withColumns({"_end": F.lit(0), "_points": F.lit(None).cast("int")}).unionByName(ends.withColumn("_end", F.lit(1)))
    order, _ = numbered(both, "_at", "_end", "_points", "_version")
    reached = with_next(order, ["_version"], chunk(), ["pos"], ["_points"]).where("_end = 0").select("_version", "_at", "next__points")
    joined = rows.withColumn("_value", F.when(usable, v)).join(reached, (F.col(version) == F.col("_version")) & (F.col("_value") == F.col("_at")), "left")
    score = F.when(F.col("_value").isNull(), F.lit(5) if missing is None else missing).otherwise(F.coalesce("next__points", F.lit(0)))
    return joined.select(*[F.col(n) for n in rows.columns if n != out], score.cast("int").alias(out))
