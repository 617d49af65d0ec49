"""Session settings the jobs rely on."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# Times are UTC, and AQE sizes, coalesces and splits the shuffles.  Joins are
# broadcast only below Spark's own size threshold, but for tables of a fixed size.
RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.compression.codec": "zstd",
    # Shuffle files go when the query that made them ends, not when the driver happens to collect its garbage.
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else made."""
    for key, value in RUNTIME.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = "*", name: str = "rentlake", **conf: str) -> SparkSession:
    """Session for tests and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("RENTLAKE_DRIVER_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", "8")
    )
    for key, value in {**RUNTIME, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors see: the one the cluster names, else one below the warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    return named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_cut"


def fresh_folder(spark: SparkSession, name: str) -> str:
    """New folder below the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/rentlake/{name}-{uuid.uuid4().hex}"


_written: ContextVar[tuple[list[str], ...]] = ContextVar("written", default=())  # of each block of ``scratch`` around, the innermost last


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Drop the tables that ``cut_lineage`` writes inside, once the results are written.

    Blocks may stand in each other; a table that an inner block hands on belongs to the one around it.
    """
    paths: list[str] = []
    token = _written.set((*_written.get(), paths))
    try:
        yield
    finally:
        _written.reset(token)
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for path in paths:
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(conf).delete(target, True)


def any_size(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the input: it is not gathered by the driver and sent to every task, however small its
    written columns look (most are alike, and a file's size says little of its rows)."""
    return df.hint("merge")


def cut_lineage(df: DataFrame, outlives: int = 0) -> DataFrame:
    """Write the rows to the shared folder and go on from there.

    A written table instead of an RDD checkpoint: its size is known, so later joins are
    planned on it, and only the columns they need are read back.  It outlives so many of
    the blocks of ``scratch`` around.
    """
    spark = df.sparkSession
    path = fresh_folder(spark, "cut")
    blocks = _written.get()
    if len(blocks) > outlives:
        blocks[-1 - outlives].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
