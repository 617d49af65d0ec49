from pyspark.sql import functions as F


def each(spark, fn, values, type_="string"):
    """Result of a column function for each value."""
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {type_}")
    return [r[1] for r in rows.select("i", fn(F.col("x")).alias("r")).orderBy("i").collect()]


def each_df(spark, fn, values, type_="string"):
    """Result of a frame function that turns column x into column r."""
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {type_}")
    return [r[0] for r in fn(rows).orderBy("i").select("r").collect()]
