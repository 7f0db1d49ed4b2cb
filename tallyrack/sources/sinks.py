"""Writers: whole tables, a folder a shop, archives that only grow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def overwrite_sorted(df: DataFrame, path: str, *order: str, form: str = "json") -> None:
    """Replace a table by its rows in order; nothing is replaced by nothing."""
    if df.isEmpty():
        raise ValueError(f"refusing to overwrite {path} with no rows")
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").format(form).save(path)


def per_shop(df: DataFrame, path: str, key: str = "licenseNumber") -> None:
    """A folder for each shop; hot shops are spread over files, small ones have one."""
    df.withColumn("part_key", F.col(key)).repartition(key).write.mode("overwrite").partitionBy("part_key").option("maxRecordsPerFile", 500_000).json(path)


def append_distinct(df: DataFrame, path: str, keys: list[str]) -> None:
    """Add the rows whose keys the table lacks."""
    spark = df.sparkSession
    try:
        have = spark.read.parquet(path).select(*keys)
    except Exception as e:  # the first write
        if "PATH_NOT_FOUND" not in str(e):
            raise
        df.dropDuplicates(keys).write.parquet(path)
        return
    df.dropDuplicates(keys).join(have, keys, "left_anti").write.mode("append").parquet(path)


def daily(df: DataFrame, path: str, day: str = "day") -> None:
    """A snapshot table, a folder a day; writing a day again replaces that day only."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def publishable(diff: DataFrame) -> DataFrame:
    """One row: whether any shelf vanished or collapsed, so that nothing is published."""
    return diff.agg((F.count_if(F.col("state").isin("vanished", "collapsed")) > 0).alias("broken"), F.count_if(F.col("state").isin("vanished", "collapsed")).alias("n"))
