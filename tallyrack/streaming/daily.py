"""Day-ordered readings as a stream: one micro-batch appends days, signals follow from tables.

Event time is the reading day.  A sweep is closed once a later day has been read: rows of closed
days are dropped, as if the watermark had no delay; the last day stays open, so a day that the
source deals over several micro-batches is whole.  The readings are a table partitioned by day,
so what a batch needs is found by partition pruning; the rules themselves are those of
``operators.history``, so replaying many days and folding one by one agree by construction.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import history

READINGS = "lic bigint, day date, key string"
KEEP_DAYS = 60


def last_sweep(spark: SparkSession, path: str):
    """The last day of the readings' table, or None before the first batch."""
    try:
        return spark.read.schema(READINGS).parquet(path).agg(F.max("day").alias("d")).first()["d"]
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def fold_batch(batch: DataFrame, path: str) -> int:
    """Append a batch's rows of days that are not closed; returns how many rows were added.

    Rows that are there are not added again, so a batch that is tried again adds nothing."""
    spark = batch.sparkSession
    last = last_sweep(spark, path)
    fresh = batch.select("lic", "day", "key").where("lic is not null and day is not null and key is not null").distinct()
    if last is not None:
        there = spark.read.schema(READINGS).parquet(path).where(F.col("day") >= F.lit(last))
        fresh = fresh.where(F.col("day") >= F.lit(last)).join(there, ["lic", "day", "key"], "left_anti")
    fresh = fresh.persist()
    try:
        n = fresh.count()
        if n:
            fresh.write.mode("append").partitionBy("day").parquet(path)
    finally:
        fresh.unpersist()
    return n


def readings(spark: SparkSession, path: str, day=None) -> DataFrame:
    """The readings of the last ``KEEP_DAYS`` days to ``day`` (all if none is given)."""
    df = spark.read.schema(READINGS).parquet(path)
    return df if day is None else df.where((F.col("day") <= F.lit(day)) & (F.col("day") >= F.date_sub(F.lit(day), KEEP_DAYS)))


def open_from(spark: SparkSession, path: str, first_day):
    """The first day whose candidates a batch that begins on ``first_day`` can still change: those
    of ``CONFIRM_WITHIN`` + 1 sweeps before it."""
    days = spark.read.schema(READINGS).parquet(path).where(F.col("day") < F.lit(first_day)).select("day").distinct()
    before = days.orderBy(F.desc("day")).limit(history.CONFIRM_WITHIN + 1).agg(F.min("day").alias("d")).first()["d"]
    return before or first_day


def fold_signals(spark: SparkSession, path: str, signals: str, first_day) -> None:
    """Write the candidates anew that are not settled, from the readings of ``KEEP_DAYS`` days before
    them; the table is partitioned by day, and settled days stay as they are."""
    begin = open_from(spark, path, first_day)
    rows = spark.read.schema(READINGS).parquet(path).where(F.col("day") >= F.date_sub(F.lit(begin), KEEP_DAYS))
    found = history.candidates(rows).where(F.col("seen") >= F.lit(begin))
    found.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("seen").parquet(signals)


def start(stream: DataFrame, path: str, checkpoint: str, signals: str | None = None) -> StreamingQuery:
    """Fold a stream of readings; after each batch the unsettled days of the signals' table follow."""

    def run(batch: DataFrame, _: int) -> None:
        first = batch.agg(F.min("day").alias("d")).first()["d"]
        if fold_batch(batch, path) and signals:
            fold_signals(batch.sparkSession, path, signals, first)

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def presence_updates(stream: DataFrame) -> DataFrame:
    """(lic, key, first, last, state) as it changes, with state kept per shop.

    A shop's state is its keys with first and last day and the day of its last reading; it holds
    one shelf, whatever the length of the stream."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        keys, firsts, lasts, open_, read = state.get if state.exists else ([], [], [], [], None)
        held = {k: [f, last, bool(o)] for k, f, last, o in zip(keys, firsts, lasts, open_, strict=True)}
        rows = pd.concat(list(frames))
        out = []
        for day, shelf in sorted(rows.groupby("day"), key=lambda x: x[0]):
            if read is not None and str(day) <= read:
                continue
            now = set(shelf["key"])
            for k in sorted(now):
                old = held.get(k)
                if old is None or not old[2]:
                    out.append((key[0], k, str(old[0] if old else day), None, "returned" if old else "new"))
                held[k] = [old[0] if old else str(day), str(day), True]
            for k in sorted(set(held) - now):
                if held[k][2]:
                    held[k][2] = False
                    out.append((key[0], k, held[k][0], held[k][1], "departed"))
            read = str(day)
        listed = sorted(held)
        state.update((listed, [held[k][0] for k in listed], [held[k][1] for k in listed], [int(held[k][2]) for k in listed], read))
        yield pd.DataFrame(out, columns=["lic", "key", "first", "last", "state"])

    return stream.groupBy("lic").applyInPandasWithState(
        update,
        "lic bigint, key string, first string, last string, state string",
        "keys array<string>, firsts array<string>, lasts array<string>, open array<int>, read string",
        "append",
        GroupStateTimeout.NoTimeout,
    )


def windowed_counts(stream: DataFrame, at: str, key: str, days: int = 7) -> DataFrame:
    """Events of a key in sliding windows of some days, late ones dropped by watermark."""
    return stream.withWatermark(at, "1 day").groupBy(F.window(at, f"{days} days", "1 day"), key).agg(F.count("*").alias("n"))
