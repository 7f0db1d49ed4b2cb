"""How well a market is covered: odd shelves, reasons, priorities, work queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shelf_smells(rows: DataFrame, shop: str, name: str, size: str, common_sizes: list[float]) -> DataFrame:
    """(shop, smell): shelves that were probably misread.

    odd-sizes: more than a fifth of the rows have unusual sizes; all-unique: from eight names on,
    over 80 % stand nowhere else; tiny: two rows at most.  One pass with two counts a name."""
    elsewhere = rows.select(shop, name).distinct().groupBy(name).agg(F.count("*").alias("n_shops"))
    seen = rows.join(elsewhere, name).groupBy(shop).agg(
        F.count("*").alias("rows"), F.countDistinct(name).alias("names"),
        F.countDistinct(F.when(F.col("n_shops") == 1, F.col(name))).alias("own"),
        F.avg(F.when(F.col(size).isNotNull(), (~F.col(size).isin(*common_sizes)).cast("int"))).alias("odd"),
    )
    smells = F.array(
        F.when(F.col("odd") > 0.2, F.lit("odd-sizes")),
        F.when((F.col("names") >= 8) & (F.col("own") > 0.8 * F.col("names")), F.lit("all-unique")),
        F.when(F.col("rows") <= 2, F.lit("tiny")),
    )
    return seen.select(shop, F.explode(F.filter(smells, lambda s: s.isNotNull())).alias("smell"))


def identical_sets(rows: DataFrame, shop: str, name: str, least: int = 5) -> DataFrame:
    """(signature, shops): sets of at least ``least`` names that several shops show alike."""
    names = rows.groupBy(shop).agg(F.array_sort(F.collect_set(name)).alias("names")).where(F.size("names") >= least)
    return names.groupBy(F.sha1(F.array_join("names", "\n").cast("binary")).alias("signature")).agg(F.count("*").alias("shops")).where("shops > 1")


def opposed(rows: DataFrame, key: str, lineage: str) -> DataFrame:
    """Keys that some rows call sativa and some indica."""
    return rows.groupBy(key).agg(F.bool_or(F.col(lineage) == "SATIVA").alias("s"), F.bool_or(F.col(lineage) == "INDICA").alias("i")).where("s and i").select(key)


def reasons(df: DataFrame, *tests: tuple[str, Column], otherwise: str = "fine") -> DataFrame:
    """Rows by the first reason that applies to them."""
    ladder = None
    for name, test in tests:
        ladder = F.when(test, name) if ladder is None else ladder.when(test, name)
    return df.groupBy(ladder.otherwise(otherwise).alias("reason")).agg(F.count("*").alias("n"))


def priorities(rows: DataFrame, keys: list[str], shop: str, k: int) -> DataFrame:
    """The ``k`` groups that stand in most shops."""
    return rows.groupBy(*keys).agg(F.countDistinct(shop).alias("shops"), F.count("*").alias("listings")).orderBy(F.desc("shops"), F.desc("listings"), *keys).limit(k)


def gap_histogram(rows: DataFrame, known: DataFrame, key: str, shop: str, top: int = 10) -> DataFrame:
    """Of keys that are not known: how many stand in how many shops, counts from ``top`` on as one."""
    gap = rows.join(known.select(key).distinct(), key, "left_anti").groupBy(key).agg(F.countDistinct(shop).alias("shops"))
    return gap.groupBy(F.least("shops", F.lit(top)).alias("shops")).agg(F.count("*").alias("keys"))


def endpoint_gaps(shops: DataFrame, reads: DataFrame, key: str, rows: str, refused: str, least: int) -> DataFrame:
    """(key, gap): shops never read, refused, empty, or read shorter than expected."""
    joined = shops.select(key).join(reads.select(key, rows, refused, F.lit(True).alias("read")), key, "left")
    gap = F.when(F.col("read").isNull(), "never").when(F.col(refused), "refused").when(F.col(rows) == 0, "empty").when(F.col(rows) < least, "short")
    return joined.select(key, gap.alias("gap")).where("gap is not null")


def unique_or_null(df: DataFrame, keys: list[str], first: str, second: str) -> DataFrame:
    """One value a group: the only ``first``, else, without any, the only ``second``, else null."""
    found = df.groupBy(*keys).agg(F.collect_set(first).alias("a"), F.collect_set(second).alias("b"))
    value = F.when(F.size("a") == 1, F.get("a", 0)).when((F.size("a") == 0) & (F.size("b") == 1), F.get("b", 0))
    return found.select(*keys, value.alias("value"))


def latest(df: DataFrame, keys: list[str], at: str) -> DataFrame:
    """The newest row of each key."""
    return df.withColumn("n_at", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(at)))).where("n_at = 1").drop("n_at")


def cumulative_coverage(rows: DataFrame, brand: str, item: str, k: int) -> DataFrame:
    """Of the ``k`` brands with most items: how many items the first 1, 2, ... of them cover.

    An item counts at the first brand that has it, so sums of new items are the union's size."""
    top = rows.groupBy(brand).agg(F.countDistinct(item).alias("n")).orderBy(F.desc("n"), brand).limit(k)
    ranked = F.broadcast(top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), brand))))
    first = rows.join(ranked, brand).groupBy(item).agg(F.min("place").alias("place")).groupBy("place").agg(F.count("*").alias("fresh"))
    counted = ranked.select("place").join(first, "place", "left").withColumn("fresh", F.coalesce("fresh", F.lit(0)))
    return counted.select("place", F.sum("fresh").over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, 0)).alias("covered"))


def overlay(base: DataFrame, evidence: DataFrame, key: str, fields: list[str], core: list[str]) -> DataFrame:
    """Evidence written where it says something (never a null or false over a value), and HIGH
    confidence where all core fields are then known."""
    have = evidence.select(key, *[F.col(f).alias(f"new_{f}") for f in fields])
    out = base.join(have, key, "left").withColumns({f: F.coalesce(f"new_{f}", f) for f in fields}).drop(*[f"new_{f}" for f in fields])
    known = None
    for f in core:
        known = F.col(f).isNotNull() if known is None else known & F.col(f).isNotNull()
    return out.withColumn("confidence", F.when(known, "HIGH").otherwise("MEDIUM"))
