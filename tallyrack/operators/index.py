"""The shelf index: shops, strains and brands out of listings.

Functions take DataFrames and column names, so they bind to any table of the right shape.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tied_mode(df: DataFrame, keys: list[str], value: str, out: str = "mode") -> DataFrame:
    """The commonest value of each group; of equally common ones, one not in capitals, then the
    first in binary order."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    shout = F.when((F.upper(value) == F.col(value)) & F.col(value).rlike("[A-Z]"), 1).otherwise(0)
    # an aggregate, not a window: it combines before the shuffle, so a common key is no burden
    best = F.min(F.struct((-F.col("n")).alias("n"), shout.alias("s"), F.col(value).alias("v")))
    return counted.groupBy(*keys).agg(best.alias("b")).select(*keys, F.col("b.v").alias(out), (-F.col("b.n")).alias(f"{out}_count"))


def plurality(df: DataFrame, keys: list[str], value: str, weight: str, out: str = "plurality") -> DataFrame:
    """The value with most distinct ``weight``; null if two are level."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.countDistinct(weight).alias("n"))
    top = counted.groupBy(*keys).agg(F.max("n").alias("top"), F.sort_array(F.collect_list(F.struct("n", value)), asc=False).alias("r"))
    second = F.get(F.col("r"), 1)["n"]
    return top.select(*keys, F.when(second.isNull() | (second < F.col("top")), F.get(F.col("r"), 0)[value]).alias(out))


def register_stats(shops: DataFrame, region: str, opened: Column, checked: str) -> DataFrame:
    """One row: how many shops, how many open, how many regions, when last checked."""
    return shops.agg(F.count("*").alias("shops"), F.count_if(opened).alias("open"), F.countDistinct(region).alias("regions"), F.max(checked).alias("checked"))


def by_region(shops: DataFrame, region: str) -> DataFrame:
    return shops.groupBy(region).agg(F.count("*").alias("shops"))


def debts(df: DataFrame, **tests: Column) -> DataFrame:
    """One row of conditional counts; a null test counts as unknown, not as a debt."""
    return df.agg(*[F.count_if(c).alias(n) for n, c in tests.items()])


def listing_counts(shops: DataFrame, listings: DataFrame, key: str, keep_zero: bool = False) -> DataFrame:
    """Listings per shop; shops without any are absent or have 0."""
    counted = listings.groupBy(key).agg(F.count("*").alias("listings"))
    how = "left" if keep_zero else "inner"
    return shops.select(key).join(counted, key, how).withColumn("listings", F.coalesce("listings", F.lit(0)).cast("bigint"))


def strain_index(listings: DataFrame, strain: str, shop: str, name: str, size: str, thc: str) -> DataFrame:
    """A row a strain: shops, listings, smallest and largest size, number of sizes, highest
    figure and commonest spelling."""
    out = listings.groupBy(strain).agg(
        F.countDistinct(shop).alias("shops"), F.count("*").alias("listings"), F.min(size).alias("least_size"), F.max(size).alias("most_size"),
        F.size(F.collect_set(size)).cast("bigint").alias("sizes"), F.max(thc).alias("most"),
    )
    return out.join(tied_mode(listings, [strain], name, "spelling"), strain)


def brand_summaries(listings: DataFrame, brand: str, strain: str, shop: str) -> DataFrame:
    return listings.where(F.coalesce(F.col(brand), F.lit("")) != "").groupBy(brand).agg(F.countDistinct(strain).alias("strains"), F.countDistinct(shop).alias("shops"), F.count("*").alias("listings"))


def size_chips(listings: DataFrame, shop: str, size: str) -> DataFrame:
    """The sizes of each shop, ascending, as text."""
    sizes = F.array_sort(F.collect_set(size))
    return listings.groupBy(shop).agg(F.array_join(F.transform(sizes, lambda s: F.concat(s.cast("bigint").cast("string"), F.lit(" g"))), ", ").alias("sizes"))


def figures(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Median, least, most and number of the values above zero, to two decimals."""
    return df.where(F.col(value) > 0).groupBy(*keys).agg(
        F.round(F.percentile(value, 0.5), 2).alias("median"), F.round(F.min(value), 2).alias("low"), F.round(F.max(value), 2).alias("high"), F.count("*").alias("n")
    )


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group; Spark prunes groups before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


def leading(panels: DataFrame, panel: str, compound: str, percent: str, keys: list[str], k: int = 3) -> DataFrame:
    """The ``k`` compounds that most often are among the first ``k`` of a panel; ties go to the
    higher median."""
    first = top_per_group(panels, [*keys, panel], [F.desc(percent), F.asc(compound)], k)
    counted = first.groupBy(*keys, compound).agg(F.count("*").alias("panels"), F.round(F.percentile(percent, 0.5), 4).alias("median"))
    return top_per_group(counted, keys, [F.desc("panels"), F.desc("median"), F.asc(compound)], k, "place")


def directory(shops: DataFrame, status: Column, region: str, name: str) -> DataFrame:
    """Shops ranked open, unknown, closed, others; then by region and name."""
    place = F.when(status == "open", 0).when(status.isNull() | (status == "unknown"), 1).when(status == "closed", 2).otherwise(3)
    return shops.withColumn("place", place).orderBy("place", region, name)


def search(df: DataFrame, text: str, *columns: str) -> DataFrame:
    """Rows in which any of the columns holds the text, without regard to case."""
    return df.where(F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(text.lower())))


def fresh(df: DataFrame, at: str, hours: int = 24) -> DataFrame:
    """Rows within some hours of the newest one; that one value is a scalar join."""
    newest = df.agg(F.max(at).alias("newest_at"))
    return df.crossJoin(F.broadcast(newest)).where(F.col(at) >= F.col("newest_at") - F.expr(f"interval {hours} hours"))


def member_of(county: Column, state: Column, within: str, counties: list[str] | None, besides: list[str] | None) -> Column:
    """Whether a place belongs to a territory; an unknown county does not."""
    inside = county.isin(*counties) if counties else ~county.isin(*(besides or [""]))
    return F.coalesce((state == within) & inside, F.lit(False))


def suffixed_slugs(df: DataFrame, slug: str, order: list[Column], out: str = "slug_final") -> DataFrame:
    """Equal slugs get -2, -3, ... in order; rows whose new slug is taken already get the next
    free number by counting on from the number of all rows of that base."""
    w = Window.partitionBy(slug).orderBy(*order)
    numbered = df.withColumn("n_slug", F.row_number().over(w))
    named = numbered.withColumn(out, F.when(F.col("n_slug") == 1, F.col(slug)).otherwise(F.concat(F.col(slug), F.lit("-"), F.col("n_slug"))))
    taken = df.select(F.col(slug).alias(out)).distinct().withColumn("taken", F.lit(True))
    total = F.count("*").over(Window.partitionBy(slug))
    again = named.withColumn("total", total).join(taken, out, "left")
    bumped = F.concat(F.col(slug), F.lit("-"), F.col("total") + F.col("n_slug"))
    return again.withColumn(out, F.when((F.col("n_slug") > 1) & F.col("taken"), bumped).otherwise(F.col(out))).drop("n_slug", "total", "taken")


def zero_filled(days: DataFrame, counted: DataFrame, day: str = "day", n: str = "n") -> DataFrame:
    """Counts for every day, 0 where there is none; an empty last day is left out."""
    filled = days.select(day).distinct().join(counted, day, "left").withColumn(n, F.coalesce(n, F.lit(0)).cast("bigint"))
    last = filled.agg(F.max(day).alias("last_day"))
    return filled.crossJoin(F.broadcast(last)).where(~((F.col(day) == F.col("last_day")) & (F.col(n) == 0))).drop("last_day")


def budget(queue: DataFrame, fresh_test: Column, newest: Column, oldest: Column, total: int, reserve: int, key: str) -> DataFrame:
    """What fits a budget: new work newest first, and rechecks oldest first with a reserve."""
    new = queue.where(fresh_test).orderBy(newest, F.asc(key)).limit(total).withColumn("turn", F.row_number().over(Window.orderBy(newest, F.asc(key))))
    old = queue.where(~fresh_test).orderBy(oldest, F.asc(key)).limit(total).withColumn("turn", F.row_number().over(Window.orderBy(oldest, F.asc(key))))
    n_new, n_old = new.agg(F.count("*").alias("n_new")), old.agg(F.count("*").alias("n_old"))
    room = F.greatest(F.lit(total) - F.least(F.col("n_old"), F.lit(reserve)), F.lit(0))
    taken_new = new.crossJoin(F.broadcast(n_old)).where(F.col("turn") <= room).drop("n_old").withColumn("kind", F.lit("new"))
    rest = F.lit(total) - F.least(F.col("n_new"), F.greatest(F.lit(total) - F.least(F.col("n_old"), F.lit(reserve)), F.lit(0)))
    taken_old = old.crossJoin(F.broadcast(n_new)).crossJoin(F.broadcast(n_old)).where(F.col("turn") <= rest).drop("n_new", "n_old").withColumn("kind", F.lit("recheck"))
    return taken_new.unionByName(taken_old)
