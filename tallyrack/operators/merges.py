"""Joins that enrich, match, merge and compare tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .history import like_others


def first_alias(reference: DataFrame, key: Callable[[Column], Column], name: str, aliases: str, order: str) -> DataFrame:
    """(alias_key, ...): a row for each name and alias; the first in order holds a key."""
    rows = reference.withColumn("alias", F.explode(F.concat(F.array(F.col(name)), F.coalesce(F.col(aliases), F.array().cast("array<string>")))))
    rows = rows.withColumn("alias_key", key(F.col("alias"))).where(F.col("alias_key") != "")
    w = Window.partitionBy("alias_key").orderBy(order)
    return rows.withColumn("n_alias", F.row_number().over(w)).where("n_alias = 1").drop("n_alias", "alias")


def enriched(df: DataFrame, found: DataFrame, on: str, fill: dict[str, str]) -> DataFrame:
    """Left join that fills only what is unknown: ``fill`` maps columns to the found table's."""
    have = found.select(on, *[F.col(b).alias(f"found_{b}") for b in set(fill.values())])
    joined = df.join(have, on, "left")
    return joined.withColumns({a: F.coalesce(a, f"found_{b}") for a, b in fill.items()}).drop(*[f"found_{b}" for b in set(fill.values())])


def upsert(fresh: DataFrame, before: DataFrame, key: str, keep_before: list[str], fresh_first: list[str]) -> DataFrame:
    """Fresh rows with what an earlier run knew: columns of ``keep_before`` stay the earlier
    ones where known, those of ``fresh_first`` are filled where the fresh row is silent."""
    old = before.select(key, *[F.col(c).alias(f"old_{c}") for c in {*keep_before, *fresh_first}])
    joined = fresh.join(old, key, "left")
    merged = {c: F.coalesce(f"old_{c}", c) for c in keep_before} | {c: F.coalesce(c, f"old_{c}") for c in fresh_first}
    return joined.withColumns(merged).select(*fresh.columns)


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join of rows whose key is unique on either side; null keys match nothing."""
    known = lambda df: df.where(" and ".join(f"`{k}` is not null" for k in keys))
    single = lambda df: known(df).groupBy(*keys).agg(F.count("*").alias("rows_of_key")).where("rows_of_key = 1").drop("rows_of_key")
    return left.join(single(left), keys, "left_semi").join(right.join(single(right), keys, "left_semi"), keys)


def best_match(left: DataFrame, right: DataFrame, block: list[str], score: Column, left_key: str, right_key: str, least: float) -> DataFrame:
    """For each left row the best right row of its block, by score and of equal ones the smallest key,
    if it scores ``least``: an aggregate over the block join, so no window sorts the pairs."""
    pairs = left.join(right, block).withColumn("score", score).where(F.col("score") >= least)
    best = pairs.groupBy(left_key).agg(F.min(F.struct((-F.col("score")).alias("minus"), F.col(right_key), F.col("score").alias("score"))).alias("b"))
    return best.select(left_key, F.col(f"b.{right_key}").alias(right_key), F.col("b.score").alias("score"))


def overridden(matches: DataFrame, manual: DataFrame, key: str) -> DataFrame:
    """Manual rows in place of found ones."""
    return matches.join(manual, key, "left_anti").unionByName(manual, allowMissingColumns=True)


def exact_then_subset(names: DataFrame, books: DataFrame, name_key: str, book_key: str, words: Callable[[str], Column], order: str) -> DataFrame:
    """A book entry of equal key, else the first (by ``order``) whose words hold, or are held by,
    the name's words: met through shared words, so only candidates are paired."""
    exact = names.join(books.select(F.col(book_key), F.col(order)), F.col(name_key) == F.col(book_key)).groupBy(name_key).agg(F.min_by(book_key, order).alias("book")).withColumn("how", F.lit("EXACT"))
    rest = names.join(exact, name_key, "left_anti").select(name_key, words(name_key).alias("wa"))
    sides = books.select(book_key, order, words(book_key).alias("wb"))
    met = rest.withColumn("w", F.explode("wa")).join(sides.withColumn("w", F.explode("wb")), "w").drop("w").distinct()
    held = (F.size(F.array_except("wa", "wb")) == 0) | (F.size(F.array_except("wb", "wa")) == 0)
    some = met.where(held).groupBy(name_key).agg(F.min_by(book_key, order).alias("book")).withColumn("how", F.lit("TOKEN_SUBSET"))
    return exact.unionByName(some)


def registry_dedupe(rows: DataFrame, key: str, detail: Column, order: str) -> DataFrame:
    """Of rows with one key, the one of longest detail; ties go to the first."""
    w = Window.partitionBy(key).orderBy(F.desc(F.length(F.coalesce(detail, F.lit("")))), F.asc(order))
    return rows.withColumn("n_key", F.row_number().over(w)).where("n_key = 1").drop("n_key")


def changes(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, change, fields): added, removed, changed (which of ``fields``) or same.

    Nulls are values here: unknown to unknown is no change."""
    a = before.select(key, F.struct(*fields).alias("a"), F.lit(True).alias("was"))
    b = after.select(key, F.struct(*fields).alias("b"), F.lit(True).alias("now"))
    joined = a.join(b, key, "full_outer")
    moved = F.filter(F.array(*[F.when(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), F.lit(f)) for f in fields]), lambda x: x.isNotNull())
    kind = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.size(moved) > 0, "changed").otherwise("same")
    return joined.select(key, kind.alias("change"), F.when(kind == "changed", F.array_join(moved, ",")).otherwise("").alias("fields"))


def verdict(diff: DataFrame, provenance: list[str]) -> DataFrame:
    """One row: substantive if anything but provenance fields has changed, else provenance or none."""
    parts = F.filter(F.split("fields", ","), lambda f: ~f.isin(*provenance) & (f != ""))
    real = F.col("change").isin("added", "removed") | ((F.col("change") == "changed") & (F.size(parts) > 0))
    return diff.agg(F.when(F.count_if(real) > 0, "substantive").when(F.count_if(F.col("change") == "changed") > 0, "provenance").otherwise("none").alias("verdict"))


def market_diff(before: DataFrame, after: DataFrame, shop: str, name: str) -> DataFrame:
    """Per shop: names before and after, and vanished, collapsed (below half), shrank, grew, same."""
    count = lambda df, c: df.groupBy(shop).agg(F.countDistinct(name).alias(c))
    both = count(before, "n_before").join(count(after, "n_after"), shop, "full_outer").fillna(0, ["n_before", "n_after"])
    a, b = F.col("n_before"), F.col("n_after")
    state = F.when(a == 0, "new").when(b == 0, "vanished").when(b * 2 < a, "collapsed").when(b < a, "shrank").when(b > a, "grew").otherwise("same")
    return both.withColumn("state", state)


def carried(taken: DataFrame, before: DataFrame, key: str, stale: Column, paused: DataFrame) -> DataFrame:
    """Today's listings with yesterday's of shops that were not read, are not stale or paused."""
    kept = before.where(~stale).join(taken.select(key).distinct(), key, "left_anti").join(paused.select(key).distinct(), key, "left_anti")
    return taken.unionByName(kept)


def in_register(listings: DataFrame, register: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped) listings; with an empty register all are kept."""
    if register.isEmpty():
        return listings, listings.limit(0)
    return listings.join(register.select(key), key, "left_semi"), listings.join(register.select(key), key, "left_anti")


def merged_sizes(rows: DataFrame, keys: list[str], order: str, flag: str, first_known: list[str], total: str) -> DataFrame:
    """Rows of one product: any flag, first known figures in order, sum of a quantity."""
    known = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in first_known]
    return rows.groupBy(*keys).agg(F.bool_or(flag).alias(flag), *known, F.sum(total).alias(total), F.count("*").alias("n"))


def shared(rows: DataFrame, identity: str, owner: str) -> DataFrame:
    """Identities that more than one owner has, with how many."""
    return rows.where(F.col(identity).isNotNull()).groupBy(identity).agg(F.countDistinct(owner).alias("owners")).where("owners > 1")


def repeated_panels(rows: DataFrame, shop: str, panel: str, strain: str, least: int = 5) -> DataFrame:
    """Panels that one shop shows for several strains: no measurement."""
    return rows.where(F.col(panel).isNotNull()).groupBy(shop, panel).agg(F.countDistinct(strain).alias("strains")).where(F.col("strains") >= least)


def foreign_share(rows: DataFrame, shop: str, brand: str, least_brands: int = 10, below: float = 0.25) -> DataFrame:
    """Shops few of whose brands any other shop vouches for."""
    pairs = rows.where(F.col(brand).isNotNull()).select(shop, brand).distinct()
    vouched = pairs.groupBy(brand).agg(F.count("*").alias("n_shops"))
    seen = pairs.join(vouched, brand).groupBy(shop).agg(F.count("*").alias("brands"), F.count_if(F.col("n_shops") > 1).alias("known"))
    return seen.withColumn("share", F.col("known") / F.col("brands")).where((F.col("brands") >= least_brands) & (F.col("share") < below))


def renamed(gone: DataFrame, standing: DataFrame, shop: str, key: str, test: Callable[[Column, Column], Column]) -> DataFrame:
    """Rows of ``gone`` whose shop still has a like key (semi join within the shop)."""
    named = lambda df, c: df.select(F.col(shop).alias("shop"), F.col(key).alias(c))
    found = like_others(named(gone, "key"), named(standing, "other"), ["shop"], test).select(F.col("shop").alias(shop), F.col("key").alias(key))
    return gone.join(found, [shop, key], "left_semi")


def asof_between(points: DataFrame, known: DataFrame, group: str, at: str, value: str) -> DataFrame:
    """Each point with the last known value at or before it, the next one after it, and the value
    interpolated on the straight line between them.

    One union and two ordered passes; no join."""
    both = known.select(group, at, F.col(value).alias("kv"), F.lit(0).alias("is_point")).unionByName(points.select(group, at, F.lit(None).cast("double").alias("kv"), F.lit(1).alias("is_point")))
    w = Window.partitionBy(group).orderBy(at, "is_point")
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    stamp = F.when(F.col("is_point") == 0, F.struct(F.col(at).alias("x"), F.col("kv").alias("y")))
    rows = both.withColumns({"p": F.last(stamp, ignorenulls=True).over(back), "q": F.first(stamp, ignorenulls=True).over(ahead)}).where("is_point = 1")
    line = F.when(F.col("q.x") == F.col("p.x"), F.col("p.y")).otherwise(F.col("p.y") + (F.col("q.y") - F.col("p.y")) * (F.col(at) - F.col("p.x")) / (F.col("q.x") - F.col("p.x")))
    return rows.select(group, at, F.col("p.y").alias("before"), F.col("q.y").alias("after"), F.coalesce(line, "p.y", "q.y").alias("value"))


def covering(spans: DataFrame, days: DataFrame, key: str) -> DataFrame:
    """(day, n): how many spans (first, last or open) cover each day; days are expanded within a
    span by its own ends, so no pair outside it is made."""
    last = days.agg(F.max("day").alias("top"))
    ends = spans.crossJoin(F.broadcast(last)).withColumn("end", F.least(F.coalesce("last", "top"), "top")).where("first <= end")
    return ends.select(key, F.explode(F.sequence("first", "end")).alias("day")).join(F.broadcast(days.select("day").distinct()), "day").groupBy("day").agg(F.countDistinct(key).alias("n"))
