"""Data-quality rules: every violation is a row (rule, key, severity).

A rule is a test that holds, fails or is unknown; unknown is no violation.  All row rules of a
table are checked in one pass over it (an array of what failed, exploded), not a pass each.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """``holds`` is what a clean row satisfies."""

    name: str
    holds: Column
    severity: str = "fail"


def violations(df: DataFrame, key: str, rules: list[Rule]) -> DataFrame:
    """Rows that fail, for all rules at once."""
    failed = [F.when(~r.holds, F.struct(F.lit(r.name).alias("rule"), F.lit(r.severity).alias("severity"))) for r in rules]
    rows = df.select(F.col(key).cast("string").alias("key"), F.explode(F.filter(F.array(*failed), lambda x: x.isNotNull())).alias("v"))
    return rows.select("v.rule", "key", "v.severity")


def duplicates(df: DataFrame, keys: list[str], rule: str, severity: str = "fail") -> DataFrame:
    """Keys that more than one row has."""
    counted = df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    return counted.select(F.lit(rule).alias("rule"), F.concat_ws("|", *keys).alias("key"), F.lit(severity).alias("severity"))


def orphans(df: DataFrame, parents: DataFrame, key: str, parent_key: str, rule: str, severity: str = "fail") -> DataFrame:
    """Keys without a parent; with no parents at all the rule says nothing."""
    if parents.isEmpty():
        return df.limit(0).select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key"), F.lit(severity).alias("severity"))
    rows = df.where(F.col(key).isNotNull()).select(key).distinct()
    lost = rows.join(parents.select(F.col(parent_key).alias(key)), key, "left_anti")
    return lost.select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key"), F.lit(severity).alias("severity"))


def share_below(df: DataFrame, test: Column, least: float, rule: str, severity: str = "warn") -> DataFrame:
    """One row if fewer than a share of the rows pass."""
    share = df.agg(F.avg(F.coalesce(test, F.lit(False)).cast("int")).alias("share"))
    return share.where(F.col("share") < least).select(F.lit(rule).alias("rule"), F.round("share", 4).cast("string").alias("key"), F.lit(severity).alias("severity"))


def forbidden_columns(df: DataFrame, pattern: str) -> list[str]:
    """Columns that must not be published (prices)."""
    import re

    return [c for c in df.columns if re.search(pattern, c, re.IGNORECASE)]


def in_zip_range(zip_code: Column, county: Column, ranges: dict[str, list[tuple[int, int]]]) -> Column:
    """Whether a ZIP fits its county; null where no range is known."""
    number = F.substring(zip_code, 1, 5).try_cast("int")
    out = None
    for name, spans in ranges.items():
        fits = None
        for a, b in spans:
            fits = number.between(a, b) if fits is None else fits | number.between(a, b)
        out = F.when(county == name, fits) if out is None else out.when(county == name, fits)
    return out if out is not None else F.lit(None).cast("boolean")


def shop_rules() -> list[Rule]:
    """Rules of the shop register (columns of ``sources.schemas.SHOPS``)."""
    has = lambda kind: F.exists("sources", lambda s: s["type"] == kind)
    c = F.col
    return [
        Rule("licence-number", c("licenseNumber").rlike(r"^[A-Z0-9-]+$")),
        Rule("registry-source", has("OFFICIAL_REGISTRY")),
        Rule("open-needs-licence", (c("operationalStatus") != "OPEN") | c("licenseStatus").isin("ACTIVE", "PROVISIONAL")),
        Rule("dead-not-trading", ~c("licenseStatus").isin("SURRENDERED", "REVOKED", "EXPIRED") | (c("operationalStatus") != "OPEN")),
        Rule("unverified-not-high", (c("verification.status") != "UNVERIFIED") | (c("verification.confidence") != "HIGH")),
        Rule("expired-but-live", (c("licenseStatus") != "ACTIVE") | (c("dates.licenseExpiration") >= F.to_date("lastUpdated")), "warn"),
        Rule("geo-range", c("geo.lat").between(-90, 90) & c("geo.lng").between(-180, 180)),
    ]


def listing_rules() -> list[Rule]:
    """Rules of the listings (columns of ``sources.schemas.LISTINGS``)."""
    c = F.col
    kind = c("terpenes.source")
    return [
        Rule("thc-range", c("thcPercent").between(0, 100)),
        Rule("cbd-range", c("cbdPercent").between(0, 100)),
        Rule("terpene-range", F.forall("terpenes.profile", lambda p: p["percent"].isNull() | p["percent"].between(0, 20))),
        Rule("other-needs-name", F.forall("terpenes.profile", lambda p: (p["name"] != "OTHER") | p["rawName"].isNotNull())),
        Rule("certificate-needs-link", (kind != "LAB_COA") | c("terpenes.coaUrl").isNotNull()),
        Rule("none-has-no-profile", (kind != "NONE") | (F.size("terpenes.profile") == 0)),
        Rule("size-range", F.forall("availableSizesGrams", lambda g: g.between(0.5, 85))),
        Rule("packaged-long-ago", F.datediff(F.to_date("capturedAt"), "packagedOn") <= 365, "warn"),
        Rule("not-from-the-future", c("capturedAt") <= F.current_timestamp()),
    ]


#: Closing later than this on the next day is worth a look; counties that are covered.
LATEST_CLOSE = "06:00"
COVERED = ("New York", "Kings", "Queens", "Bronx", "Richmond", "Westchester")
OPT_OUT_DEADLINE = "2021-12-31"


def hours_violations(shops: DataFrame, key: str, week: str, latest: str = LATEST_CLOSE) -> DataFrame:
    """Opening hours that are no interval (fail) or run deep into the next day (warn), a row a slot.

    ``week``: map of day to (state, slots of open and close); a slot that lacks a time says nothing."""
    slots = shops.select(F.col(key).cast("string").alias("key"), F.explode(week).alias("day", "hours")).select("key", "day", F.posexplode("hours.slots").alias("at", "slot"))
    minute = lambda c: F.col(f"slot.{c}").substr(1, 2).try_cast("int") * 60 + F.col(f"slot.{c}").substr(4, 2).try_cast("int")
    opens, closes = minute("open"), minute("close")
    limit = int(latest[:2]) * 60 + int(latest[3:])
    rule = F.when(opens == closes, "hours-empty").when((closes < opens) & (closes > limit), "hours-next-day")
    found = slots.withColumn("rule", rule).where("rule is not null")
    return found.select("rule", F.concat("key", F.lit(":"), "day", F.lit(":"), "at").alias("key"), F.when(F.col("rule") == "hours-empty", "fail").otherwise("warn").alias("severity"))


def municipality_rules() -> list[Rule]:
    """Rules of the municipalities (columns of ``sources.schemas.MUNICIPALITIES``)."""
    c = F.col
    return [
        Rule("no-borough-there", (c("kind") != "BOROUGH") | (c("county") != "Westchester")),
        Rule("opt-out-in-time", c("optOutDate") <= F.lit(OPT_OUT_DEADLINE).cast("date")),
    ]


def reference_rules() -> list[Rule]:
    """Rules of the strain reference (columns of ``sources.schemas.STRAIN_REFERENCE``)."""
    c = F.col
    samples = F.coalesce(c("basis.sampleCount"), F.lit(0))
    return [
        Rule("borrowed-needs-licence", (c("basis.kind") != "EXTERNAL_DATASET") | (F.coalesce(c("basis.datasetLicence"), F.lit("")) != "")),
        Rule("other-needs-name", F.forall("profile", lambda p: (p["name"] != "OTHER") | (F.coalesce(p["rawName"], F.lit("")) != ""))),
        Rule("high-needs-samples", (c("confidence") != "HIGH") | (samples >= 10)),
        Rule("few-samples-are-low", (samples > 1) | (F.coalesce(c("confidence"), F.lit("")) == "LOW")),
    ]


def producer_rules() -> list[Rule]:
    """Rules of the producers (columns of ``sources.schemas.PRODUCERS`` and verification)."""
    c = F.col
    bare = lambda t: F.regexp_replace(F.lower(F.coalesce(t, F.lit(""))), "[^a-z0-9]", "")
    return [
        Rule("verified-is-active", (c("verification.status") != "VERIFIED_OFFICIAL") | (F.coalesce(c("licenseStatus"), F.lit("")) == "ACTIVE")),
        Rule("a-location-a-county", c("locationCount") >= F.size("counties")),
        Rule("exact-is-exact", F.forall("brands", lambda b: (b["match"] != "EXACT") | (bare(b["name"]) == bare(c("entityName"))))),
    ]


def microbusinesses_missing(producers: DataFrame, shops: DataFrame) -> DataFrame:
    """Producers that also sell, in a covered county, and are not in the register of shops."""
    covered = F.exists("counties", lambda x: x.isin(*COVERED))
    return orphans(producers.where(covered & (F.col("licenseType") == "MICROBUSINESS")), shops, "licenseNumber", "licenseNumber", "microbusiness-in-register", "warn")


def shared_menu_violations(rows: DataFrame, key: str, licence: str, menu: str, marked: Column) -> DataFrame:
    """Listings of a menu that several licences read and are not marked so, or the other way."""
    shared = rows.where(F.col(menu).isNotNull() & F.col(licence).isNotNull()).groupBy(menu).agg(F.countDistinct(licence).alias("n")).where("n > 1")
    both = rows.join(shared, menu, "left").withColumn("marked", F.coalesce(marked, F.lit(False)))
    rule = F.when(F.col("n").isNotNull() & ~F.col("marked"), "shared-not-marked").when(F.col("n").isNull() & F.col("marked"), "marked-not-shared")
    return both.select(rule.alias("rule"), F.col(key).cast("string").alias("key"), F.lit("fail").alias("severity")).where("rule is not null")
