"""The register of shops: from a registry's rows to records, and what is asked of the records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, keys, text

#: Other names of counties, and the boroughs of a city's counties.
COUNTY_NAMES = {"brooklyn": "Kings", "kings": "Kings", "manhattan": "New York", "new york": "New York", "staten island": "Richmond", "richmond": "Richmond", "bronx": "Bronx", "the bronx": "Bronx", "queens": "Queens"}
BOROUGHS = {"New York": "Manhattan", "Kings": "Brooklyn", "Queens": "Queens", "Bronx": "The Bronx", "Richmond": "Staten Island"}
REGION_ORDER = ("Manhattan", "Brooklyn", "Queens", "The Bronx", "Staten Island", "Westchester")
#: What a licence's prose contains, and its kind; the first that fits counts.
LICENCE_TYPES = (
    ("caurd|conditional adult-use retail", "CAURD"), ("microbusiness", "MICROBUSINESS"), ("registered organization.*adult|adult.*registered organization", "REGISTERED_ORGANIZATION_ADULT_USE"),
    ("registered organization", "REGISTERED_ORGANIZATION_MEDICAL"), ("delivery", "DELIVERY_ONLY"), ("consumption", "ONSITE_CONSUMPTION"), ("retail dispensary|dispensing", "ADULT_USE_RETAIL_DISPENSARY"),
)
LICENCE_STATUSES = (
    ("revoked", "REVOKED"), ("surrender", "SURRENDERED"), ("suspend", "SUSPENDED"), ("expired", "EXPIRED"), ("provisional", "PROVISIONAL"), ("pending", "PENDING"), ("active", "ACTIVE"),
)
EXPIRES_SOON_DAYS = 60


def _looked_up(value: Column, names: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[value]


def _first_that_fits(value: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    low = F.lower(value)
    return F.coalesce(*[F.when(low.rlike(pattern), F.lit(kind)) for pattern, kind in rules])


def county(raw: Column) -> Column:
    """A county by its own name; one without another name as it is, each word with a capital."""
    key = F.trim(F.regexp_replace(F.lower(raw), r"\s+county$", ""))
    words = F.transform(F.split(key, r"(?<=[\s-])"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1000)))
    return F.when(key != "", F.coalesce(_looked_up(key, COUNTY_NAMES), F.array_join(words, "")))


def borough(county_name: Column) -> Column:
    return _looked_up(county_name, BOROUGHS)


def region(county_name: Column) -> Column:
    """A borough where there is one, else the county."""
    return F.coalesce(borough(county_name), county_name)


def region_rank(region_name: Column) -> Column:
    """The place of a region in the order in which readers know them; others after them."""
    return F.coalesce(_looked_up(region_name, {r: str(i) for i, r in enumerate(REGION_ORDER)}).cast("int"), F.lit(len(REGION_ORDER)))


def licence_type(raw: Column) -> Column:
    return _first_that_fits(raw, LICENCE_TYPES)


def licence_status(raw: Column) -> Column:
    return _first_that_fits(raw, LICENCE_STATUSES)


def operational_status(raw: Column, status: Column) -> Column:
    """Closed if the registry says so or the licence is gone; never open, which it cannot know."""
    low = F.coalesce(F.lower(raw), F.lit(""))
    closed = F.contains(low, F.lit("permanently closed"))
    return F.when(closed, "PERMANENTLY_CLOSED").when(F.contains(low, F.lit("temporarily closed")), "TEMPORARILY_CLOSED").when(F.coalesce(status, F.lit("")).isin("REVOKED", "SURRENDERED"), "PERMANENTLY_CLOSED").otherwise("UNKNOWN")


def shop_records(rows: DataFrame, retrieved: Column) -> DataFrame:
    """A registry's rows (license, entity, dba, type, status, operational, line1, city, county, zip,
    website, issued, expires, opened) as records; what the registry does not say is null."""
    name = F.coalesce(text.usable(F.col("dba")), F.col("entity"))
    place = county(F.col("county"))
    status = licence_status(F.col("status"))
    return rows.select(
        keys.slug(F.concat_ws(" ", name, "city")).alias("id"),
        F.col("license").alias("licenseNumber"),
        licence_type(F.col("type")).alias("licenseType"),
        status.alias("licenseStatus"),
        operational_status(F.col("operational"), status).alias("operationalStatus"),
        F.col("entity").alias("legalName"),
        F.col("dba").alias("dbaName"),
        F.struct(
            F.col("line1").alias("line1"), F.col("city").alias("city"), place.alias("county"), borough(place).alias("borough"),
            F.lit("NY").alias("state"), F.nullif(F.regexp_extract("zip", r"^\s*(\d{5})", 1), F.lit("")).alias("zip"),
        ).alias("address"),
        F.struct(text.link(F.col("website")).alias("website")).alias("contact"),
        F.struct(
            dates.printed_date(F.col("issued")).alias("licenseIssued"), dates.printed_date(F.col("expires")).alias("licenseExpiration"), dates.printed_date(F.col("opened")).alias("openedOn"),
        ).alias("dates"),
        retrieved.alias("lastUpdated"),
    )


def retail_scope(rows: DataFrame, inside: Column, patterns: list[str]) -> DataFrame:
    """Rows of shops in a territory: of a type that sells, with a licence and an address; of a
    licence's rows the one that says most about its address, then the first by it."""
    sells = F.coalesce(F.lower("type").rlike("|".join(patterns)), F.lit(False))
    there = rows.where(F.coalesce(inside, F.lit(False)) & sells & F.col("license").isNotNull())
    detail = F.length(F.concat_ws(" ", "line1", "city", "zip"))
    best = F.min_by(F.struct(*rows.columns), F.struct((-detail).alias("n"), F.coalesce("line1", F.lit("")).alias("line1"), F.coalesce("city", F.lit("")).alias("city")))
    return there.groupBy("license").agg(best.alias("row")).select("row.*").where("line1 is not null")


def week_changes(before: DataFrame, after: DataFrame, today: Column) -> DataFrame:
    """(license, change): new, opened, closed, left, moved, expiring within 60 days, and expired.  A
    shop may be in several.  Both sides: license, status, line1, expires."""
    old = before.select("license", *[F.col(c).alias(f"old_{c}") for c in ("status", "line1")], F.lit(True).alias("was"))
    both = after.withColumn("is", F.lit(True)).join(old, "license", "full")
    known = F.col("is") & F.col("was")
    was, now = F.coalesce(F.col("old_status") == "OPEN", F.lit(False)), F.coalesce(F.col("status") == "OPEN", F.lit(False))
    tests = {
        "new": F.col("was").isNull(), "left": F.col("is").isNull(), "opened": known & ~was & now, "closed": known & was & ~now,
        "moved": known & (F.col("line1") != F.col("old_line1")) & (F.col("line1") != "") & (F.col("old_line1") != ""),
        "expired": F.col("is") & (F.col("expires") < today), "expiring": F.col("is") & F.col("expires").between(today, F.date_add(today, EXPIRES_SOON_DAYS)),
    }
    found = F.filter(F.array(*[F.when(t, F.lit(n)) for n, t in tests.items()]), lambda x: x.isNotNull())
    return both.select("license", F.explode(found).alias("change"))


def locations(rows: DataFrame, key: str, order: str, *places: str) -> DataFrame:
    """One row a licence: each place's distinct values in the order of their first row, and how many
    rows there are."""
    seen = None
    for p in places:
        first = rows.where(F.col(p).isNotNull()).groupBy(key, p).agg(F.min(order).alias("at"))
        listed = first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", F.col(p).alias("place")))), lambda x: x["place"]).alias(f"{p}s"))
        seen = listed if seen is None else seen.join(listed, key, "full")
    return rows.groupBy(key).agg(F.count("*").alias("locations")).join(seen, key, "left")


def geocoded(shops: DataFrame, primary: DataFrame, fallback: DataFrame, key: str) -> DataFrame:
    """Each shop's point: from the first source, else from the other, else none, and which."""
    a, b = (df.select(key, F.struct("lat", "lng").alias(n)) for df, n in ((primary, "a"), (fallback, "b")))
    joined = shops.join(a, key, "left").join(b, key, "left")
    point = F.coalesce("a", "b")
    return joined.select(*shops.columns, point["lat"].alias("lat"), point["lng"].alias("lng"), F.when(F.col("a").isNotNull(), "primary").when(F.col("b").isNotNull(), "fallback").otherwise("none").alias("found_by"))


def in_box(lat: Column, lng: Column, south: float, north: float, west: float, east: float) -> Column:
    return lat.between(south, north) & lng.between(west, east)


def map_points(shops: DataFrame, lat: str, lng: str, *columns: str) -> DataFrame:
    """What a map shows of shops with a point."""
    return shops.where(F.col(lat).isNotNull() & F.col(lng).isNotNull()).select(*columns, lat, lng)


def narrowed(df: DataFrame, **wanted: Column | None) -> DataFrame:
    """Rows that pass every filter that is set; an unknown value passes none."""
    for test in wanted.values():
        if test is not None:
            df = df.where(F.coalesce(test, F.lit(False)))
    return df


def by_opening(shops: DataFrame, opened: str, name: str, ord_col: str) -> DataFrame:
    """Shops known to have opened, the latest first and of one day as they came; then the others by
    name."""
    return shops.orderBy(F.col(opened).desc_nulls_last(), F.when(F.col(opened).isNull(), F.col(name)), ord_col)


def outreach(producers: DataFrame, brands: DataFrame, listings: DataFrame, described: Column) -> DataFrame:
    """Per producer: shops and strains that carry its brands, and strains that none describes.
    ``brands``: producer, brand; ``listings``: brand, shop, strain."""
    rows = brands.distinct().join(listings.withColumn("told", F.coalesce(described, F.lit(False))), "brand")
    strains = rows.groupBy("producer", "brand", "strain").agg(F.max("told").alias("told"))
    shops = rows.groupBy("producer").agg(F.countDistinct("shop").alias("shops"))
    counted = strains.groupBy("producer").agg(F.count("*").alias("strains"), F.count_if(~F.col("told")).alias("undescribed"))
    filled = producers.join(shops, "producer", "left").join(counted, "producer", "left")
    return filled.na.fill(0, ["shops", "strains", "undescribed"])


def coverage_change(before: DataFrame, after: DataFrame, *fields: str) -> DataFrame:
    """(field, before, after): how many rows have a value."""
    counts = [df.agg(*[F.count(f).alias(f) for f in fields]).select(F.expr("stack({}, {}) as (field, n)".format(len(fields), ", ".join(f"'{f}', {f}" for f in fields)))) for df in (before, after)]
    return counts[0].withColumnRenamed("n", "before").join(counts[1].withColumnRenamed("n", "after"), "field")


def used_often(df: DataFrame, value: str, most: int = 2) -> DataFrame:
    """Values that more rows share than they should: one phone of many shops is a call centre's."""
    return df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n")).where(F.col("n") > most)


def due_again(rows: DataFrame) -> DataFrame:
    """Shops to be read once more: a second read was due and brought nothing since the page was
    empty or failed, or the rules file did not answer.  ``rows``: license, status, robots, again
    (a second read was due), flower (listings)."""
    status, why = F.coalesce("status", F.lit("")), F.coalesce("robots", F.lit(""))
    empty = F.col("again") & (F.coalesce("flower", F.lit(0)) == 0) & ((status == "no-products") | status.startswith("error"))
    unanswered = (status == "robots-disallowed") & ((why == "robots-unreachable") | why.startswith("robots-unavailable-5"))
    return rows.where(F.coalesce(empty, F.lit(False)) | unanswered).select("license", "status")


def new_links(known: DataFrame, found: DataFrame, page: str, document: str, day: Column) -> DataFrame:
    """Links whose document no known one of the page has, once a document, stamped with the day."""
    fresh = found.join(known.select(page, document).distinct(), [page, document], "left_anti")
    return fresh.groupBy(page, document).agg(F.min("url").alias("url")).withColumn("first_seen", day)


def opt_outs(municipalities: DataFrame, flag: str) -> DataFrame:
    """Municipalities known to have opted out, by name; unknown ones are not among them."""
    return municipalities.where(F.col(flag)).orderBy("name")


def pages_of(**tables: tuple[DataFrame, str]) -> DataFrame:
    """(kind, key) of everything that has a page of its own."""
    out = None
    for kind, (df, key) in tables.items():
        part = df.where(F.col(key).isNotNull()).select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("key")).distinct()
        out = part if out is None else out.unionByName(part)
    return out


def numbered_keys(df: DataFrame, key: str, order: list[Column], out: str = "row_key") -> DataFrame:
    """Equal keys told apart: the first as it is, others with ~2, ~3, ..."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn(out, F.when(n == 1, F.col(key)).otherwise(F.concat(F.col(key), F.lit("~"), n)))
