"""Lab panels and batches on shelves: who prints which, where they stand, what they are called."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers
from ..functions.keys import latin
from .index import tied_mode

WAVE_DAYS = 7
KEEP_DAYS, KEEP_SWEEPS, KEEP_READS = 60, 60, 8


def provenance(source: Column, certificate: Column) -> Column:
    """A menu's panel that links to a certificate is better than one that does not."""
    linked = F.coalesce(certificate.rlike(r"(?i)^https?://"), F.lit(False))
    return F.when((source == "MENU_LISTING") & linked, "MENU_WITH_CERTIFICATE").otherwise(source)


def lab_only(source: Column, certificate: Column) -> Column:
    return F.coalesce(source == "LAB_COA", F.lit(False)) | F.coalesce(certificate.rlike(r"(?i)^https?://"), F.lit(False))


def strains_text(rows: DataFrame, key: str, name: str, order: str, sample: Column | None = None) -> DataFrame:
    """Per key its names, a line each, without regard to case, in the order of their first row."""
    rows = rows.withColumn("line", F.trim(name)).where("line <> ''")
    rows = rows if sample is None else rows.where(~F.coalesce(sample, F.lit(False)))
    first = rows.groupBy(key, F.lower("line").alias("fold")).agg(F.min(F.struct(order, "line")).alias("f"))
    return first.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list("f")), lambda x: x["line"]), "\n").alias("names"))


def batch_panels(rows: DataFrame, panel: str, listing: str, shop: str, order: str) -> DataFrame:
    """A row a panel, on how many shops, with its first listing; a panel without a key is its own."""
    batch = F.coalesce(F.col(panel), F.col(listing).cast("string"))
    return rows.groupBy(batch.alias("batch")).agg(F.countDistinct(shop).alias("shops"), F.min_by(listing, order).alias("first"))


def same_batch_report(rows: DataFrame, panel: str, shop: str, brand: str) -> DataFrame:
    """Panels on several shops: clean if one brand at most prints it, else mixed."""
    out = rows.where(F.col(panel).isNotNull()).groupBy(panel).agg(F.countDistinct(shop).alias("shops"), F.countDistinct(brand).alias("brands"), F.count("*").alias("rows"))
    return out.where("shops > 1").withColumn("kind", F.when(F.col("brands") <= 1, "clean").otherwise("mixed"))


def packages_of(rows: DataFrame, redirects: DataFrame, packages: DataFrame, key: str, tags: str) -> DataFrame:
    """(key, tag) and the package: a listing's tags, through their redirects (link, tag), to packages
    that were found.  ``packages``: tag, found and more."""
    named = rows.select(key, F.explode(tags).alias("link")).where("link is not null")
    tagged = named.join(redirects.select("link", F.col("tag").alias("target")), "link", "left")
    tagged = tagged.select(key, F.upper(F.coalesce("target", "link")).alias("tag")).distinct()
    return tagged.join(packages.where("found"), "tag")


def _same_batch_join(left: DataFrame, thc: str, right: DataFrame, other: str) -> DataFrame:
    """Rows of one key whose figures are the same batch.  Such figures differ by less than one, so
    they are met on their whole numbers, the same or next ones."""
    whole = F.floor(F.col(thc))
    spread = left.withColumn("whole", F.explode(F.array(whole - 1, whole, whole + 1)))
    met = spread.join(right.withColumn("whole", F.floor(F.col(other))), ["key", "whole"]).drop("whole")
    return met.where(numbers.same_batch(F.col(thc), F.col(other)))


def tagged_lots(lots: DataFrame, tagged: DataFrame) -> DataFrame:
    """Lots with the tags of rows of their key whose figure is the same batch; (key, thc) each."""
    met = _same_batch_join(lots, "thc", tagged.select("key", F.col("thc").alias("tagged_thc"), "tag"), "tagged_thc")
    return met.select("key", "thc", "tag").distinct()


def names_seen(rows: DataFrame, standing: DataFrame, key: str, name: str, least: int = 2) -> DataFrame:
    """How a key is spelt, for keys that stand in so many shops at least.  ``standing``: key, shops."""
    return tied_mode(rows, [key], name, "name").join(standing.where(F.col("shops") >= least).select(key), key)


def lot_names(rows: DataFrame, key: str, strain: str, name: str, head: str) -> DataFrame:
    """A lot's name as menus spell it: the commonest of the names that read as its strain; else the
    commonest of all, without the grower's words at its front if the strain is what remains."""
    fold = F.lower(F.trim(F.regexp_replace(name, r"\s+", " ")))
    same = tied_mode(rows.where(fold == F.col(strain)), [key], name, "same").select(key, "same")
    most = tied_mode(rows.withColumn("fold", fold), [key], name, "most").select(key, "most")
    heads = rows.select(key, strain, head).distinct()
    out = most.join(same, key, "left").join(heads, key)
    low = F.lower(F.trim(F.regexp_replace("most", r"\s+", " ")))
    bare = F.when(low == F.concat_ws(" ", F.lower(head), strain), F.element_at(F.split("most", r"\s+"), F.lit(-1)))
    tail = F.array_join(F.slice(F.split("most", r"\s+"), F.size(F.split(F.lower(head), r"\s+")) + 1, 99), " ")
    return out.select(key, F.coalesce("same", F.when(bare.isNotNull(), tail), "most").alias("name"))


def expires_in(description: Column) -> Column:
    """The least of the days in "Expiring in N days"; null if there is none."""
    return F.array_min(F.transform(F.regexp_extract_all(description, F.lit(r"(?i)expir(?:es|ing) in (\d+) days?"), 1), lambda n: n.cast("int")))


def recent_batches(batches: DataFrame, day: Column) -> DataFrame:
    """New batches of the seven days to ``day``: (key, thc), on how many shops and since when."""
    recent = batches.where(F.col("seen").between(F.date_sub(day, WAVE_DAYS - 1), day))
    return recent.groupBy("key", "thc").agg(F.countDistinct("lic").alias("shops"), F.min("seen").alias("since"))


def carrying(batches: DataFrame, rows: DataFrame) -> DataFrame:
    """(key, thc, lic): where a batch stands now: shops that print its figure or one as good."""
    now = rows.where("thc > 0").select("key", "lic", F.col("thc").alias("now_thc")).distinct()
    met = _same_batch_join(batches.select("key", "thc").distinct(), "thc", now, "now_thc")
    return met.select("key", "thc", "lic").distinct()


def first_on_shelf(batches: DataFrame, standing: DataFrame, figures: DataFrame) -> DataFrame:
    """(key, thc, lic, since, exact): since when a batch may be on a shelf: the first day of its
    figure there; exact if that shelf was read before without it, else it may be older.
    ``standing``: key, lic, first day of the key; ``figures``: key, lic, thc, first day of the figure."""
    met = _same_batch_join(batches.select("key", "thc").distinct(), "thc", figures.withColumnRenamed("thc", "figure"), "figure")
    since = met.groupBy("key", "thc", "lic").agg(F.min("first").alias("since"))
    return since.join(standing.select("key", "lic", F.col("first").alias("stood")), ["key", "lic"]).select("key", "thc", "lic", "since", (F.col("since") > F.col("stood")).alias("exact"))


def enriched(moves: DataFrame, shelves: DataFrame, key: str = "key", other: str = "keys") -> DataFrame:
    """Moves with their strain's page: by the key, else by the first of the other keys that a shelf
    has, else by brand and name.  ``shelves``: key, brand, name, slug."""
    by_key = shelves.select(F.col("key").alias("hit"), "slug").groupBy("hit").agg(F.min("slug").alias("slug"))
    tried = moves.select("id", F.posexplode(F.concat(F.array(F.col(key)), F.coalesce(F.col(other), F.array().cast("array<string>")))).alias("at", "hit"))
    found = tried.join(by_key, "hit").groupBy("id").agg(F.min_by("slug", "at").alias("by_key"))
    fold = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))
    named = shelves.groupBy(fold("brand").alias("b"), fold("name").alias("n")).agg(F.min("slug").alias("by_name"))
    out = moves.join(found, "id", "left").join(named, (fold("brand") == F.col("b")) & (fold("name") == F.col("n")), "left")
    return out.select(*moves.columns, F.coalesce("by_key", "by_name").alias("slug"))


def kept_history(spans: DataFrame, day: Column) -> DataFrame:
    """Keys on shelves that stand, or stood in the last 60 days."""
    return spans.where(F.col("last").isNull() | (F.col("last") >= F.date_sub(day, KEEP_DAYS)))


def kept_reads(reads: DataFrame) -> DataFrame:
    """The last eight readings of each shop."""
    n = F.row_number().over(Window.partitionBy("lic").orderBy(F.desc("day")))
    return reads.withColumn("n", n).where(F.col("n") <= KEEP_READS).drop("n")


def seeded(spans: DataFrame, arrivals: DataFrame) -> DataFrame:
    """(key, known, debut): the first day of a key anywhere, and whether a confirmed arrival on that
    very day makes it a debut."""
    known = spans.groupBy("key").agg(F.min("first").alias("known"))
    came = arrivals.where("state = 'confirmed'").select("key", F.col("seen").alias("known"), F.lit(True).alias("debut")).distinct()
    return known.join(came, ["key", "known"], "left").withColumn("debut", F.coalesce("debut", F.lit(False)))


#: Orders in which moves are listed; ``strongest`` is that of the source, which ``ord`` keeps.
MOVE_ORDERS = {
    "strongest": lambda: [F.col("ord")],
    "now": lambda: [F.desc("now"), F.desc("shelves"), F.col("name")],
    "newest": lambda: [F.desc("day"), F.desc("shelves"), F.col("ord")],
    "fewest": lambda: [F.col("now"), F.desc("peak"), F.col("ord")],
    "recent": lambda: [F.desc("day"), F.desc("peak"), F.col("ord")],
    "widest": lambda: [F.desc("peak"), F.desc("day"), F.col("ord")],
    "name": lambda: [F.col("name"), F.col("ord")],
}


def ordered_moves(moves: DataFrame, order: str, lineage: str | None = None) -> DataFrame:
    """Moves of a lineage (all if none is given) in a named order."""
    rows = moves if lineage is None else moves.where(F.col("lineage") == lineage)
    return rows.orderBy(*MOVE_ORDERS[order]())


def natural(name: Column) -> Column:
    """A sort key in which "Batch 9" comes before "Batch 10", whatever the case, the accents and the
    length of the numbers: in front of each number stands how many digits it has."""
    bare = lambda w: F.regexp_replace(w, "^0+(?=[0-9])", "")
    sized = lambda w: F.concat(F.lpad(F.length(bare(w)).cast("string"), 6, "0"), bare(w))
    pieces = F.regexp_extract_all(latin(name), F.lit("([0-9]+|[^0-9]+)"), 1)
    return F.array_join(F.transform(pieces, lambda w: F.when(w.rlike("^[0-9]"), sized(w)).otherwise(w)), "")
