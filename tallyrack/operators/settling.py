"""One name for one cultivar within a grower: three rules, each on what the one before it left.

Rows are (id, grower, shop, brand, name): a listing's number, which gives the order of rows, the
grower's key, the shop, the brand as printed and the name.  A rule looks at the grower's names with
the number of shops that show each, joins names on keys, and renames all listings of a name at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import keys, names
from .rounds import written

#: Words of how flower is grown, graded, packed, weighed and leans.
PACKAGING = [
    "assisted", "bag", "bagged", "bags", "batch", "bud", "buds", "cannabis", "cbd", "collection", "craft", "dime", "dimebag", "dimes", "dom", "dominant", "edition", "eighth", "exotic",
    "exotics", "flower", "flowers", "g", "gram", "grams", "greenhouse", "grown", "h", "half", "hyb", "hybrid", "hydro", "hydroponic", "hydroponics", "i", "idh", "ih", "ind", "indhyb",
    "indica", "indoor", "item", "jar", "jars", "large", "lean", "leaning", "limited", "living", "micro", "mixed", "mylar", "ounce", "outdoor", "oz", "pack", "packaged", "packs", "papers",
    "popcorn", "pouch", "premium", "prepack", "prepackaged", "prepacked", "quarter", "s", "sample", "samples", "sat", "sathyb", "sativa", "sdh", "sh", "shake", "sku", "small", "smalls",
    "soil", "strain", "sungrown", "tac", "thc", "tin", "ultra", "weed", "whole",
]
#: Phrases of packaging whose words are none alone, and words of companies' forms.
PHRASES = [
    r"w/\s*built[- ]in grinder", r"x\s*\d+\s*(?:ct|pk|pack)", r"sold in pre[- ]?pack", r"\d+\s*x\s*mylar", r"pre[- ]?(?:pack(?:ed|aged)?|ground|rolls?)", r"mixed[- ]light",
    r"sun[- ]?(?:grown|powered)", r"(?:sun)?light[- ]assist(?:ed)?", r"f[;:]ower", r"(?:big|xl|large|small)\s+flower\s+pack",
]
FORMS = ["co", "inc", "llc", "micro"]
SHORT_UNITS = r"^\d+(\.\d+)?\s?[a-z]{0,3}$"
BESIDE, SPELT = "beside the cultivar", "same strain, other spelling"


def _plain(name: Column) -> Column:
    return F.regexp_replace(F.replace(keys.latin(name), F.lit("&"), F.lit(" and ")), r"\bn\b", " and ")


def same_key(name: Column) -> Column:
    return F.regexp_replace(_plain(name), "[^a-z0-9]", "")


def name_words(name: Column) -> Column:
    return F.regexp_extract_all(_plain(name), F.lit("([a-z0-9]+)"), 1)


def loose_key(name: Column) -> Column:
    """As ``keys.loose_key``, and the two spellings of one frozen dessert."""
    return keys.loose_key(F.regexp_replace(keys.latin(name), r"\bsherberts?\b", "sherbet"))


def is_packaging(piece: Column) -> Column:
    words = lambda t: F.regexp_extract_all(t, F.lit("([a-z0-9]+)"), 1)
    low = keys.latin(piece)
    left = words(F.regexp_replace(low, rf"\b(?:{'|'.join(PHRASES)})\b", " "))
    return (F.size(words(low)) > 0) & F.forall(left, lambda w: w.isin(*PACKAGING) | w.rlike(r"^\d+(g|gm|gr|th|oz|pk|ct|pc|pcs)?$"))


def is_noise(piece: Column, brand: Column) -> Column:
    """Packaging, a stray letter, a number with a unit, or the grower's own name however it is typed."""
    low, bare = F.trim(F.lower(piece)), F.regexp_replace(brand, "[™®©]", " ")
    p, b = F.coalesce(keys.grower_key(piece), F.lit("")), F.coalesce(keys.grower_key(bare), F.lit(""))
    typed = (F.length(p) >= 4) & (F.length(b) >= 4) & ((F.levenshtein(p, b, 2) >= 0) | ((F.length(p) >= 5) & (b.contains(p) | p.contains(b))))
    first = F.filter(F.regexp_extract_all(keys.latin(bare), F.lit("([a-z0-9]+)"), 1), lambda w: ~w.isin(*FORMS))
    initials = (F.size(first) >= 2) & (keys.strain_key(piece) == F.array_join(F.transform(first, lambda w: F.substring(w, 1, 1)), ""))
    plain = is_packaging(piece) | low.rlike("^[a-z]$") | low.rlike(SHORT_UNITS) | low.rlike("^(dimes?|dimebag|dime bag|jarred flower|flower/dime)$")
    return plain | F.coalesce(typed | initials, F.lit(False))


def named(rows: DataFrame) -> DataFrame:
    """(grower, k, name, shops, at): a grower's names, each as it is first written."""
    return rows.where("grower is not null").groupBy("grower", same_key(F.col("name")).alias("k")).agg(F.min_by("name", "id").alias("name"), F.countDistinct("shop").alias("shops"), F.min("id").alias("at"))


def _renamed(rows: DataFrame, renames: DataFrame, why: str) -> DataFrame:
    """``renames``: (grower, k, to)."""
    met = rows.withColumn("k", same_key(F.col("name"))).join(renames, ["grower", "k"], "left")
    changed = F.col("to").isNotNull() & (F.col("to") != F.col("name"))
    return written(met.select("id", "grower", "shop", "brand", F.when(changed, F.col("to")).otherwise(F.col("name")).alias("name"), F.when(changed, F.array_union("why", F.array(F.lit(why)))).otherwise(F.col("why")).alias("why")))


def beside(rows: DataFrame) -> DataFrame:
    """(grower, k, to): names of which one piece is a cultivar that stands alone at two shops, or at
    one if all else is plainly none, and no other piece stands alone."""
    all_names = written(named(rows))
    pieces = F.split("name", r"\s+-\s+")
    joined = all_names.where((F.size(pieces) > 1) & ~F.exists(pieces, lambda p: p.rlike(r"(?i)^(x|\+)\s")))
    parts = joined.select("grower", "k", F.explode(pieces).alias("piece")).withColumn("pk", same_key(F.col("piece")))
    alone = all_names.select("grower", F.col("k").alias("pk"), F.col("name").alias("alone"), F.col("shops").alias("alone_shops"))
    parts = written(parts.join(alone, ["grower", "pk"], "left"))
    brands = rows.where("grower is not null and brand is not null").select("grower", "brand").distinct()
    noise = parts.select("grower", "piece").distinct().join(brands, "grower", "left").groupBy("grower", "piece").agg(F.bool_or(is_noise(F.col("piece"), F.coalesce("brand", F.lit("")))).alias("noise"))
    parts = parts.join(noise, ["grower", "piece"])
    twice, once = F.col("alone_shops") >= 2, F.col("alone").isNotNull()
    found = parts.groupBy("grower", "k").agg(
        F.count_if(twice).alias("n_twice"), F.count_if(once).alias("n_once"), F.max(F.when(twice, F.struct("piece", "alone"))).alias("base"), F.max(F.when(once, F.struct("piece", "alone"))).alias("single"),
        F.count("*").alias("n"), F.count_if(once | F.col("noise")).alias("n_fine"), F.count_if(once & F.col("noise")).alias("n_both"), F.collect_set(F.when(once & ~twice, F.col("piece"))).alias("others"),
    )
    clear = (F.col("n_twice") == 1) & (F.size(F.array_except("others", F.array(F.col("base.piece")))) == 0)
    # on one shelf only: the other pieces, or the piece's repetitions, say nothing
    lone = (F.col("n_twice") == 0) & (F.col("n_once") == 1) & (F.col("n_fine") == F.col("n"))
    return found.where(clear | lone).select("grower", "k", F.when(clear, F.col("base.alone")).otherwise(F.col("single.alone")).alias("to"))


def reordered(rows: DataFrame) -> DataFrame:
    """(grower, k, to): names of the same words, where one order is shown by more shops than any other."""
    all_names = written(named(rows).withColumn("words", F.array_join(F.array_sort(name_words(F.col("name"))), " ")))
    top = all_names.groupBy("grower", "words").agg(F.max("shops").alias("most"), F.max_by("name", "shops").alias("to"), F.max_by("k", "shops").alias("top_k"), F.count("*").alias("n")).where("n > 1")
    met = all_names.join(top, ["grower", "words"])
    clear = met.groupBy("grower", "words").agg(F.count_if(F.col("shops") == F.col("most")).alias("tops")).where("tops = 1").select("grower", "words")
    return met.join(clear, ["grower", "words"], "left_semi").where("k <> top_k").select("grower", "k", "to")


def misspelt(rows: DataFrame, growers_of: DataFrame) -> DataFrame:
    """(grower, k, to): the spelling that more shops show, of names that are equal once loosely spelt, or,
    if twice as many show it and no other grower has the minor one, one letter apart, but not by the
    first letter of a word."""
    starts = F.transform(name_words(F.col("name")), lambda w, i: F.aggregate(F.slice(name_words(F.col("name")), F.lit(1), i), F.lit(0), lambda n, v: n + F.length(v)))
    every = named(rows).withColumns({"loose": loose_key(F.col("name")), "starts": starts, "digits": F.regexp_replace("k", r"\D", "")})
    every = written(every)
    minor = every.where(F.length("k") >= 6).select("grower", F.col("k").alias("mk"), F.col("shops").alias("m_shops"), F.col("loose").alias("m_loose"), F.col("starts").alias("m_starts"), F.col("digits").alias("m_digits"))
    equal = minor.withColumn("loose", F.col("m_loose")).join(every, ["grower", "loose"]).where("k <> mk").select("grower", "mk", "k")
    forms = lambda df, c: df.select("grower", c, F.explode(names.deletions(F.col(c), 1)).alias("form"))
    near = forms(minor, "mk").join(forms(every, "k"), ["grower", "form"]).where("k <> mk").select("grower", "mk", "k")
    met = equal.unionByName(near).distinct().join(minor, ["grower", "mk"]).join(every, ["grower", "k"]).where((F.col("shops") > F.col("m_shops")) & (F.col("digits") == F.col("m_digits")))
    met = met.join(growers_of.withColumnRenamed("k", "mk"), "mk", "left")
    one = (F.abs(F.length("k") - F.length("mk")) <= 1) & (F.levenshtein("k", "mk", 1) == 1)
    place = F.array_min(F.filter(F.sequence(F.lit(0), F.length("k") - 1), lambda i: F.substring(F.col("k"), i + 1, F.lit(1)) != F.substring(F.col("mk"), i + 1, F.lit(1))))
    inside = (F.length("k") != F.length("mk")) | ~(F.array_contains("starts", place) | F.array_contains("m_starts", place))
    letter = (F.col("shops") >= 2) & (F.col("shops") >= 2 * F.col("m_shops")) & (F.coalesce("growers", F.lit(0)) <= 1) & one & inside
    met = met.where((F.col("loose") == F.col("m_loose")) | letter)
    return met.groupBy("grower", "mk").agg(F.min_by("name", F.struct((-F.col("shops")).alias("s"), "at")).alias("to")).select("grower", F.col("mk").alias("k"), "to")


def settle(rows: DataFrame) -> DataFrame:
    """(id, grower, shop, brand, name, why): each listing under its settled name, and what was done to it."""
    rows = written(rows.select("id", "grower", "shop", "brand", "name", F.array().cast("array<string>").alias("why")))
    growers_of = written(rows.where("grower is not null").groupBy(same_key(F.col("name")).alias("k")).agg(F.countDistinct("grower").alias("growers")))
    rows = _renamed(rows, beside(rows), BESIDE)
    rows = _renamed(rows, reordered(rows), SPELT)
    return _renamed(rows, misspelt(rows, growers_of), SPELT)
