"""Product lines: pieces of a brand's names that stand beside many different others.

A name such as ``Gold Cuts - Cobra Kush`` has two pieces.  Those that stand in one name are partners.
A piece is a line beside another if it has three partners or more and at least twice as many as the
other, and a candidate if it is so in more rows than those in which another is a line beside it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import keys
from .rounds import written
from .settling import PACKAGING, is_packaging, same_key


def line_key(piece: Column) -> Column:
    """A piece's words without those of packaging, and without a last s."""
    words = F.regexp_extract_all(keys.latin(piece), F.lit("([a-z0-9]+)"), 1)
    return F.regexp_replace(F.array_join(F.filter(words, lambda w: ~w.isin(*PACKAGING)), ""), "s$", "")


def pieces(name: Column) -> Column:
    """A name's pieces with their keys, cut at | and at dashes between spaces: neither packaging nor a lone x."""
    cut = F.transform(F.split(name, r"\s+[-–—]\s+|\s*\|\s*"), lambda p: F.trim(p))
    kept = F.filter(cut, lambda p: (p != "") & ~is_packaging(p) & (same_key(p) != "x"))
    return F.filter(F.transform(kept, lambda p: F.struct(line_key(p).alias("k"), p.alias("piece"))), lambda s: s["k"] != "")


def named(rows: DataFrame) -> DataFrame:
    """(brand, name, n, at, found, ks): names of two keys or more, in how many rows, and the first row's id."""
    counted = rows.where("brand <> '' and name is not null").groupBy("brand", "name").agg(F.count("*").alias("n"), F.min("id").alias("at"))
    found = counted.withColumn("found", pieces(F.col("name")))
    return found.withColumn("ks", F.array_sort(F.array_distinct(F.transform("found", lambda s: s["k"])))).where(F.size("ks") >= 2)


def partners(sets: DataFrame, least: int = 3, block: int = 64) -> tuple[DataFrame, DataFrame]:
    """((brand, a, c, n), (brand, k, partners)): a beside c in n rows, for every ``a`` that may have
    ``least`` partners, and how many different ones each key has.

    ``sets`` is (brand, ks, n) with sets distinct within a brand.  The sum of (size - 1) over a key's sets
    bounds its partners.  Where it is one or two it is exact, for a set of three has both and two sets of
    two that share a key differ in the other; so keys below the least number, and below three, need no
    pairs of their own.  A set of more than ``block`` keys is paired a block by a block, so that no
    task gets all pairs of a long name."""
    sized = sets.select("brand", F.sha2(F.to_json(F.struct("brand", "ks")), 256).alias("set"), "n", "ks")
    items = sized.select("brand", "set", "n", F.floor((F.size("ks") - 1) / block).cast("int").alias("last"), F.size("ks").alias("size"), F.posexplode("ks").alias("p", "k"))
    bound = written(items.groupBy("brand", "k").agg(F.sum(F.col("size") - 1).alias("bound")))
    items = items.withColumn("own", F.floor(F.col("p") / block).cast("int")).select("brand", "set", "n", "last", "own", "k")
    other = F.explode(F.sequence(F.lit(0), F.col("last")))
    left = items.join(bound.where(F.col("bound") >= min(least, 3)).select("brand", "k"), ["brand", "k"], "left_semi")
    left = left.select("brand", "set", "n", F.col("k").alias("a"), F.col("own").alias("i"), other.alias("j"))
    right = items.select("set", F.col("k").alias("c"), F.col("own").alias("j"), other.alias("i"))
    pairs = written(left.join(right, ["set", "i", "j"]).where("a <> c").groupBy("brand", "a", "c").agg(F.sum("n").alias("n")))
    counted = pairs.groupBy("brand", F.col("a").alias("k")).agg(F.count("*").alias("partners"))
    return pairs, written(bound.join(counted, ["brand", "k"], "left").select("brand", "k", F.coalesce("partners", "bound").alias("partners")))


def candidates(rows: DataFrame, decided: DataFrame | None = None, least: int = 3, examples: int = 4) -> DataFrame:
    """(brand, k, line, partners, as_line, as_name, examples) of ``rows`` (id, brand, name): the candidates,
    each as it is first written, how often it was found a line and how often not, and the first names
    that have it.  ``decided`` (brand, line) has those that a person has settled either way."""
    names = written(named(rows.select("id", "brand", "name")))
    pairs, counts = partners(names.groupBy("brand", "ks").agg(F.sum("n").alias("n")), least)
    own, theirs = counts.select("brand", F.col("k").alias("a"), F.col("partners").alias("pa")), counts.select("brand", F.col("k").alias("c"), F.col("partners").alias("pc"))
    met = pairs.join(theirs, ["brand", "c"]).join(own, ["brand", "a"])
    line = lambda x, y: (F.col(x) >= least) & (F.col(x) >= 2 * F.col(y))
    of = lambda x, y: F.sum(F.when(line(x, y), F.col("n")).otherwise(0))
    found = met.groupBy("brand", F.col("a").alias("k")).agg(F.first("pa").alias("partners"), of("pa", "pc").alias("as_line"), of("pc", "pa").alias("as_name")).where("as_line > as_name")
    if decided is not None:
        found = found.join(decided.select("brand", line_key(F.col("line")).alias("k")).distinct(), ["brand", "k"], "left_anti")
    found = written(found)
    shown = names.select("brand", "name", "at", F.posexplode("found").alias("p", "s")).select("brand", "name", "at", "p", "s.k", "s.piece").join(found.select("brand", "k"), ["brand", "k"], "left_semi")
    first = shown.groupBy("brand", "k").agg(F.min_by("piece", F.struct("at", "p")).alias("line"))
    order = Window.partitionBy("brand", "k").orderBy("at", "name")
    some = shown.groupBy("brand", "k", "name").agg(F.min("at").alias("at")).withColumn("r", F.row_number().over(order)).where(F.col("r") <= examples)
    some = some.groupBy("brand", "k").agg(F.array_sort(F.collect_list(F.struct("r", "name"))).alias("e"))
    return found.join(first, ["brand", "k"]).join(some, ["brand", "k"]).select("brand", "k", "line", "partners", "as_line", "as_name", F.col("e.name").alias("examples"))
