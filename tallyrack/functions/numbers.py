"""Figures printed by different menus: the same measurement or not.

How many decimals a figure was printed with matters, so these compare decimal text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STEP = 0.1


def printed(value: Column) -> Column:
    """A double as a menu would print it: no trailing zeros."""
    text = value.cast("decimal(20,6)").cast("string")
    return F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def places(value: Column) -> Column:
    """Decimals of the printed figure; without patterns, as pairs of figures ask for it several times."""
    return F.length(F.rtrim(F.substring_index(value.cast("decimal(20,6)").cast("string"), ".", -1), F.lit("0")))


def same_batch(a: Column, b: Column) -> Column:
    """Less than 0.1 apart, or one figure is the other one rounded half up or cut off.

    Not transitive, so never a grouping key."""
    rough = F.when(places(a) < places(b), a).otherwise(b)
    exact = F.when(places(a) < places(b), b).otherwise(a)
    scale = F.pow(F.lit(10.0), F.least(places(a), places(b)))
    unit = lambda x: F.round(x * scale, 6)  # noqa: E731  back from binary noise
    near = F.round(F.abs(a - b), 2) < STEP
    folded = (unit(rough) == F.floor(unit(exact) + 0.5)) | (unit(rough) == F.floor(unit(exact)))
    return near | ((places(a) != places(b)) & folded)


def same_figure(a: Column, b: Column) -> Column:
    return (F.abs(a - b) < 0.005) | ((places(a) != places(b)) & same_batch(a, b))


def grams(text: Column) -> Column:
    """A weight in grams out of text: grams, ounces (28 g) and their fractions; pounds are null."""
    low = F.lower(text)
    fraction = F.regexp_extract(low, r"(\d+)\s*/\s*(\d+)\s*(?:oz|ounce)", 1), F.regexp_extract(low, r"(\d+)\s*/\s*(\d+)\s*(?:oz|ounce)", 2)
    ounces = F.regexp_extract(low, r"(\d+(?:\.\d+)?)\s*(?:oz|ounce)", 1)
    plain = F.regexp_extract(low, r"(\d+(?:\.\d+)?)\s*(?:g|gr|grams?)\b", 1)
    number = lambda c: F.nullif(c, F.lit("")).cast("double")
    return (
        F.when(low.rlike(r"\b(lb|lbs|pounds?)\b"), F.lit(None).cast("double"))
        .when(fraction[0] != "", F.round(28 * number(fraction[0]) / number(fraction[1]), 2))
        .when(ounces != "", F.round(28 * number(ounces), 2))
        .when(plain != "", number(plain))
    )


def plausible_size(g: Column) -> Column:
    return F.when(g.between(0.5, 85), g)


def plausible_percent(p: Column, most: float = 100) -> Column:
    return F.when(p.between(0, most), p)


def stated_thc(p: Column) -> Column:
    """Zero is a menu's silence, not a figure."""
    return F.when((p > 0) & (p <= 100), p)


def percentile_at(values: Column, p: float) -> Column:
    """The element at int(p * (n - 1)) of the sorted values (an aggregate)."""
    ordered = F.sort_array(F.collect_list(values))
    return F.element_at(ordered, F.floor(F.lit(p) * (F.size(ordered) - 1)).cast("int") + 1)


def median_2dp(values: Column) -> Column:
    """The median, of an even count the mean of the middle two, to two decimals (an aggregate)."""
    return F.round(F.percentile(values, 0.5), 2)
