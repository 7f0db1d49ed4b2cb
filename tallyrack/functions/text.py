"""Addresses, telephone numbers, links, licences and product titles."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .keys import latin

#: Ordinals in words, street words and their short forms, avenues of two names, and what
#: a part of a building is called.
ORDINALS = {
    "first": "1st", "second": "2nd", "third": "3rd", "fourth": "4th", "fifth": "5th", "sixth": "6th", "seventh": "7th", "eighth": "8th", "ninth": "9th", "tenth": "10th",
}
STREET_WORDS = {
    "avenue": "ave", "boulevard": "blvd", "court": "ct", "drive": "dr", "east": "e", "expressway": "expy", "highway": "hwy", "lane": "ln", "north": "n", "parkway": "pkwy", "place": "pl",
    "plaza": "plz", "road": "rd", "south": "s", "street": "st", "terrace": "ter", "turnpike": "tpke", "west": "w",
}
AVENUES = {"avenue of the americas": "6th ave", "fashion avenue": "7th ave", "fashion ave": "7th ave"}
UNITS = ["apartment", "apt", "fl", "floor", "shop", "space", "ste", "store", "suite", "unit"]
#: What stands in a field that nobody filled.
PLACEHOLDERS = ["-", "--", "---", "n/a", "na", "none", "null", "tbd", "unknown"]


def usable(name: Column) -> Column:
    """Null for what stands for nothing: N/A, none, null, TBD, unknown, dashes."""
    text = F.trim(name)
    return F.when((text != "") & ~F.lower(text).isin(*PLACEHOLDERS) & ~text.rlike("^-+$"), text)


def title_case(text: Column) -> Column:
    return F.initcap(F.lower(text))


def canonical_address(line: Column) -> Column:
    """One spelling for an address: lower case without accents, the house number in front without
    its gaps and dash, ordinals in digits, short street words, and nothing from the unit on.

    The line is read as words, with hyphens inside them; what the first two are decides on the
    number, and the parts of all others are looked up one by one."""
    bare = F.replace(F.regexp_replace(latin(line), "['’]", ""), F.lit("&"), F.lit(" and "))
    words = F.regexp_extract_all(bare, F.lit("([a-z0-9]+(?:-[a-z0-9]+)*|#)"), 1)
    unit = F.array_min(F.transform(words, lambda w, i: F.when(F.arrays_overlap(F.split(w, "-"), F.array(*[F.lit(u) for u in [*UNITS, "#"]])), i)))
    words = F.slice(words, F.lit(1), F.coalesce(unit, F.size(words)))
    first, second = (F.coalesce(F.get(words, F.lit(i)), F.lit("")) for i in (0, 1))
    numbered = first.rlike("^[0-9]+(-[0-9]+)?[a-z]?$")
    lettered = numbered & first.rlike("[0-9]$") & second.rlike("^[a-z]$")  # a letter by itself belongs to the number
    taken = F.when(lettered, 2).when(numbered, 1).otherwise(0)
    house = F.replace(F.array_join(F.slice(words, F.lit(1), taken), ""), F.lit("-"))
    known = F.create_map(*[F.lit(x) for pair in (ORDINALS | STREET_WORDS).items() for x in pair])
    rest = F.flatten(F.transform(F.slice(words, taken + 1, F.size(words)), lambda w: F.split(w, "-")))
    text = F.array_join(F.transform(rest, lambda w: F.coalesce(known[w], w)), " ")
    for name, short in AVENUES.items():
        named = " ".join(STREET_WORDS.get(w, w) for w in name.split())
        text = F.regexp_replace(text, rf"\b{named}\b", short)
    return F.when(line.isNotNull(), F.trim(F.concat_ws(" ", F.nullif(house, F.lit("")), text)))


def phone(text: Column, blocked: tuple[str, ...] = ()) -> Column:
    """Ten digits as (AAA) BBB-CCCC; null if it is no such number or is blocked."""
    digits = F.regexp_replace(F.regexp_replace(text, r"\D", ""), r"^1(?=\d{10}$)", "")
    fine = digits.rlike(r"^[2-9]\d{9}$") & ~digits.isin(*(blocked or ("",)))
    return F.when(fine, F.concat(F.lit("("), F.substring(digits, 1, 3), F.lit(") "), F.substring(digits, 4, 3), F.lit("-"), F.substring(digits, 7, 4)))


def link(url: Column) -> Column:
    """A web address with https in front if it has no scheme; null if it is none."""
    text = F.trim(url)
    full = F.when(text.rlike(r"(?i)^https?://"), text).otherwise(F.concat(F.lit("https://"), text))
    return F.when(full.rlike(r"(?i)^https?://[a-z0-9-]+(\.[a-z0-9-]+)+([/?#:].*)?$"), full)


def menu_link(url: Column) -> Column:
    """A link that a menu may have: no script, style, data or API address."""
    found = link(url)
    return F.when(~found.rlike(r"(?i)(\.(js|json|css)([?#]|$)|/api/)"), found)


def lineage(text: Column) -> Column:
    """SATIVA, INDICA, HYBRID or UNKNOWN out of free text; hybrids may lean."""
    low = F.lower(text)
    return (
        F.when(low.rlike(r"hybrid|sativa.*indica|indica.*sativa"), F.when(low.rlike(r"indica[- ](dom|lean|hybrid)"), "INDICA_HYBRID").when(low.rlike(r"sativa[- ](dom|lean|hybrid)"), "SATIVA_HYBRID").otherwise("HYBRID"))
        .when(low.contains("indica"), "INDICA")
        .when(low.contains("sativa"), "SATIVA")
        .otherwise("UNKNOWN")
    )


def sample(warnings: Column, title: Column) -> Column:
    """Whether a listing is a promotional sample; null counts as no sign of it."""
    flagged = F.coalesce(F.array_contains(warnings, "PROMOTIONAL_SAMPLE"), F.lit(False))
    return flagged | F.coalesce(title.rlike(r"(?i)\b(promo|samples?|not for resale)\b"), F.lit(False))


def operational_status(status: Column, opened: Column) -> Column:
    """What a registry says of a shop's trade; it never says that a shop is open."""
    low = F.lower(status)
    return F.when(low.rlike("surrender|revoke|expire|closed|inactive"), "CLOSED").when(opened.isNull() & low.rlike("pending|provisional"), "NOT_YET_OPEN").otherwise("UNKNOWN")


def flower_reason(title: Column, category: Column) -> Column:
    """Whether a product is flower, with the reason: the first rule that speaks."""
    other = r"(?i)\b(pre-?rolls?|joints?|vape|cart(ridge)?s?|gumm(y|ies)|edibles?|concentrates?|rosin|resin|wax|tincture|topical|battery|grinder|infused)\b"
    return (
        F.when(title.isNull() | (F.trim(title) == ""), "no-title")
        .when(title.rlike(other), "title-not-flower")
        .when(category.isNull() | (F.trim(category) == ""), "no-category")
        .when(~category.rlike(r"(?i)flower|bud"), "category-not-flower")
        .otherwise("flower")
    )


@F.pandas_udf(StringType())
def unescaped(texts: pd.Series) -> pd.Series:
    """HTML entities as characters."""
    return texts.map(lambda t: None if t is None else html.unescape(t))
