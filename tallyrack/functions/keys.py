"""Keys by which rows are grouped and compared.  There are several alike; they are not one.

All but ``fold_accents`` are built-in expressions, so they stay in generated code and can be
pushed below joins.  Nulls give null keys, never empty ones.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Words that are no part of a company's name.
COMPANY_WORDS = "cannabis|co|company|farms?|labs?|brands?|nyc?|llc|inc"
GROWER_WORDS = COMPANY_WORDS + "|and|the|of"
#: Legal forms at the end of a name.  "Co." is none: it is part of what a shop is called.
LEGAL_FORMS = r"l\.?\s?l\.?\s?c\.?|p\.?\s?l\.?\s?l\.?\s?c\.?|l\.?\s?l\.?\s?p\.?|inc\.?|incorporated|corp\.?|corporation|ltd\.?|limited"
#: Accented Latin letters and what they are without the accent.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"


@F.pandas_udf(StringType())
def fold_accents(texts: pd.Series) -> pd.Series:
    """Compatibility decomposition without combining marks, for any script; Spark has none."""
    return texts.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not "̀" <= c <= "ͯ"))


def latin(text: Column) -> Column:
    """Lower case without accents, for Latin letters; all built-in."""
    return F.translate(F.lower(text), ACCENTED, PLAIN)


def _none_if_empty(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def brand_key(brand: Column, words: str = COMPANY_WORDS) -> Column:
    """A brand without case, accents, signs and company words; null if nothing is left."""
    plain = F.regexp_replace(latin(brand), "[^a-z0-9 ]", " ")
    return _none_if_empty(F.regexp_replace(F.regexp_replace(plain, rf"\b({words})\b", " "), "[^a-z0-9]", ""))


def grower_key(brand: Column) -> Column:
    """As ``brand_key``, without articles and conjunctions too; aliases are joined afterwards."""
    return brand_key(brand, GROWER_WORDS)


def collapsed(text: Column) -> Column:
    """Lower case, trimmed, white space as single spaces."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def history_key(brand: Column, strain: Column, key: Column | None = None) -> Column:
    """``brand key|strain``; the brand may be unknown (empty), the strain may not (null)."""
    known = brand_key(brand) if key is None else F.coalesce(key, brand_key(brand))
    name = _none_if_empty(collapsed(strain))
    return F.when(name.isNotNull(), F.concat(F.coalesce(known, F.lit("")), F.lit("|"), name))


def strain_key(strain: Column) -> Column:
    return F.regexp_replace(F.lower(strain), "[^a-z0-9]", "")


def loose_word(w: Column) -> Column:
    """One spelling for plurals, -y and -ie endings and doubled letters."""
    w = F.when(w.rlike(r"^.{2,}ies$"), F.regexp_replace(w, "ies$", "i")).when(w.rlike(r"^.{3,}[sz]$"), F.regexp_replace(w, "[sz]$", "")).otherwise(w)
    w = F.when(w.rlike(r"^.{2,}ie$"), F.regexp_replace(w, "e$", "")).when(w.rlike(r"^.{3,}y$"), F.regexp_replace(w, "y$", "i")).otherwise(w)
    return F.regexp_replace(w, r"(.)\1+", "$1")


def loose_key(strain: Column) -> Column:
    """The words of a name, each loosely spelt, without gaps."""
    text = F.regexp_replace(F.regexp_replace(latin(strain), "['’]", ""), "&| n ", " and ")
    return F.array_join(F.transform(F.filter(F.split(text, "[^a-z0-9]+"), lambda w: w != ""), loose_word), "")


def slug(text: Column, longest: int = 80) -> Column:
    """For addresses: letters and digits with single dashes, cut at ``longest``."""
    dashed = F.regexp_replace(F.regexp_replace(latin(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.regexp_replace(F.substring(dashed, 1, longest), "-+$", "")


def display_name(dba: Column, legal: Column) -> Column:
    """The trading name, else the legal one, without the legal forms at its end, as often as they
    repeat; a name of nothing else stays."""
    name = F.trim(F.coalesce(_none_if_empty(F.trim(dba)), legal))
    bare = F.regexp_replace(name, rf"(?i)(?:[\s,]+(?:{LEGAL_FORMS}))+[\s,]*$", "")
    return F.coalesce(_none_if_empty(F.regexp_replace(bare, r"[\s,]+$", "")), name)


def panel_key(thc: Column, panel: Column) -> Column:
    """``THC:x|NAME:v`` of a lab panel (array of name, percent): at least 4 compounds, the
    largest of each, by name, two decimals."""
    named = F.filter(panel, lambda p: p["percent"].isNotNull() & p["name"].isNotNull())
    names = F.array_sort(F.array_distinct(F.transform(named, lambda p: p["name"])))
    most = lambda n: F.array_max(F.transform(F.filter(named, lambda p: p["name"] == n), lambda p: p["percent"]))
    parts = F.transform(names, lambda n: F.concat(n, F.lit(":"), F.format_string("%.2f", most(n))))
    head = F.concat(F.lit("THC:"), F.coalesce(F.format_string("%.2f", thc), F.lit("")))
    return F.when(F.size(names) >= 4, F.concat_ws("|", head, F.array_join(parts, "|")))


def shelf_signature(keys: Column) -> Column:
    """Shops that show one shelf have one signature (an aggregate)."""
    return F.substring(F.sha1(F.array_join(F.array_sort(F.collect_set(keys)), "\n").cast("binary")), 1, 10)


def menu_identity(url: Column, branch: Column | None = None) -> Column:
    """Host without www, path without a slash at its end, query and fragment, and the branch."""
    base = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://([^/?#]+)", 1)), r"^www\.", ""), r":443$|:80$", "")
    path = F.regexp_replace(F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]+([^?#]*)", 1), "/+$", "")
    rest = F.regexp_extract(url, r"([?#].*)$", 1)
    name = F.concat(base, path, rest)
    return name if branch is None else F.concat(name, F.coalesce(F.concat(F.lit(" @ "), branch), F.lit("")))
