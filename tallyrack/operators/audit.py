"""An audit's match of two lists of shops: weights of address, name, city and ZIP, without a block.

``near_texts`` finds all pairs of alike texts: they meet on their rarest two-letter pieces.
``weighted_matches`` asks for the best of each row alone, also where all addresses are alike: blocks of
both lists meet in tasks of bounded size, the letters that two texts have in common bound every
pair's score there, and likeness is taken of pairs from the highest bound down until no other can win.
"""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import cache
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import keys
from .rounds import written

#: What ends an address, and short forms of street words.
UNITS = ("suite", "ste", "unit", "apt", "apartment", "floor", "fl", "store", "shop", "space")
SHORT = {"avenue": "ave", "street": "st", "road": "rd", "boulevard": "blvd"}
#: Weights of address, name, city and an equal ZIP; what a match needs, and a sure one.
WEIGHTS = (0.60, 0.25, 0.10, 0.05)
ADDRESS, ADDRESS_WITH_NAME, NAME = 0.90, 0.78, 0.75
SURE_ADDRESS, SURE_ADDRESS_WITH_NAME, SURE_NAME = 0.96, 0.88, 0.82
#: How many different rows of either list meet in a task.
ASKED_BLOCK, KNOWN_BLOCK = 1000, 4000


def clean(text: Column) -> Column:
    """Lower case without accents and apostrophes, & as and, all else but letters, figures and # as one space."""
    low = F.replace(F.regexp_replace(keys.latin(F.coalesce(text, F.lit(""))), "['’]", ""), F.lit("&"), F.lit(" and "))
    return F.trim(F.regexp_replace(low, "[^a-z0-9#]+", " "))


def address(line: Column) -> Column:
    """An address up to its unit, street words short."""
    out = F.regexp_substr(keys.latin(F.coalesce(line, F.lit(""))), F.lit(rf"^(?s:(?!#|\b(?:{'|'.join(UNITS)})\b).)*"))
    for word, short in SHORT.items():
        out = F.replace(out, F.lit(word), F.lit(short))
    return clean(out)


def near_texts(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(a, b): pairs of texts of ``left`` (a) and ``right`` (b), among which are all whose ``ratio`` is
    ``least``, above two thirds, or more.

    Of texts of n and m letters M match, 2 M >= least (n + m), in n + m - 2 M + 1 runs at most, so they share
    3 M - (n + m) - 1 >= (1.5 least - 1) (n + m) - 1 two-letter pieces, the nth occurrence of a piece
    being a piece of its own; and m >= n least / (2 - least).  Hence the rarest pieces of either, all
    but one less than that number, have one in common.  Where n + m is too small for the bound to
    say that one is shared, both texts are so short that they meet on their letters as well.  The pieces
    left out are the commonest of either, so of those shared no more are missing than the larger number
    left out, and the rest must be met.  What is not matched can be taken out and put in, so the edit distance is (1 - least) (n + m) at most."""
    if not 2 / 3 < least <= 1:
        raise ValueError("least must be above two thirds, and 1 at most")
    gain = 1.5 * least - 1
    short = int(1 / gain)  # the longest text that may be in a pair of which the bound says nothing
    n = F.length("t")
    texts = written(left.select(F.col("a").alias("t"), F.lit(0).alias("side")).unionByName(right.select(F.col("b").alias("t"), F.lit(1).alias("side"))).where("t <> ''").distinct())
    grams = F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(F.col("t"), i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    letters = F.when(n <= short, F.split("t", "")).otherwise(F.array().cast("array<string>"))
    nth = lambda c: F.transform(F.col(c), lambda g, i: F.concat(g, F.size(F.filter(F.slice(F.col(c), F.lit(1), i + 1), lambda h: h == g)).cast("string")))
    cut = texts.withColumns({"grams": grams, "letters": letters})
    parts = written(cut.select("side", "t", F.explode(nth("grams")).alias("part")))
    often = parts.groupBy("part").agg(F.count("*").alias("often"))
    ranked = parts.join(often, "part").groupBy("side", "t").agg(F.sort_array(F.collect_list(F.struct("often", "part"))).alias("parts"))
    fewest = lambda n: F.greatest(F.lit(1), F.ceil(gain * 2 / (2 - least) * n - 1 - 1e-9)).cast("int")
    lead = ranked.select("side", "t", F.explode(F.slice(F.col("parts"), F.lit(1), F.greatest(n - fewest(n), F.lit(0)))).alias("p")).select("side", "t", F.col("p.part").alias("part"), F.lit(1).alias("gram"))
    lead = lead.unionByName(cut.select("side", "t", F.explode(F.transform(nth("letters"), lambda x: F.concat(F.lit("."), x))).alias("part"), F.lit(0).alias("gram")))
    of = lambda side, name: lead.where(F.col("side") == side).select(F.col("t").alias(name), "part", "gram")
    la, lb = F.length("a"), F.length("b")
    met = of(0, "a").join(of(1, "b"), ["part", "gram"]).where(2 * F.least(la, lb) >= least * (la + lb) - 1e-9).groupBy("a", "b").agg(F.sum("gram").alias("grams"))
    need = F.ceil(gain * (la + lb) - 1 - 1e-9) - F.greatest(fewest(la), fewest(lb)) + 1
    # one condition on the sum, so that the distance is taken once a pair and not before the sum
    return met.where(F.when(F.col("grams") >= need, F.levenshtein("a", "b")) <= (1 - least) * (la + lb) + 1e-9).select("a", "b")


def _bounds(a: list[str], b: list[str]) -> np.ndarray:
    """For every two texts the most that their ratio can be: that of the letters both have, and less than
    one unless they are equal."""
    letters = sorted(set("".join(a)) | set("".join(b)))
    x, y = (np.array([[t.count(c) for c in letters] for t in texts], np.int32).reshape(len(texts), len(letters)) for texts in (a, b))
    n, m = (np.array([len(t) for t in texts], np.int32) for texts in (a, b))
    shared = np.zeros((len(a), len(b)), np.int32)
    for k in range(len(letters)):
        shared += np.minimum(x[:, k, None], y[None, :, k])
    shared -= (shared == n[:, None]) & (shared == m[None, :])
    at = {t: j for j, t in enumerate(b)}
    for i, t in enumerate(a):
        if t in at:
            shared[i, at[t]] = n[i]
    total = n[:, None] + m[None, :]
    return np.where(total == 0, 1.0, 2 * shared / np.maximum(total, 1)).astype(np.float32)


def _best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """The best of ``right`` for each row of ``left`` that has any; both have different rows."""
    sure = 1e-5  # bounds are single floats
    ratio = cache(lambda x, y: SequenceMatcher(None, x, y).ratio())
    codes, bounds = {}, {}
    for c in ("address", "name", "city"):
        (i, a), (j, b) = pd.factorize(left[f"l_{c}"]), pd.factorize(right[f"r_{c}"])
        codes[c], bounds[c] = (i, j), _bounds(list(a), list(b))
    bound = lambda c, k: bounds[c][codes[c][0][k]][codes[c][1]]
    mine = left[["l_address", "l_name", "l_city", "l_zip"]].to_numpy(object)
    theirs, others = right[["r_address", "r_name", "r_city", "r_zip"]].to_numpy(object), right["other"].tolist()
    w, found = WEIGHTS, []
    for k, (address_, name, city, zip_) in enumerate(mine):
        a, n = bound("address", k), bound("name", k)
        may = np.flatnonzero((a >= ADDRESS - sure) | ((a >= ADDRESS_WITH_NAME - sure) & (n >= NAME - sure)))
        equal = theirs[may, 3] == zip_ if zip_ else np.zeros(len(may), bool)
        most = w[0] * a[may] + w[1] * n[may] + w[2] * bound("city", k)[may] + w[3] * equal
        best = None
        while len(may):
            top = int(most.argmax())
            if best is not None and most[top] < -best[0] - sure:
                break
            # what the best so far already beats goes, the rest is tried from the top in runs
            run = np.argsort(-most)[:64] if len(most) > 64 else np.argsort(-most)
            for p in run.tolist():
                if best is not None and most[p] < -best[0] - sure:
                    break
                there = theirs[may[p]]
                s = ratio(address_, there[0]), ratio(name, there[1])
                if s[0] >= ADDRESS or (s[0] >= ADDRESS_WITH_NAME and s[1] >= NAME):
                    c = ratio(city, there[2])
                    score = w[0] * s[0] + w[1] * s[1] + w[2] * c + (w[3] if equal[p] else 0.0)
                    new = (-score, others[may[p]], score, *s, c, bool(equal[p]))
                    best = new if best is None or new[:2] < best[:2] else best
            keep = np.ones(len(may), bool) if best is None else most >= -best[0] - sure
            keep[run] = False
            may, most, equal = may[keep], most[keep], equal[keep]
        if best is not None:
            found.append((*mine[k], *best[1:]))
    return pd.DataFrame(found, columns=["l_address", "l_name", "l_city", "l_zip", "other", "score", "address_score", "name_score", "city_score", "zip_equal"])


def weighted_matches(left: DataFrame, right: DataFrame) -> DataFrame:
    """For each row of ``left`` (id, address, name, city, zip) the best of ``right`` (other, and the same):
    (id, other, score, address_score, name_score, city_score, zip_equal, confident).

    A pair counts if the addresses are alike to 0.90, or to 0.78 and the names to 0.75; of equal scores the
    smallest ``other`` stands.  Rows without any have nulls and are not confident.  A row without an
    address matches nothing, and a ZIP that is not known equals none.  Rows of equal fields are matched
    once.  Every block of different rows meets every block of the other list in a task of its own, so memory
    is bounded and work grows with the product of both lists' different rows, at the price of a bound a pair."""
    fields = {"address": address(F.col("address")), "name": clean(F.col("name")), "city": clean(F.col("city")), "zip": F.coalesce("zip", F.lit(""))}
    row = ["l_address", "l_name", "l_city", "l_zip"]
    mine = written(left.select("id", *[c.alias(f"l_{k}") for k, c in fields.items()]))
    asked = written(mine.select(*row).where("l_address <> ''").distinct())
    theirs = right.select("other", *[c.alias(f"r_{k}") for k, c in fields.items()]).where("r_address <> ''")
    theirs = written(theirs.groupBy("r_address", "r_name", "r_city", "r_zip").agg(F.min("other").alias("other")))
    down, across = max(1, ceil(asked.count() / ASKED_BLOCK)), max(1, ceil(theirs.count() / KNOWN_BLOCK))
    numbered = lambda df, n, m, own, met: df.withColumns({own: F.pmod(F.xxhash64(*df.columns), F.lit(n)), met: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long")))})
    # as many partitions as blocks meet, else the few bytes of many would be one task's
    spread = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(2 * down * across, 10_000))
    a, b = (df.repartition(spread, "i", "j").groupBy("i", "j") for df in (numbered(asked, down, across, "i", "j"), numbered(theirs, across, down, "j", "i")))
    schema = "l_address string, l_name string, l_city string, l_zip string, other " + dict(theirs.dtypes)["other"] + ", score double, address_score double, name_score double, city_score double, zip_equal boolean"
    scored = a.cogroup(b).applyInPandas(_best, schema)
    best = scored.groupBy(*row).agg(F.min(F.struct((-F.col("score")).alias("minus"), "other", "score", "address_score", "name_score", "city_score", "zip_equal")).alias("b"))
    sure = (F.col("b.address_score") >= SURE_ADDRESS) | ((F.col("b.address_score") >= SURE_ADDRESS_WITH_NAME) & (F.col("b.name_score") >= SURE_NAME))
    found = best.select(*row, *[F.col(f"b.{c}").alias(c) for c in ("other", "score", "address_score", "name_score", "city_score", "zip_equal")], sure.alias("confident"))
    return mine.join(found, row, "left").drop(*row).withColumn("confident", F.coalesce("confident", F.lit(False)))
