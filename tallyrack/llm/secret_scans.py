"""Secrets in texts, by DataFrame functions only.

Patterns find passwords and keys of known shape.  Further tokens are judged by two first-order
Markov models over characters, one of random strings and one of ordinary identifiers: the
log-likelihood ratio of a token, a bigram at a time, says which of them it looks like.  Both are
trained from the whole corpus at hand: the distinct strings that the patterns found, and the
distinct identifiers (at most two digits) of all texts without such a find.

Spans are code points, end exclusive.  Null and empty texts have none.  Where the corpus has no
string of either label, the ratio is 0 everywhere and no token is added.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, columns_of, free_name, quoted

#: The patterns, in the order of their kinds.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"(AKIA[A-Z0-9]+)"
HEX = r"([0-9a-f]+)"
KINDS = ("assign", "access", "hex", "markov")
#: A cheap test that every text with a find of the kind passes.
HINTS = (r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]", r"AKIA[A-Z0-9]{12}", r"[0-9a-f]{32}")
#: What may be a secret of unknown shape.
TOKEN = r"([A-Za-z0-9+/_=-]{20,})"
TOKEN_HINT = r"[A-Za-z0-9+/_=-]{20}"

SPANS = "array<struct<b:int,k:int,e:int>>"
WORD_SPANS = "array<struct<b:int,k:int,e:int,w:string>>"
#: Texts with a find are cut into blocks of so many characters, to take parts out of them quickly.
BLOCK = 2048


def _quoted(text: str) -> str:
    return "r'" + text.replace("'", "\\x27") + "'"


def _let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` standing for ``value``, which is evaluated once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _folded(values: str, step: str) -> str:
    """Running values of an array in rounds of doubling: ``step`` makes of ``x``, an element that
    stands for the last 2**j places, ``i`` its place and ``a``, the array, one that stands for
    twice as many.  No array grows by one element at a time, so a text of n finds costs n log n.
    """
    return _let("v", values, f"aggregate(sequence(0, cast(ceil(log2(size(v) + 1)) as int)), v, (a, j) -> transform(a, (x, i) -> {step}))")


def _finds(text: str, pattern: str, group: int, least: int, kind: int, words: bool = False) -> str:
    """Spans of a pattern's matches whose group has ``least`` characters, with the matches if
    ``words``: lengths of what lies between the matches and of the matches, summed up."""
    p = _quoted(pattern)
    parts = f"arrays_zip(regexp_extract_all({text}, {p}, 0), regexp_extract_all({text}, {p}, {group}), split({text}, {p}, -1))"
    ends = _folded("transform(p, z -> coalesce(length(z.`2`), 0) + coalesce(length(z.`0`), 0))", "x + coalesce(get(a, i - shiftleft(1, j)), 0)")
    held = f"zip_with(p, {ends}, (z, e) -> named_struct('b', e - length(z.`0`), 'k', {kind}, 'e', e, 'w', z.`0`, 'n', length(z.`1`)))"
    fields = "'b', s.b, 'k', s.k, 'e', s.e" + (", 'w', s.w" if words else "")
    return _let("p", parts, f"transform(filter({held}, s -> s.n >= {least}), s -> named_struct({fields}))")


def _or_none(text: str, hint: str, found: str, kind: str = SPANS) -> str:
    return f"if({text} rlike {_quoted(hint)}, {found}, cast(array() as {kind}))"


def base_spans(text: str) -> Column:
    """Sorted spans of the patterns' finds."""
    parts = [
        _or_none(text, HINTS[0], _finds(text, ASSIGN, 2, 8, 0)),
        _or_none(text, HINTS[1], _finds(text, ACCESS, 1, 16, 1)),
        # a run of 32 is one find of the run pattern that is long enough, so shorter runs need not be visited
        _or_none(text, HINTS[2], _finds(text, "([0-9a-f]{32,})", 1, 32, 2)),
    ]
    return F.expr(f"array_sort(concat({', '.join(parts)}))")


def train(df: DataFrame, text_col: str = "text", smooth: float = 0.5) -> list[float]:
    """Log-likelihood ratios of the 95 x 95 printable bigrams.

    Every distinct string of either label counts once, so copies of a text weigh no more than one.
    """
    text = f"coalesce({quoted(text_col)}, '')"
    hints = " or ".join(f"{text} rlike {_quoted(h)}" for h in HINTS)
    values = ", ".join(f"regexp_extract_all({text}, {_quoted(p)}, {g})" for p, g in ((ASSIGN, 2), ("(AKIA[A-Z0-9]{12,})", 1), ("([0-9a-f]{32,})", 1)))
    random = f"filter(concat({values}), w -> length(w) between 8 and 256)"
    # an ordinary identifier may be numbered, but is no mixture of letters and digits
    ordinary = f"filter(regexp_extract_all({text}, r'([A-Za-z0-9+/_=-]{{8,}})', 1), w -> length(regexp_replace(w, '[^0-9]', '')) <= 2)"
    strings = df.select(F.explode(F.expr(f"if({hints}, transform({random}, w -> named_struct('random', 1, 'w', w)), transform({ordinary}, w -> named_struct('random', 0, 'w', w)))")).alias("x"))
    pairs = strings.select("x.random", "x.w").distinct().select("random", F.explode(F.expr("transform(sequence(1, length(w) - 1), i -> substring(w, i, 2))")).alias("pair"))
    counts = pairs.groupBy("random", "pair").count()
    seen = {(r["random"], r["pair"]): r["count"] for r in counts.collect()}  # at most 2 x 64 x 64 rows
    total = {side: sum(n for (s, _), n in seen.items() if s == side) for side in (0, 1)}
    if not total[0] or not total[1]:
        return [0.0] * (95 * 95)
    alphabet = sorted({c for _, pair in seen for c in pair})
    start = {side: {c: 0 for c in alphabet} for side in (0, 1)}
    for (side, pair), n in seen.items():
        start[side][pair[0]] += n
    ratios = [0.0] * (95 * 95)
    for a in alphabet:
        for b in alphabet:
            p = [(seen.get((side, a + b), 0) + smooth) / (start[side][a] + smooth * len(alphabet)) for side in (0, 1)]
            ratios[(ord(a) - 32) * 95 + ord(b) - 32] = math.log(p[1] / p[0])
    return ratios


def with_spans(df: DataFrame, ratios: list[float], text_col: str = "text", least_mean: float = 0.5) -> tuple[DataFrame, str, str]:
    """``df`` with two more columns, whose names are returned: base spans, and all spans.

    A token is added where its log-likelihood ratio is ``least_mean`` a bigram or more and it
    overlaps no base span.
    """
    names = list(df.columns)
    base, every, text, tokens = (names.append(free_name(names, c)) or names[-1] for c in ("base_spans", "all_spans", "scanned_text", "tokens"))
    table = f"cast(split('{','.join(f'{r:.5f}' for r in ratios)}', ',') as array<double>)"
    score = f"""aggregate(transform(split(t.w, ''), c -> ascii(c) - 32), named_struct('p', -1, 's', 0.0D),
      (a, c) -> named_struct('p', c, 's', a.s + if(a.p < 0, 0.0D, element_at({table}, a.p * 95 + c + 1))), a -> a.s)"""
    found = _or_none(text, TOKEN_HINT, _finds(text, TOKEN, 1, 20, 3, words=True), WORD_SPANS) if any(ratios) else f"cast(array() as {WORD_SPANS})"
    random = f"transform(filter({found}, t -> {score} >= {least_mean} * (t.e - t.b - 1)), t -> named_struct('b', t.b, 'k', t.k, 'e', t.e))"
    # of each place among all spans: the last end of a base span up to it, the first start of one from it on
    reach = _folded(
        f"transform(u, s -> named_struct('e', if(s.k < 3, s.e, -1), 'b', if(s.k < 3, s.b, {2**31 - 1})))",
        "named_struct('e', greatest(x.e, get(a, i - shiftleft(1, j)).e), 'b', least(x.b, get(a, i + shiftleft(1, j)).b))",
    )
    free = f"transform(filter(zip_with(u, {reach}, (s, r) -> named_struct('s', s, 'r', r)), z -> z.s.k < 3 or (z.r.e <= z.s.b and z.r.b >= z.s.e)), z -> z.s)"
    free = _let("u", f"array_sort(concat({base}, {tokens}))", free)
    out = df.withColumn(text, F.coalesce(col(text_col), F.lit("")))
    out = out.withColumn(base, base_spans(text)).withColumn(tokens, F.expr(random))
    return out.withColumn(every, F.expr(f"if(size({tokens}) = 0, {base}, {free})")).drop(text, tokens), base, every


def _listed(spans: str) -> str:
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return f"array_join(transform({spans}, x -> concat(element_at({names}, x.k + 1), ':', x.b, ':', x.e)), ',')"


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``df``: doc_id, finds of each pattern, digest of the base spans, all spans."""
    rows = df.select(col(id_col).alias("doc_id"), col(text_col).alias("text"))
    found, base, every = with_spans(rows, train(rows))
    count = lambda k: F.expr(f"cast(size(filter({base}, x -> x.k = {k})) as bigint)").alias(f"n_{KINDS[k]}")
    return found.select("doc_id", *[count(k) for k in range(3)], F.expr(f"sha2({_listed(base)}, 256)").alias("base_sha256"), F.expr(_listed(every)).alias("spans"))


def redact(df: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``df`` with every span of its texts replaced by ``mark``, spans that overlap as one; other
    columns, and texts without a find, stay as they are (null stays null)."""
    found, _, every = with_spans(df, train(df, text_col), text_col)
    text = quoted(text_col)
    # the last end of a span before each place, and before the end
    ends = _folded(f"concat(array(0), transform({every}, s -> s.e))", "greatest(x, get(a, i - shiftleft(1, j)))")
    cuts = f"zip_with({ends}, concat(transform({every}, s -> s.b), array(length({text}))), (at, b) -> named_struct('k', cast(at div {BLOCK} as int), 'more', cast(b div {BLOCK} - at div {BLOCK} as int), 'at', cast(at % {BLOCK} + 1 as int), 'n', b - at))"
    near = "if(c.more <= 1, concat(coalesce(get(t, c.k), ''), coalesce(get(t, c.k + 1), '')), array_join(slice(t, c.k + 1, c.more + 1), ''))"
    pieces = f"transform(filter({cuts}, c -> c.n >= 0), c -> substring({near}, c.at, c.n))"
    done = _let("t", f"regexp_extract_all({text}, r'(?s).{{1,{BLOCK}}}', 0)", f"array_join({pieces}, '{mark}')")
    return found.withColumn(text_col, F.expr(f"if(size({every}) = 0, {text}, {done})")).select(*columns_of(df))
