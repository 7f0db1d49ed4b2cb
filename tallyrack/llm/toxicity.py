"""Toxicity scores behind a noisy-channel restoration of disguised words.

Restoration: a token with digits or signs for letters, stretched letters or letters set apart is
a lattice (each sign may stand for some letters, a stretched letter for one or two, a gap for
nothing or for a space).  Viterbi decoding finds its likeliest reading under a trigram model of
characters, whose counts are gathered from every document of the table.

Scoring: words and word beginnings that set apart the labelled toxic texts get weights by
logistic regression: an L1-penalised fit chooses them, a refit weighs them.  It learns from a
bounded sample of the labelled rows that are not held out: ``toxic_rows`` and ``clean_rows``
that come first by hash of their id, exact copies once.

Null and empty texts have no words and get the score of a text without any weighted word.
Several labels of one document count as toxic if one of them is.  Without labelled rows of both
kinds no word has a weight and every score is 0.  Every row is scored by itself.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, columns_of, free_name, map_batches, materialise, text_slices, tidy

#: What letters a sign may stand for.
SIGNS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "*": "aeiou", "#": "h",
}
HIDDEN = re.compile("[­​-‏⁠﻿]")
APART = re.compile(r"(?<!\S)\S(?:[ \t]\S){2,}(?!\S)")
DOTTED = re.compile(r"\S(?:[.\-_*~]\S){2,}")
STRETCHED = re.compile(r"([^\W\d_])\1\1")
LETTER = re.compile(r"[^\W\d_]")
EDGES = re.compile(r"^[\W_]+|[\W_]+$")
SYMBOLS = 28  # a gap, 26 letters, any other letter


def symbol_table() -> np.ndarray:
    """Symbols of UTF-8 bytes of lower-cased text: 1 to 26 letters, 27 parts of others, 0 a gap."""
    table = np.zeros(256, np.int64)
    table[97:123] = np.arange(1, 27)
    table[128:] = 27
    return table


def trigram_counts(df: DataFrame, text_col: str = "text") -> np.ndarray:
    """Counts of the 28 x 28 x 28 symbol trigrams of all texts; tasks send sums, not texts."""
    size = SYMBOLS**3

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, total = symbol_table(), np.zeros(size, np.int64)
        for batch in batches:
            for _, texts in text_slices(batch.column(0)):
                for text in filter(None, texts):
                    s = np.pad(table[np.frombuffer(text.lower().encode(), np.uint8)], 2)
                    total += np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=size)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"gram": seen, "n": total[seen]}, schema=pa.schema([("gram", pa.int64()), ("n", pa.int64())]))

    out = np.zeros(size, np.int64)
    for row in df.select(col(text_col)).mapInArrow(tidy(count), "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).collect():
        out[row["gram"]] = row["n"]
    return out


class Restorer:
    """Viterbi decoding of disguised tokens under a character trigram model."""

    def __init__(self, counts: np.ndarray, sign_cost: float = 1.0, cut_cost: float = 6.0):
        grams = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS) + 0.1
        self.log = np.log(grams / grams.sum(axis=2, keepdims=True)).tolist()
        self.sign_cost, self.cut_cost = sign_cost, cut_cost

    @staticmethod
    def symbol(c: str) -> int:
        return ord(c) - 96 if "a" <= c <= "z" else 27 if c.isalpha() else 0

    def lattice(self, token: str) -> list[list[tuple[str, float]]]:
        """For each place the texts that may have been meant, with their costs."""
        out: list[list[tuple[str, float]]] = []
        at = 0
        apart = len(token) > 2 and bool(APART.fullmatch(token) or DOTTED.fullmatch(token))
        while at < len(token):
            c = token[at]
            if apart and at % 2:
                out.append([("", 0.0), (" ", self.sign_cost)])
            elif c in SIGNS:
                out.append([(x, self.sign_cost) for x in SIGNS[c]] + [(" ", self.cut_cost)])
            elif not c.isalpha():
                out.append([(" ", 0.0)])
            else:
                end = at
                while end < len(token) and token[end] == c:
                    end += 1
                if end - at > 2:
                    out.append([(c, 0.0), (c * 2, 0.5)])
                    at = end
                    continue
                out.append([(c, 0.0)])
            at += 1
        return out

    def restore(self, token: str) -> str:
        """The likeliest reading."""
        log, symbol = self.log, self.symbol
        best: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        for choices in self.lattice(token):
            after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (score, path) in best.items():
                for text, cost in choices:
                    x, y, s = a, b, score - cost
                    for c in text:
                        z = symbol(c)
                        s += log[x][y][z]
                        x, y = y, z
                    old = after.get((x, y))
                    if old is None or s > old[0]:
                        after[x, y] = (s, (path, text))
            best = after
        _, path = max(((s + log[a][b][0], p) for (a, b), (s, p) in best.items()), key=lambda x: x[0])
        parts = []
        while path is not None:
            path, text = path
            parts.append(text)
        return "".join(reversed(parts))


class WordReader:
    """The words of a text, disguised ones restored as well; tokens are remembered."""

    def __init__(self, restorer: Restorer, keep, cache_tokens: int = 150_000):
        self.restorer, self.keep = restorer, keep
        self.cache: dict[str, tuple] = {}
        self.cache_tokens = cache_tokens

    def _token(self, token: str) -> tuple:
        words = {EDGES.sub("", token)}
        inner = next(iter(words))
        odd = LETTER.search(token) and (any(c in SIGNS for c in token) and (any(c in SIGNS for c in inner) or token[0] in SIGNS or token[-1] in "@$3"))
        if odd or STRETCHED.search(token) or DOTTED.fullmatch(token):
            words.update(self.restorer.restore(token).split())
            words.update(self.restorer.restore(inner).split())
        found = tuple(sorted({f for w in words if w for f in self.keep(w)}))
        if len(token) <= 40:
            if len(self.cache) >= self.cache_tokens:
                self.cache.clear()
            self.cache[token] = found
        return found

    def features(self, text: str) -> set:
        """What ``keep`` makes of the text's words."""
        text = HIDDEN.sub("", text.lower())
        get, make = self.cache.get, self._token
        out: set = set()
        for token in text.split():
            found = get(token)
            if found is None:
                found = make(token)
            if found:
                out.update(found)
        for m in APART.finditer(text):
            for w in self.restorer.restore(m.group()).split():
                out.update(self.keep(w))
        return out


def beginnings(word: str) -> list[str]:
    """A word, its first 3 to 8 letters, and the same where few letters follow."""
    n = len(word)
    return [f"={word}", *[word[:k] for k in range(3, min(n, 8) + 1)], *[f"{word[:k]}~" for k in range(max(3, n - 5), min(n - 1, 8) + 1)]]


def _descend(x: np.ndarray, rows: np.ndarray, cols: np.ndarray, y: np.ndarray, l1: float, l2: float, steps: int) -> np.ndarray:
    """Weights >= 0 (the last one, free, is the offset) of a logistic regression on a sparse
    0/1 matrix, by accelerated proximal steps with a step size from each column's sum."""
    n, m = len(y), len(x)
    per_row = max(1, np.bincount(rows, minlength=n).max(initial=1)) + 1
    scale = 4.0 / (per_row * np.append(np.bincount(cols, minlength=m - 1), n)[:m].clip(1)) / 1.0
    z, t = x.copy(), 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(rows, z[cols], n) + z[-1], -30, 30)))
        slope = np.append(np.bincount(cols, (p - y)[rows], m - 1), (p - y).sum()) + np.append(l2 * z[:-1], 0.001 * z[-1])
        new = z - scale * slope
        new[:-1] = np.maximum(0, new[:-1] - scale[:-1] * l1)
        s = (1 + math.sqrt(1 + 4 * t * t)) / 2
        z, x, t = new + (t - 1) / s * (new - x), new, s
    return x


def fit(found: list[np.ndarray], toxic: np.ndarray, names: list[str], steps: int = 300) -> tuple[dict[str, float], float]:
    """Weights of words and beginnings, and the offset.  ``found``: of each text, the indices
    into ``names`` of what it has."""
    y = toxic.astype(float)
    n_toxic, n_clean = int(y.sum()), int(len(y) - y.sum())
    if not n_toxic or not n_clean:
        return {}, -30.0
    offset = math.log(n_toxic / n_clean)
    rows = np.repeat(np.arange(len(found)), [len(f) for f in found])
    cols = np.concatenate([*found, np.zeros(0, np.int64)]).astype(np.int64)
    hits = np.bincount(cols[y[rows] == 1], minlength=len(names))
    misses = np.bincount(cols[y[rows] == 0], minlength=len(names))
    for l1, l2, times in ((1.5 + 0.004 * n_toxic, 0.0, steps), (0.0, 0.05, 2 * steps)):
        likely = np.flatnonzero(hits / n_toxic > 3 * misses / n_clean)
        back = np.full(len(names), -1)
        back[likely] = np.arange(len(likely))
        held = back[cols] >= 0
        w = _descend(np.append(np.zeros(len(likely)), offset), rows[held], back[cols[held]], y, l1, l2, times)
        chosen = w[:-1] > 1e-3
        hits[np.setdiff1d(np.arange(len(names)), likely[chosen])] = 0  # the refit has the chosen ones only
    return {names[c]: float(v) for c, v in zip(likely[chosen], w[:-1][chosen], strict=True)}, float(w[-1])


def _features(sample: DataFrame, counts: np.ndarray, n_toxic: int) -> tuple[list[str], list[np.ndarray], np.ndarray]:
    """Words and beginnings that toxic texts have more than three times as often as clean ones; of
    each text, which of them it has."""

    def tally(rows: DataFrame, keep) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            reader, seen = WordReader(Restorer(counts), keep), Counter()
            for batch in batches:
                for text in batch.column(0).to_pylist():
                    seen.update(reader.features(text))
            yield pa.RecordBatch.from_pydict({"feature": list(seen), "n": list(seen.values())}, schema=pa.schema([("feature", pa.string()), ("n", pa.int64())]))

        return rows.select("text").mapInArrow(tidy(run), "feature string, n bigint").groupBy("feature").agg(F.sum("n").alias("n"))

    n_clean = max(1, sample.where("toxic = 0").count())
    hits = {r["feature"]: r["n"] for r in tally(sample.where("toxic = 1"), beginnings).where(F.col("n") >= max(2, n_toxic // 200)).collect()}
    likely = set(hits)
    misses = {r["feature"]: r["n"] for r in tally(sample.where("toxic = 0"), lambda w: [f for f in beginnings(w) if f in likely]).collect()}
    names = sorted(f for f, n in hits.items() if n / n_toxic > 3 * misses.get(f, 0) / n_clean)
    place = {f: i for i, f in enumerate(names)}

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = WordReader(Restorer(counts), lambda w: [place[f] for f in beginnings(w) if f in place])
        for batch in batches:
            found = [sorted(reader.features(t)) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, pa.list_(pa.int32()))], names=["toxic", "found"])

    got = sample.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(tidy(look), "toxic int, found array<int>").toPandas()
    return names, [np.asarray(f, np.int32) for f in got["found"]], got["toxic"].to_numpy()


def held_out(doc_id: Column) -> Column:
    """Rows that no label may be learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(
    docs: DataFrame, labels: DataFrame, toxic_rows: int = 1500, clean_rows: int = 3000, id_col: str = "doc_id", text_col: str = "text"
) -> tuple[np.ndarray, dict[str, float], float]:
    """Trigram counts of all texts, and weights learnt from the bounded sample."""
    counts = trigram_counts(docs, text_col)
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    parts = [known.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for k, n in ((1, toxic_rows), (0, clean_rows))]
    # bounded by toxic_rows + clean_rows, so it may be broadcast
    sample = F.broadcast(parts[0].unionByName(parts[1]).select(F.col("doc_id").alias("__id"), F.col("toxic").alias("__toxic")))
    texts = docs.select(col(id_col).alias("__doc"), F.coalesce(col(text_col), F.lit("")).alias("text"))
    found = materialise(texts.join(sample, F.col("__doc") == F.col("__id")).groupBy("text").agg(F.max("__toxic").alias("toxic")), "labelled-sample")
    # an id may stand on many texts, so the bound is applied to the texts again
    found = [found.where(F.col("toxic") == k).orderBy(F.xxhash64("text"), "text").limit(n) for k, n in ((1, toxic_rows), (0, clean_rows))]
    found = materialise(found[0].unionByName(found[1]), "bounded-sample").repartition(8)
    n_toxic = found.where("toxic = 1").count()
    if not n_toxic:
        return counts, {}, -30.0
    names, seen, toxic = _features(found, counts, n_toxic)
    weights, offset = fit(seen, toxic, names)
    return counts, weights, offset


def with_score(df: DataFrame, model: tuple[np.ndarray, dict[str, float], float], text_col: str = "text", name: str = "score") -> tuple[DataFrame, str]:
    """``df`` with one more column, whose name is returned: the score of each text."""
    name = free_name(df.columns, name)
    counts, weights, offset = model
    place = df.columns.index(text_col)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = WordReader(Restorer(counts), lambda w: [f for f in beginnings(w) if f in weights])
        for batch in batches:
            sums = [offset + sum(weights[f] for f in sorted(reader.features(t))) if t else offset for _, texts in text_slices(batch.column(place)) for t in texts]
            out = 1 / (1 + np.exp(-np.clip(np.array(sums, float), -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*batch.schema.names, name])

    return map_batches(df, score, f"{name} double"), name


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score and predicted."""
    rows = docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text"))
    scored, name = with_score(rows, train(rows, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col(name).alias("score"), (F.col(name) >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The documents that score below ``threshold``, with all their columns."""
    scored, name = with_score(docs, train(docs, labels))
    return scored.where(F.col(name) < threshold).select(*columns_of(docs))
