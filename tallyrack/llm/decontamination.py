"""Benchmark items inside documents: size-partitioned MinHash containment search.

Items are dealt into classes by their number of five-word shingles, each up to twice the last.
For a class of at most U shingles a document is covered by windows of 2 U shingles that overlap
by half, so wherever an item stands, some window holds all of it and is not much larger: that
bounds the Jaccard index of the two from below, and one equal minimum out of ``hashes`` finds
the window with near certainty (an item of which 0.8 is present is missed once in about a
million).  A document that a window proposes is verified by exact containment: the share of the
item's distinct shingles, compared as words, that the document has.

The items are the small side: they are sent to the tasks in slices of at most ``slice_bytes``,
measured beforehand, and the corpus is read once a slice.  A worker builds the index of a slice
once: the texts and arrays of numbers, in all some ten times the slice's bytes.

An item of one to four words is one shingle of that many words: it is looked up among a document's
shingles of that width and compared as words.  Null items and those without a word are never found;
null and empty documents hold nothing.  Equal items are all reported, and share one entry in the
index; rows that repeat are searched by themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, map_batches, once, text_slices, tidy
from .shingles import Shingler, factors, mixed

WIDTH = 5
TABLE = 1 << 16


class ItemIndex:
    """Items by size class and minimum.

    Held are the items' texts and, as numbers in arrays, 64 minima of each; the words of an item are
    made when a text is compared with it, and some hundred items' words are remembered."""

    def __init__(self, items: list[tuple[object, str]], hashes: int = 64, seed: int = 5):
        self.shingler = Shingler(WIDTH)
        self.factors = factors(hashes, seed)
        self.items = items
        self.known: dict[int, set[tuple[str, ...]]] = {}
        classes: dict[int, list[tuple[int, np.ndarray]]] = {}
        short: dict[int, tuple[list[int], list[np.ndarray]]] = {}
        for item, (_, text) in enumerate(items):
            words = self.shingler.words(text or "")
            numbers = self.shingler.numbers(words)
            if len(words) >= WIDTH:
                shingles, _ = self.shingler.shingles([numbers])
                classes.setdefault((len(shingles) - 1).bit_length(), []).append((item, shingles))
            elif words:
                members, found = short.setdefault(len(words), ([], []))
                members.append(item)
                found.append(numbers)
        self.classes = []
        for bits, members in sorted(classes.items()):
            every = np.concatenate([m[1] for m in members])
            starts = np.cumsum([0, *(len(m[1]) for m in members[:-1])])
            names = np.array([m[0] for m in members], np.int32)
            values, order = np.empty((hashes, len(members)), np.uint64), np.empty((hashes, len(members)), np.int32)
            flags = np.zeros((hashes, TABLE), bool)
            for h, factor in enumerate(self.factors):
                least = np.minimum.reduceat(mixed(every * factor), starts)
                by = np.argsort(least, kind="stable")
                values[h], order[h] = least[by], names[by]
                flags[h, (least >> np.uint64(24)) % np.uint64(TABLE)] = True
            self.classes.append((1 << bits, values, order, flags))
        self.widths = []
        for width, (members, found) in sorted(short.items()):
            shingler = Shingler(width)
            numbers, _ = shingler.shingles(found)
            by = np.argsort(numbers, kind="stable")
            self.widths.append((width, shingler, numbers[by], np.array(members, np.int32)[by]))

    def shingles_of(self, item: int) -> set[tuple[str, ...]]:
        """The item's distinct shingles as words; one shingle if it has fewer words than five."""
        got = self.known.get(item)
        if got is None:
            words = self.shingler.words(self.items[item][1])
            width = min(WIDTH, len(words))
            got = {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}
            while len(self.known) >= 500:
                self.known.pop(next(iter(self.known)))
            self.known[item] = got
        return got

    def candidates(self, shingles: np.ndarray, starts: np.ndarray) -> set[tuple[int, int]]:
        """(text, item) pairs whose windows share a minimum."""
        counts = np.diff(starts)
        full = np.flatnonzero(counts)
        out: set[tuple[int, int]] = set()
        if not full.size or not self.classes:
            return out
        cuts = []
        for size, *_ in self.classes:
            blocks = -(-counts[full] // size)
            owner = np.repeat(full, blocks)
            first = np.cumsum(blocks) - blocks
            begin = np.repeat(starts[full], blocks) + (np.arange(len(owner)) - np.repeat(first, blocks)) * size
            cuts.append((begin, owner))
        for h, factor in enumerate(self.factors):
            values = mixed(shingles * factor)
            for (_, known, items, flags), (begin, owner) in zip(self.classes, cuts, strict=True):
                least = np.minimum.reduceat(values, begin)
                pair = np.minimum(least[:-1], least[1:])
                # a window is a block and the next one of the same text
                window = np.where(np.append(owner[1:] == owner[:-1], False), np.append(pair, least[-1]), least)
                maybe = np.flatnonzero(flags[h, (window >> np.uint64(24)) % np.uint64(TABLE)])
                if maybe.size:
                    at = np.searchsorted(known[h], window[maybe], "left")
                    end = np.searchsorted(known[h], window[maybe], "right")
                    for k in np.flatnonzero(end > at):
                        out.update((int(owner[maybe[k]]), int(i)) for i in items[h, at[k] : end[k]])
        return out

    def _whole(self, words: list[list[str]], numbers: list[np.ndarray]) -> Iterator[tuple[int, int, int]]:
        """The items of fewer than five words."""
        for width, shingler, wanted, members in self.widths:
            shingles, starts = shingler.shingles(numbers)
            at = np.flatnonzero(np.isin(shingles, wanted))
            owner = np.searchsorted(starts, at, "right") - 1
            seen = {(int(t), tuple(words[t][k : k + width]), int(x)) for t, k, x in zip(owner, (at - starts[owner]).tolist(), shingles[at], strict=True)}
            for text, run, number in seen:
                low, high = np.searchsorted(wanted, np.uint64(number), "left"), np.searchsorted(wanted, np.uint64(number), "right")
                for item in members[low:high].tolist():
                    if run in self.shingles_of(item):
                        yield text, item, 1

    def search(self, texts: list[str], least: float) -> list[tuple[int, int, int]]:
        """(text, item, shared shingles) of all items that a text contains."""
        words = [self.shingler.words(t) for t in texts]
        numbers = [self.shingler.numbers(w) for w in words]
        shingles, starts = self.shingler.shingles(numbers)
        found, known = sorted(self._whole(words, numbers)), {}
        for text, item in sorted(self.candidates(shingles, starts)):
            if text not in known:
                known = {text: {tuple(words[text][i : i + WIDTH]) for i in range(len(words[text]) - WIDTH + 1)}}
            wanted = self.shingles_of(item)
            shared = len(wanted & known[text])
            if shared >= least * len(wanted) - 1e-9:
                found.append((text, item, shared))
        return found


def _slices(items: DataFrame, slice_bytes: int) -> Iterator[tuple[list[tuple[int, str]], DataFrame]]:
    """Distinct texts of the items with a number each, about ``slice_bytes`` at a time, and the items'
    rows: however often a text repeats, one copy is sent."""
    rows = items.where("text is not null").select("item_id", "text")
    texts = rows.select("text").distinct().withColumn("key", F.xxhash64("text"))
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    parts = max(1, -(-size // slice_bytes))
    for k in range(parts):
        some = texts if parts == 1 else texts.where(F.pmod("key", F.lit(parts)) == k)
        found = list(enumerate(r["text"] for r in some.orderBy("text").toLocalIterator()))
        yield found, rows


def _index(some: list[tuple[int, str]]) -> Callable[[], ItemIndex]:
    """A function that gives tasks the index of a slice, built once a worker."""
    key = ("items", len(some), sha256("\0".join(text for _, text in some).encode()).digest())
    return lambda: once(key, lambda: ItemIndex(some))


def _chunks(texts: list[str], letters: int = 400_000) -> Iterator[tuple[int, int]]:
    start = total = 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= letters:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def find_leaks(
    docs: DataFrame, items: DataFrame, least: float = 0.8, slice_bytes: int = 16_000_000, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, item_id, n_shared, n_item (distinct shingles) and containment of every leak."""
    kind = dict(docs.dtypes)[id_col]
    out = None
    for some, rows in _slices(items, slice_bytes):

        def run(batches: Iterator[pa.RecordBatch], index_of=_index(some)) -> Iterator[pa.RecordBatch]:
            index = index_of()
            for batch in batches:
                ids = batch.column(0)
                for at, texts in text_slices(batch.column(1)):
                    texts = [t or "" for t in texts]
                    for a, b in _chunks(texts):
                        hits = index.search(texts[a:b], least)
                        if hits:
                            text, item, shared = zip(*hits, strict=True)
                            n = [len(index.shingles_of(i)) for i in item]
                            yield pa.RecordBatch.from_arrays(
                                [ids.take(pa.array([at + a + t for t in text])), pa.array([index.items[i][1] for i in item]), pa.array(shared), pa.array(n), pa.array([s / k for s, k in zip(shared, n, strict=True)])],
                                names=["doc_id", "text", "n_shared", "n_item", "containment"],
                            )

        part = docs.select(col(id_col).alias("id"), col(text_col).alias("text")).mapInArrow(tidy(run), f"doc_id {kind}, text string, n_shared bigint, n_item bigint, containment double")
        out = part if out is None else out.unionByName(part)
    # the text of an item stands for all items that have it
    return out.join(rows, "text").select("doc_id", "item_id", "n_shared", "n_item", "containment")


def drop_leaks(docs: DataFrame, items: DataFrame, least: float = 0.8, slice_bytes: int = 16_000_000, text_col: str = "text") -> DataFrame:
    """The documents that contain no item, with all their columns."""
    place = docs.columns.index(text_col)
    for some, _ in _slices(items, slice_bytes):

        def run(batches: Iterator[pa.RecordBatch], index_of=_index(some)) -> Iterator[pa.RecordBatch]:
            index = index_of()
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for at, texts in text_slices(batch.column(place)):
                    texts = [t or "" for t in texts]
                    for a, b in _chunks(texts):
                        keep[[at + a + t for t, _, _ in index.search(texts[a:b], least)]] = False
                yield batch.filter(pa.array(keep))

        docs = map_batches(docs, run)
    return docs


#: The same pairs in DuckDB: every distinct shingle of an item against those of a document.
SQL = r"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS a FROM documents
), b AS (
  SELECT row_number() OVER () AS r, item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS a FROM benchmark
), s AS (
  SELECT DISTINCT r, item_id, least(len(a), 5) AS width, array_to_string(a[i : i + least(len(a), 5) - 1], ' ') AS g
  FROM (SELECT r, item_id, a, unnest(range(1, greatest(len(a) - 3, 2))) AS i FROM b WHERE len(a) >= 1)
), widths AS (SELECT DISTINCT width FROM s
), n AS (SELECT r, count(*) AS n_item FROM s GROUP BY r
), d AS (
  SELECT DISTINCT r, doc_id, width, array_to_string(a[i : i + width - 1], ' ') AS g
  FROM (SELECT r, doc_id, a, width, unnest(range(1, len(a) - width + 2)) AS i FROM w, widths WHERE len(a) >= width)
), h AS (
  SELECT d.r, d.doc_id, s.r AS ir, s.item_id, count(*) AS n_shared FROM d JOIN s USING (width, g) GROUP BY ALL
)
SELECT doc_id, item_id, CAST(n_shared AS BIGINT) AS n_shared, CAST(n_item AS BIGINT) AS n_item, n_shared / n_item AS containment
FROM h JOIN n ON h.ir = n.r WHERE n_shared >= 0.8 * n_item - 1e-9
"""
