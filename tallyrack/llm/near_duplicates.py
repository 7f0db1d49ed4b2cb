"""Near-duplicate documents by Order MinHash, verified by banded alignment.

Two texts are linked if their sequences of five-word shingles align (same shingles in the same
order) in M places with M / (n + m - M) >= 0.8: a Jaccard index that honours repeats and order.

1. Texts of equal word sequences are one entity from the start (``fp``), whatever their number.
2. Entities that share one of 16 sketches meet in a bucket.  First each is tried against the
   bucket's smallest entity only, so a group of copies costs a trial a member.
3. What that leaves in several components is tried in full: within buckets, in blocks of about
   ``block`` members, pairs of different components that share at least ``agree`` sketches
   (one) and whose lengths and shared shingles allow the threshold are aligned too,
   until links connect them.  A pair is tried where its first common sketch is.  No bucket is
   capped, and pairs are never emitted, only links: at most one a member and block pair.
4. Components of the verified links give the classes.

A pair at the threshold shares none of 16 sketches of 3 shingles once in about 100,000 cases if its
texts are long, once in 24,000 at 8 of 10 shingles, and once in 3,500 at 4 of 5.

Texts of fewer than five words are one shingle.  Texts without a word (null, empty, signs only)
are in classes of their own.  Rows that repeat in full are one class, each with its row.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, columns_of, free_name, map_batches, materialise, text_slices, tidy
from .components import components
from .order_minhash import labelled, sketches
from .shingles import Shingler

BANDS, TAKE = 16, 3
#: Flags over hashed ids: 16 an id, within these bounds (128 kB to 32 MB packed).
LEAST_SLOTS, MOST_SLOTS = 1 << 20, 1 << 28


def fingerprint(numbers: np.ndarray) -> bytes:
    from xxhash import xxh3_128_digest

    return xxh3_128_digest(numbers.tobytes())


def sketch_documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per row: id, fp, n (shingles), bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            ids = batch.column(0)
            for at, texts in text_slices(batch.column(1)):
                numbers = [shingler.numbers(shingler.words(t or "")) for t in texts]
                shingles, starts = shingler.shingles(numbers)
                bands = sketches(shingles, starts, BANDS, TAKE)
                width = bands.shape[1]
                lists = pa.ListArray.from_arrays(np.arange(0, bands.size + 1, width, dtype=np.int32), pa.array(bands.astype(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays(
                    [ids[at : at + 256], pa.array([fingerprint(x) for x in numbers], pa.binary()), pa.array(np.diff(starts)), lists],
                    names=["id", "fp", "n", "bands"],
                )

    kind = dict(docs.dtypes)[id_col]
    return docs.select(col(id_col).alias("id"), col(text_col).alias("text")).mapInArrow(tidy(run), f"id {kind}, fp binary, n bigint, bands array<bigint>")


def aligned(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether the best alignment's matches are ``least`` of both sequences' union.

    With M matches, a place i of ``a`` can only meet places j of ``b`` in the band
    -(len(b) - M) <= i - j <= len(a) - M; within it the longest common subsequence is found by
    patience over matching places.
    """
    n, m = len(a), len(b)
    need = int(np.ceil(least / (1 + least) * (n + m) - 1e-9))
    if need > min(n, m) or not need:
        return False
    short = min(n, m)
    differ = np.flatnonzero(a[:short] != b[:short])
    head = int(differ[0]) if differ.size else short
    rest = short - head
    differ = np.flatnonzero(a[n - rest :][::-1] != b[m - rest :][::-1])
    tail = int(differ[0]) if differ.size else rest
    left = need - head - tail
    if left <= 0:
        return True
    x, y = a[head : n - tail], b[head : m - tail]
    if left > min(len(x), len(y)) or np.isin(x, y).sum() < left:
        return False
    low, high = -(len(y) - left), len(x) - left
    places: dict[int, list[int]] = {}
    for j, v in enumerate(y.tolist()):
        places.setdefault(v, []).append(j)
    ends: list[int] = []
    for i, v in enumerate(x.tolist()):
        for j in reversed(places.get(v, ())):
            if low <= i - j <= high:
                k = bisect_left(ends, j)
                if k == len(ends):
                    ends.append(j)
                else:
                    ends[k] = j
    return len(ends) >= left


class Flags:
    """Which hashed values a column has: 16 flags a value, 2**28 at most, so a million ids to 16
    million pass one row in 16 in vain, and more than that save less work; none changes a result.
    They are put together on Spark, 32768 to a row, and only then sent."""

    def __init__(self, df: DataFrame, column: str):
        wanted = 16 * df.count()
        self.slots = min(MOST_SLOTS, max(LEAST_SLOTS, 1 << max(1, wanted - 1).bit_length()))
        place = self.slot(column) + F.lit(1)
        parts = df.groupBy(F.bitmap_bucket_number(place).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
        packed = np.zeros((self.slots // 32768, 4096), np.uint8)
        for row in parts.toLocalIterator():
            packed[row["k"] - 1] = np.frombuffer(row["bits"], np.uint8)
        self.packed = packed.tobytes()

    def slot(self, column: str) -> Column:
        return F.pmod(F.xxhash64(col(column)), F.lit(self.slots))

    def test(self) -> Callable[[np.ndarray], np.ndarray]:
        bits = np.frombuffer(self.packed, np.uint8)
        return lambda slots: (bits[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 == 1


def _flagged(docs: DataFrame, flags: Flags, id_col: str, wanted: bool, text_col: str | None = None, fp_col: str = "fp") -> DataFrame:
    """The rows whose hashed id is flagged, or those whose is not; given ``text_col``, with their
    texts' fingerprints."""
    columns = docs.columns
    packed = flags.test

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_flagged = packed()
        shingler = Shingler()
        for batch in batches:
            found = is_flagged(batch.column(len(columns)).to_numpy()) == wanted
            out = batch.select(list(range(len(columns)))).filter(pa.array(found))
            if text_col:
                slices = text_slices(out.column(columns.index(text_col)))
                fps = pa.array([fingerprint(shingler.numbers(shingler.words(t or ""))) for _, texts in slices for t in texts], pa.binary())
                out = pa.RecordBatch.from_arrays([*out.columns, fps], names=[*out.schema.names, fp_col])
            yield out

    return map_batches(docs, run, f"{fp_col} binary" if text_col else "", [flags.slot(id_col)])


def _sequences(docs: DataFrame, needed: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(fp, seq) of the entities in ``needed`` (id, fp): 32-bit shingles of one row of each.

    Flags over hashed ids keep most other rows' texts from being shingled; a join on fp follows.
    """
    flags = Flags(needed, "id")
    packed = flags.test

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_flagged = packed()
        shingler = Shingler()
        for batch in batches:
            batch = batch.filter(pa.array(is_flagged(batch.column(2).to_numpy())))
            for at, texts in text_slices(batch.column(1)):
                numbers = [shingler.numbers(shingler.words(t or "")) for t in texts]
                shingles, starts = shingler.shingles(numbers)
                short = (shingles >> np.uint64(32)).astype("<u4")
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[at : at + 256], pa.array([fingerprint(x) for x in numbers], pa.binary()), pa.array([short[a:b].tobytes() for a, b in zip(starts, starts[1:], strict=False)], pa.binary())],
                    names=["id", "fp", "seq"],
                )

    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(col(id_col).alias("id"), col(text_col).alias("text"), flags.slot(id_col).alias("slot")).mapInArrow(tidy(run), f"id {kind}, fp binary, seq binary")
    wanted = needed.select(F.col("id").alias("want_id"), F.col("fp").alias("want_fp"))
    found = rows.join(wanted, (F.col("fp") == F.col("want_fp")) & F.col("id").eqNullSafe(F.col("want_id")), "left_semi")
    return materialise(found.dropDuplicates(["fp"]).select("fp", "seq"), "sequences")


def _verified(docs: DataFrame, entities: DataFrame, pairs: DataFrame, least: float, id_col: str, text_col: str) -> DataFrame:
    """The pairs (a, b) whose alignment reaches ``least``."""
    ends = pairs.select(F.col("a").alias("fp")).unionByName(pairs.select(F.col("b").alias("fp"))).distinct()
    needed = materialise(entities.join(ends, "fp", "left_semi").select("id", "fp"), "needed", light=True)
    seqs = _sequences(docs, needed, id_col, text_col)
    # plain scans on both sides of either join: a text with many partners can be split
    first = materialise(pairs.join(seqs.select(F.col("fp").alias("a"), F.col("seq").alias("seq_a")), "a"), "half-pairs", light=True)
    both = first.join(seqs.select(F.col("fp").alias("b"), F.col("seq").alias("seq_b")), "b").select("a", "b", "seq_a", "seq_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (c.to_pylist() for c in batch.columns[2:])
            good = [aligned(np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4"), least) for x, y in zip(a, b, strict=True)]
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    return materialise(both.mapInArrow(tidy(run), "a binary, b binary"), "verified", light=True)


def _common(rows: list[np.ndarray], columns: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """How many labelled shingles each row shares with each column: products of 0/1 matrices, a
    slice of the shingles at a time."""
    both = np.concatenate([*rows, *columns])
    values, place = np.unique(both, return_inverse=True)
    owner = np.repeat(np.arange(len(rows) + len(columns)), [len(x) for x in (*rows, *columns)])
    often = np.bincount(place, minlength=len(values)) > 1
    number = np.cumsum(often) - 1
    held = often[place]
    place, owner = number[place[held]], owner[held]
    order = np.argsort(place, kind="stable")
    place, owner = place[order], owner[order]
    out = np.zeros((len(rows), len(columns)), np.float32)
    for start in range(0, int(often.sum()), width):
        a, b = np.searchsorted(place, [start, start + width])
        flags = np.zeros((len(rows) + len(columns), width), np.float32)
        flags[owner[a:b], place[a:b] - start] = 1
        out += flags[: len(rows)] @ flags[len(rows) :].T
    return out


class Cell:
    """The members of a bucket in one or two of its blocks, and which pairs may be links: of
    different components, of allowing lengths, and not with an earlier common sketch, where the
    pair is tried instead."""

    def __init__(self, cell: pa.Table, agree: int, least: float):
        self.names: dict[bytes, int] = {}
        self.roots = np.array([self.names.setdefault(r, len(self.names)) for r in cell.column("root").to_pylist()])
        n, own = cell.column("n").to_numpy(), cell.column("own").to_numpy()
        i, j = cell.column("i")[0].as_py(), cell.column("j")[0].as_py()
        bands = np.array(cell.column("bands").to_pylist(), np.int64)
        here = int(np.flatnonzero(bands[0] == np.int64(cell.column("key")[0].as_py()))[0])
        xs, ys = np.flatnonzero(own == i), np.flatnonzero(own == j)
        maybe = self.roots[xs][:, None] != self.roots[ys][None]
        common = np.zeros(maybe.shape, np.int8)
        for band in range(bands.shape[1]):
            same = bands[xs, band][:, None] == bands[ys, band][None]
            if band < here:
                maybe &= ~same
            common += same
        small, large = np.minimum(n[xs][:, None], n[ys][None]), np.maximum(n[xs][:, None], n[ys][None])
        maybe &= (common >= agree) & (small >= least * large)
        if i == j:
            maybe &= xs[:, None] < ys[None]
        rows, columns = np.flatnonzero(maybe.any(axis=1)), np.flatnonzero(maybe.any(axis=0))
        self.xs, self.ys, self.maybe, self.total = xs[rows], ys[columns], maybe[np.ix_(rows, columns)], (small + large)[np.ix_(rows, columns)]


def _cross_links(docs: DataFrame, members: DataFrame, known: DataFrame, block: int, agree: int, least: float, id_col: str, text_col: str) -> DataFrame:
    """Verified links between different components in the buckets' blocks.

    ``members``: key, fp, root; ``known``: fp, id, n, bands.  Each member goes to a row and a column
    of block pairs, first with its sketches alone; those with a pair that may be a link come again
    with their sequences.  A block is ``block`` members or ``block`` * 4096 shingles on average, so
    a task holds two of them.  The likeliest pairs are aligned first, and pairs that links connect
    by then not at all; so a block pair gives at most one link a member, however many pairs it holds.
    """
    placed = materialise(members.join(known.select("fp", "n", "bands"), "fp"), "placed", light=True)
    sizes = placed.groupBy("key").agg(F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("n") / (block * 4096))).cast("int").alias("blocks"))
    dealt = placed.join(materialise(sizes, "blocks", light=True), "key").withColumn("own", F.pmod(F.xxhash64("fp"), "blocks").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", "fp", "root", "n", "bands", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def look(table: pa.Table) -> pa.Table:
        cell = Cell(table, agree, least)
        return table.take(np.union1d(cell.xs, cell.ys).astype(np.int64))

    kinds = dict(dealt.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in dealt.columns)
    wanted = materialise(dealt.groupBy("key", "i", "j").applyInArrow(look, schema), "to-compare")
    needed = materialise(known.join(wanted.select("fp").distinct(), "fp", "left_semi").select("id", "fp"), "needed", light=True)
    seqs = _sequences(docs, needed, id_col, text_col)

    def run(table: pa.Table) -> pa.Table:
        cell = Cell(table, agree, least)
        out_a, out_b = [], []
        if cell.xs.size:
            fp, roots, xs, ys = table.column("fp").to_pylist(), cell.roots, cell.xs, cell.ys
            seq = table.column("seq")
            seq = {k: np.frombuffer(seq[k].as_py(), "<u4") for k in {*xs.tolist(), *ys.tolist()}}
            starts = np.concatenate([[0], np.cumsum([len(x) for x in seq.values()])])
            flat = labelled(np.concatenate([*seq.values()]).astype(np.uint64), starts)
            labels = {k: flat[a:b] for k, a, b in zip(seq, starts, starts[1:], strict=False)}
            shared = _common([labels[k] for k in xs.tolist()], [labels[k] for k in ys.tolist()])
            share = shared / (cell.total - shared)
            at = np.argwhere(cell.maybe & (share >= least - 1e-6))
            parent = list(range(len(cell.names)))

            def root(r: int) -> int:
                while parent[r] != r:
                    parent[r] = parent[parent[r]]
                    r = parent[r]
                return r

            for a, b in at[np.argsort(-share[at[:, 0], at[:, 1]], kind="stable")].tolist():
                x, y = int(xs[a]), int(ys[b])
                p, q = root(int(roots[x])), root(int(roots[y]))
                if p != q and aligned(seq[x], seq[y], least):
                    parent[q] = p
                    out_a.append(fp[x])
                    out_b.append(fp[y])
        return pa.table({"a": pa.array(out_a, pa.binary()), "b": pa.array(out_b, pa.binary())})

    return materialise(wanted.join(seqs, "fp").groupBy("key", "i", "j").applyInArrow(run, "a binary, b binary"), "cross-links")


def near_duplicate_classes(
    docs: DataFrame, least: float = 0.8, agree: int = 1, block: int = 256, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row of ``docs``: doc_id, class_id (the smallest id of its class), kept, fp and the
    number of rows in the class.

    A class keeps one (doc_id, fp): that of the smallest id, null ids last, and of the smallest fp
    of several.  Rows that repeat it are all marked as kept."""
    sketched = materialise(sketch_documents(docs, id_col, text_col), "sketches")
    entities = sketched.where("n > 0").groupBy("fp").agg(F.min("id").alias("id"), *[F.any_value(c).alias(c) for c in ("n", "bands")])
    entities = materialise(entities, "entities")
    entries = entities.select("fp", F.explode("bands").alias("key"))
    buckets = entries.groupBy("key").agg(F.min("fp").alias("center"), F.count("*").alias("size")).where("size > 1")
    buckets = materialise(buckets, "buckets", light=True)
    members = materialise(entries.join(buckets, "key"), "members", light=True)

    star = materialise(members.where("fp <> center").select(F.col("center").alias("a"), F.col("fp").alias("b")).distinct(), "star-candidates", light=True)
    sides = [entities.select(F.col("fp").alias(s), F.col("bands").alias(f"bands_{s}"), F.col("n").alias(f"n_{s}")) for s in ("a", "b")]
    alike = F.size(F.array_intersect("bands_a", "bands_b")) >= agree
    long = F.least("n_a", "n_b") >= least * F.greatest("n_a", "n_b")
    half = materialise(star.join(sides[0], "a"), "star-half", light=True)
    star = materialise(half.join(sides[1], "b").where(alike & long).select("a", "b"), "star", light=True)
    links = _verified(docs, entities, star, least, id_col, text_col)
    roots = components(links)

    # buckets that still hold several components
    rooted = members.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select("key", "fp", F.coalesce("root", "fp").alias("root"))
    rooted = materialise(rooted, "rooted", light=True)
    open_keys = rooted.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("key")
    left = materialise(rooted.join(materialise(open_keys, "open", light=True), "key").select("key", "fp", "root"), "left", light=True)
    known = materialise(entities.select("fp", "id", "n", "bands").join(left.select("fp").distinct(), "fp", "left_semi"), "left-entities", light=True)
    more = _cross_links(docs, left, known, block, agree, least, id_col, text_col)
    roots = components(links.unionByName(more))

    classed = sketched.select("id", "fp", "n").join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left")
    classed = materialise(classed.select("id", "fp", "n", F.coalesce("root", "fp").alias("root")), "classed")
    least_id = materialise(classed.where("n > 0").groupBy("root").agg(F.min("id").alias("least"), F.min(F.struct(F.col("id").isNull().alias("unknown"), "id", "fp")).alias("keeper"), F.count("*").alias("rows")).where("rows > 1"), "class-ids", light=True)
    out = classed.join(least_id, "root", "left")
    class_id = F.when(F.col("n") > 0, F.coalesce("least", "id")).otherwise(F.col("id"))
    kept = ~((F.col("n") > 0) & F.col("rows").isNotNull()) | (F.col("id").eqNullSafe(F.col("keeper.id")) & (F.col("fp") == F.col("keeper.fp")))
    return out.select(F.col("id").alias("doc_id"), class_id.alias("class_id"), F.coalesce(kept, F.lit(True)).alias("kept"), "fp", F.coalesce("rows", F.lit(1)).alias("class_rows"))


def drop_near_duplicates(docs: DataFrame, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class with all columns: that of the smallest id (null ids last), then of
    the smallest word sequence's fp, then of the smallest text.  Rows without a word stay all."""
    classes = materialise(near_duplicate_classes(docs, least, id_col=id_col, text_col=text_col), "classes")
    # what is decided belongs to an id and a word sequence: either may stand elsewhere with the other's like
    dropped = classes.where("not kept").select("doc_id", "fp", F.lit(True).alias("gone")).distinct()
    again = classes.where("kept and class_rows > 1").groupBy("doc_id", "fp").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", "fp", F.lit(False).alias("gone"))
    marks = materialise(dropped.unionByName(again), "marks", light=True)
    names = list(docs.columns)
    mark_id, mark_fp, gone, fp, whole = (names.append(free_name(names, c)) or names[-1] for c in ("marked_id", "marked_fp", "gone", "fp", "whole_row"))
    marked = marks.select(F.col("doc_id").alias(mark_id), F.col("fp").alias(mark_fp), F.col("gone").alias(gone))
    # most rows are seen not to be dropped from their flag alone, and so are not shuffled
    flags = Flags(marks, "doc_id")
    flagged = _flagged(docs, flags, id_col, True, text_col, fp)
    within = (F.col(fp) == F.col(mark_fp)) & col(id_col).eqNullSafe(F.col(mark_id))
    rest = flagged.join(marked, within, "left_anti").select(*columns_of(docs)).unionByName(_flagged(docs, flags, id_col, False))
    if marks.where("not gone").isEmpty():
        return rest
    once = flagged.join(marked.where(~F.col(gone)), within, "left_semi")
    once = once.groupBy(col(id_col), fp).agg(F.min_by(F.struct(*columns_of(docs)), col(text_col)).alias(whole)).select(f"`{whole}`.*")
    return rest.unionByName(once)
