"""Compression of vectors to codes: each part of a vector becomes the index of a codebook entry.

Vectors are cut into equal parts of whole numbers.  Each task builds metric trees (``metric_trees``)
over the parts of its vectors, a shard of bounded size at a time, and writes them to the shared
folder once.  Every round of training walks the written trees with the current codebooks: balls
owned as a whole add their cached sums and counts.  What comes to the driver is one sum and one
count per entry, so its size is that of the codebooks; vectors are never shuffled.

Vectors that are null or hold null or non-finite components are dropped.  So are, as a code stands
for one length, vectors of another length than the most frequent one (the longer if two are as
frequent), and vectors with a component that is too large for exact squared distances in 64 bits
(``largest``: about 2^27 / 1024 for 64 components a part).  A length that the number of parts does
not divide is filled up with zeros.  Null ids come last in the order of ids; equal ids are ordered
by their vectors.  With fewer vectors than entries there are as many entries as vectors.  Repeated
rows are vectors of their own.  Null labels make one group.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import io
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import metric_trees
from .common import col, materialise, tidy


def largest(width: int) -> int:
    """Bound of components, so that squared distances of parts of this width are exact."""
    return min(metric_trees.MOST, math.isqrt((1 << 61) // max(1, width)))


def whole_numbers(vectors: DataFrame, scale: int, parts: int, id_col: str, vector_col: str, label_col: str) -> tuple[DataFrame, int]:
    """vec_id, label and v (whole numbers) of the vectors that are kept, and the width of a part."""
    rows = vectors.select(col(id_col).alias("vec_id"), col(label_col).alias("label"), col(vector_col).cast("array<double>").alias("v"))
    fine = F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(fine)
    size = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    length = size["size"] if size else 0
    width = -(-length // parts)
    rows = rows.where((F.size("v") == length) & ~F.exists("v", lambda x: F.abs(x * scale) >= largest(width) - 1))
    return rows.select("vec_id", "label", F.transform("v", lambda x: F.floor(x * scale).cast("bigint")).alias("v")), width


def _packed(tree: metric_trees.Tree) -> bytes:
    held = io.BytesIO()
    np.savez(held, **vars(tree) | {"points": tree.points.astype(np.int32), "order": tree.order.astype(np.int32)})
    return held.getvalue()


def _tree(raw: bytes) -> metric_trees.Tree:
    with np.load(io.BytesIO(raw)) as held:
        found = {k: held[k] for k in held.files}
    return metric_trees.Tree(**found | {"points": found["points"].astype(np.int64)})


def shard_trees(rows: DataFrame, width: int, parts: int = 4, shard_rows: int = 16_384, leaf: int = 24) -> DataFrame:
    """A row for each shard of at most ``shard_rows`` vectors: ids, labels and a tree for each part."""
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def shard(table: pa.Table) -> pa.RecordBatch:
            ids, labels, v = (table.column(k).combine_chunks() for k in range(3))
            flat = np.asarray(v.flatten(), np.int64)
            flat = flat.reshape(len(v), flat.size // len(v))
            flat = np.pad(flat, ((0, 0), (0, parts * width - flat.shape[1])))
            trees = [_packed(metric_trees.build(flat[:, k * width : (k + 1) * width], leaf)) for k in range(parts)]
            one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            return pa.RecordBatch.from_arrays([one(ids), one(labels), pa.array([trees], pa.list_(pa.binary()))], names=["ids", "labels", "trees"])

        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                some = batch.slice(at, shard_rows - size)
                held.append(some)
                at, size = at + some.num_rows, size + some.num_rows
                if size == shard_rows:
                    yield shard(pa.Table.from_batches(held))
                    held, size = [], 0
        if held:
            yield shard(pa.Table.from_batches(held))

    return rows.select("vec_id", "label", "v").mapInArrow(tidy(run), f"ids array<{kinds['vec_id']}>, labels array<{kinds['label']}>, trees array<binary>")


def first_books(rows: DataFrame, width: int, parts: int, entries: int) -> list[np.ndarray]:
    """Codebooks of the parts of the ``entries`` vectors with the smallest ids."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").select("v").limit(entries).collect()  # bounded by entries
    x = np.array([r["v"] for r in first], np.int64).reshape(len(first), len(first[0]["v"]) if first else 0)
    x = np.pad(x, ((0, 0), (0, parts * width - x.shape[1])))
    return [x[:, k * width : (k + 1) * width] for k in range(parts)]


def improved(trees: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after one more round; unused entries stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = [np.zeros(len(b), np.int64) for b in books]
        sums = [np.zeros(b.shape, np.int64) for b in books]
        for batch in batches:
            for row in batch.column(0).to_pylist():
                for k, raw in enumerate(row):
                    _, some, total = metric_trees.assign(_tree(raw), books[k])
                    n[k] += some
                    sums[k] += total
        for k, (count, total) in enumerate(zip(n, sums, strict=True)):
            used = np.flatnonzero(count)
            table = np.concatenate([count[used, None], total[used]], axis=1)  # place 0 is the count
            entry, place = (x.ravel() for x in np.broadcast_arrays(used[:, None], np.arange(table.shape[1])))
            yield pa.RecordBatch.from_pydict({"part": pa.array(np.full(table.size, k), pa.int32()), "entry": pa.array(entry, pa.int32()), "place": pa.array(place, pa.int32()), "value": table.ravel()})

    sums = trees.select("trees").mapInArrow(tidy(run), "part int, entry int, place int, value bigint")
    got = sums.groupBy("part", "entry", "place").agg(F.sum("value").alias("value")).toArrow()  # bounded by the codebooks
    out = []
    for k, book in enumerate(books):
        table = np.zeros((len(book), book.shape[1] + 1), np.int64)
        mine = got.filter(pa.compute.equal(got.column("part"), k))
        table[mine.column("entry").to_numpy(), mine.column("place").to_numpy()] = mine.column("value").to_numpy()
        used = table[:, :1] > 0
        out.append(np.where(used, np.floor_divide(table[:, 1:], np.maximum(table[:, :1], 1)), book))
    return out


def coded(trees: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """vec_id, label, code (two hex digits a part) and error (squared distances over all parts)."""
    ids, labels = (dict(trees.dtypes)[c][len("array<") : -1] for c in ("ids", "labels"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digits = np.array([f"{k:02x}" for k in range(256)])
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                names, error = [], 0
                for raw, book in zip(one.column(2).to_pylist()[0], books, strict=True):
                    tree = _tree(raw)
                    codes, _, _ = metric_trees.assign(tree, book)
                    back = np.empty_like(tree.order)
                    back[tree.order] = np.arange(len(back))
                    names.append(digits[codes[back]])
                    error = error + ((tree.points - book[codes]) ** 2).sum(1)[back]
                code = names[0]
                for more in names[1:]:
                    code = np.char.add(code, more)
                yield pa.RecordBatch.from_arrays([one.column(0).flatten(), one.column(1).flatten(), pa.array(code.tolist(), pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    return trees.mapInArrow(tidy(run), f"vec_id {ids}, label {labels}, code string, error bigint")


def books_digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components by part, entry and position, comma-joined."""
    return hashlib.sha256(",".join(str(x) for book in books for x in book.ravel().tolist()).encode()).hexdigest()


def compress_vectors(
    vectors: DataFrame, scale: int = 1024, parts: int = 4, entries: int = 256, rounds: int = 4, shard_rows: int = 16_384, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> tuple[DataFrame, list[np.ndarray]]:
    """vec_id, label, code and error of each vector that is kept, and the codebooks.

    ``entries`` is at most 256, as an index takes two hex digits."""
    if not 0 < entries <= 256:
        raise ValueError("an index of two hex digits needs 1 to 256 entries")
    rows, width = whole_numbers(vectors, scale, parts, id_col, vector_col, label_col)
    books = first_books(rows, width, parts, entries)
    trees = materialise(shard_trees(rows, width, parts, shard_rows), "vector-trees")
    if len(books[0]):
        for _ in range(rounds):
            books = improved(trees, books)
    return coded(trees, books), books


def code_rows(vectors: DataFrame, **options) -> DataFrame:
    """Per vector: vec_id, code, error, label_error and codebooks_sha256."""
    codes, books = compress_vectors(vectors, **options)
    codes = materialise(codes, "vector-codes")
    # a row a label, written so that its size is known before it is joined
    labels = materialise(codes.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "label-errors", light=True)
    done = codes.join(labels, F.col("label").eqNullSafe(F.col("of")))
    return done.select("vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


def _sql(rounds: int = 4, parts: int = 4, entries: int = 256, scale: int = 1024) -> str:
    """DuckDB: every part compared with every entry, round after round.  The exact squares are below
    2^53, so they may be computed as doubles."""
    nearest = """assigned{k} AS MATERIALIZED (
  SELECT r, c.part, c.label, c.vec_id, any_value(c.c) AS c, min({{'d': d, 'entry': entry}}) AS best
  FROM (
    SELECT c.*, b.entry, (list_inner_product(c.c, c.c) - 2 * list_inner_product(c.c, b.c) + list_inner_product(b.c, b.c))::BIGINT AS d
    FROM cells c JOIN book{k} b USING (part)
  ) c GROUP BY r, c.part, c.label, c.vec_id
)"""
    update = """sums{k} AS (
  SELECT part, entry, place, sum(x::BIGINT)::BIGINT AS s, count(*)::BIGINT AS n
  FROM (SELECT part, best.entry AS entry, unnest(c) AS x, generate_subscripts(c, 1) AS place FROM assigned{k}) GROUP BY part, entry, place
),
book{next} AS MATERIALIZED (
  SELECT b.part, b.entry, coalesce(m.c, b.c) AS c
  FROM book{k} b LEFT JOIN (SELECT part, entry, list(((s - ((s % n) + n) % n) // n)::DOUBLE ORDER BY place) AS c FROM sums{k} GROUP BY part, entry) m USING (part, entry)
)"""
    steps = [s for k in range(rounds) for s in (nearest.format(k=k), update.format(k=k, next=k + 1))]
    steps.append(nearest.format(k=rounds))
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label, [floor({scale} * x::DOUBLE) FOR x IN embedding] AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
),
cells AS MATERIALIZED (SELECT r, vec_id, label, part, v[part * (len(v) // {parts}) + 1 : (part + 1) * (len(v) // {parts})] AS c FROM kept, range({parts}) t(part)),
book0 AS MATERIALIZED (SELECT part, r - 1 AS entry, c FROM cells WHERE r <= {entries}),
{",".join(steps)},
digest AS (SELECT sha256(string_agg(x::BIGINT::VARCHAR, ',' ORDER BY part, entry, place)) AS codebooks_sha256 FROM (SELECT part, entry, unnest(c) AS x, generate_subscripts(c, 1) AS place FROM book{rounds})),
done AS (
  SELECT r, vec_id, label, string_agg(printf('%02x', best.entry), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error FROM assigned{rounds} GROUP BY r, vec_id, label
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM done, digest
"""


SQL = _sql()
