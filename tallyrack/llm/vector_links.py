"""Near-equal vectors by product quantisation, with an exact rerank.

Vectors are dealt into coarse inverted lists (nearest centroid), as many as the square root of the
largest label's vectors, so that lists and their number grow alike; what is left of a vector after
taking off the centroid is coded a subspace at a time.  With radius r = sqrt(2 - 2 * least) between
unit vectors, a partner in list j lies beyond the plane half-way between the centroids i and j.  A
vector probes every list whose plane is within min(r, ``sigmas`` * r / sqrt(dim)) of it: the part of
a partner's difference along one direction has a spread of r / sqrt(dim) at most if no direction is
preferred, so at 4 of them a list is left out wrongly about 3 times in 100,000; with ``sigmas`` of
sqrt(dim) or more the search is exact.  In a list, distances to codes are sums of table look-ups;
since each code's own error is stored, a partner is never farther than r plus that error, and what
passes is ranked again by the exact cosine in double precision.

Only vectors of equal label (not null) and length are compared.  Vectors that are null, zero or
hold nulls or non-finite numbers link with nothing, and neither do those without a label.
Equal vectors of a label are one entity with a number of copies, so copies are never paired.
Rows that repeat in full are vectors of their own, linked with each other.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, materialise, tidy
from .components import components


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 9) -> np.ndarray:
    """Centroids by Lloyd's rounds from random rows."""
    rng = np.random.default_rng(seed)
    centres = x[np.sort(rng.permutation(len(x))[:k])].copy()
    for _ in range(rounds):
        owner = np.argmin((centres**2).sum(1) - 2 * x @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, owner, x)
        n = np.bincount(owner, minlength=len(centres))[:, None]
        centres = np.where(n > 0, sums / np.maximum(n, 1), centres)
    return centres


class Quantiser:
    """Coarse centroids and subspace codebooks for vectors of one length."""

    def __init__(self, sample: np.ndarray, lists: int = 64, codes: int = 64, width: int = 8):
        dim = sample.shape[1]
        self.cuts = list(range(0, dim, width)) + [dim]
        self.centres = kmeans(sample, min(lists, max(1, len(sample) // 30)))
        left = sample - self.centres[self.nearest(sample)]
        self.books = [kmeans(left[:, a:b], min(codes, len(sample))) for a, b in zip(self.cuts, self.cuts[1:], strict=False)]
        between = ((self.centres[:, None] - self.centres[None]) ** 2).sum(-1)
        self.apart = np.sqrt(between)

    def squares(self, x: np.ndarray) -> np.ndarray:
        return (x**2).sum(1)[:, None] + (self.centres**2).sum(1) - 2 * x @ self.centres.T

    def nearest(self, x: np.ndarray) -> np.ndarray:
        return np.argmin(self.squares(x), axis=1)

    def probes(self, x: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
        """Nearest list of each vector, and which lists can hold a partner."""
        d = self.squares(x)
        own = np.argmin(d, axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            to_plane = (d - d[np.arange(len(x)), own][:, None]) / (2 * self.apart[own])
        return own, ~(to_plane > radius + 1e-6)

    def encode(self, x: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes, and the distance of each vector from what its codes stand for."""
        left = x - self.centres[own]
        codes, error = [], np.zeros(len(x))
        for (a, b), book in zip(zip(self.cuts, self.cuts[1:], strict=False), self.books, strict=True):
            part = left[:, a:b]
            d = (part**2).sum(1)[:, None] + (book**2).sum(1) - 2 * part @ book.T
            best = np.argmin(d, axis=1)
            codes.append(best)
            error += ((part - book[best]) ** 2).sum(1)
        return np.stack(codes, axis=1).astype(np.uint8), np.sqrt(error)

    def distances(self, queries: np.ndarray, which: int, codes: np.ndarray) -> np.ndarray:
        """Distances of queries to the codes of a list, by table look-up."""
        left = queries - self.centres[which]
        total = np.zeros((len(queries), len(codes)))
        for k, ((a, b), book) in enumerate(zip(zip(self.cuts, self.cuts[1:], strict=False), self.books, strict=True)):
            part = left[:, a:b]
            tables = (part**2).sum(1)[:, None] + (book**2).sum(1) - 2 * part @ book.T
            total += tables[:, codes[:, k]]
        return np.sqrt(np.maximum(total, 0))


def _unit(packed: list[bytes], dim: int) -> np.ndarray:
    x = np.frombuffer(b"".join(packed), "<f8").reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither vanish nor overflow
    return x / np.sqrt((x**2).sum(axis=1, keepdims=True))


def _entities(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows with the fp of their entity (null if they link with nothing), and the entities."""
    doubles = col(vector_col).cast("array<double>")
    rows = vectors.select(col(id_col).alias("vec_id"), doubles.alias("v"), col(label_col).alias("label"))
    fine = F.col("label").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)
    finite = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    # adding 0.0 makes of -0.0 a 0.0, so equal vectors have equal texts of their numbers
    name = F.sha2(F.concat_ws(",", F.col("label").cast("string"), F.array_join(F.transform("v", lambda x: (x + F.lit(0.0)).cast("string")), ",")), 256)
    rows = rows.withColumn("fp", F.when(fine & finite, name))
    rows = materialise(rows, "vectors")
    good = rows.where("fp is not null").groupBy("fp").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.any_value("label").alias("label"), F.any_value("v").alias("v"))
    return rows.select("vec_id", "fp"), materialise(good.withColumn("dim", F.size("v")), "entities")


def train(entities: DataFrame, sample: int = 20_000) -> dict[int, Quantiser]:
    """A quantiser for each vector length among the ``sample`` entities that come first by fp, a
    hash; lengths that the sample lacks are searched as one list.  At most ``sample`` / 30 lists."""
    largest = entities.groupBy("label").count().agg(F.max("count")).first()[0] or 1
    rows = entities.orderBy("fp").limit(sample).select("dim", "v").toPandas()
    found = {}
    for dim, group in rows.groupby("dim"):
        x = np.array(group["v"].tolist(), float)
        x = x / np.abs(x).max(axis=1, keepdims=True)
        found[int(dim)] = Quantiser(x / np.sqrt((x**2).sum(axis=1, keepdims=True)), lists=math.isqrt(largest - 1) + 1)
    return found


def link_vectors(
    vectors: DataFrame, least: float = 0.98, sample: int = 20_000, block: int = 512, sigmas: float = 4.0, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """Per row: vec_id, n_links, component_id and kept."""
    rows, entities = _entities(vectors, id_col, vector_col, label_col)
    quantisers = train(entities, sample)
    radius = math.sqrt(max(0.0, 2 - 2 * least))

    def place(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            vs = batch.column("v").to_pylist()
            packed = [np.array(v, "<f8").tobytes() for v in vs]
            own, probes, codes, errors = [0] * len(vs), [[0]] * len(vs), [b""] * len(vs), [2.0] * len(vs)
            for dim in np.unique(dims):
                q = quantisers.get(int(dim))
                if q is None:
                    continue
                at = np.flatnonzero(dims == dim)
                x = _unit([packed[i] for i in at], int(dim))
                near, can = q.probes(x, radius * min(1.0, sigmas / math.sqrt(int(dim))))
                code, error = q.encode(x, near)
                for k, i in enumerate(at):
                    own[i], probes[i], codes[i], errors[i] = int(near[k]), np.flatnonzero(can[k]).tolist(), code[k].tobytes(), float(error[k])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("fp", "least", "label", "dim", "copies")), pa.array(packed, pa.binary()), pa.array(own, pa.int32()), pa.array(probes, pa.list_(pa.int32())), pa.array(codes, pa.binary()), pa.array(errors)],
                names=["fp", "least", "label", "dim", "copies", "vec", "list", "probes", "codes", "error"],
            )

    kind, id_kind = (dict(entities.dtypes)[c] for c in ("label", "least"))
    placed = entities.select("fp", "least", "label", "dim", "copies", "v").mapInArrow(
        tidy(place), f"fp string, least {id_kind}, label {kind}, dim int, copies bigint, vec binary, list int, probes array<int>, codes binary, error double"
    )
    placed = materialise(placed, "placed")
    where = ["label", "dim", "list"]
    probing = placed.select("fp", "label", "dim", F.explode("probes").alias("list"))
    sizes = placed.groupBy(*where).agg(F.count("*").alias("n_members")).join(probing.groupBy(*where).agg(F.count("*").alias("n_queries")), where)
    sizes = materialise(sizes.select(*where, F.ceil(F.col("n_members") / block).cast("int").alias("mb"), F.ceil(F.col("n_queries") / block).cast("int").alias("qb")), "list-sizes")
    salt = lambda n: F.pmod(F.xxhash64("fp"), F.col(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    members = placed.select("fp", "least", *where, "copies", "vec", "codes", "error").join(sizes, where)
    members = members.select(F.lit(True).alias("member"), "fp", "least", *where, "copies", "vec", "codes", "error", salt("mb").alias("m"), all_of("qb").alias("q"))
    queries = placed.select("fp", "least", "label", "dim", F.explode("probes").alias("list"), "vec").join(sizes, where)
    queries = queries.select(F.lit(False).alias("member"), "fp", "least", *where, F.lit(None).cast("bigint").alias("copies"), "vec", F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("double").alias("error"), all_of("mb").alias("m"), salt("qb").alias("q"))

    def compare(cell: pa.Table) -> pa.Table:
        dim, which = cell.column("dim")[0].as_py(), cell.column("list")[0].as_py()
        is_member = cell.column("member").to_numpy()
        fp, at_m, at_q = np.array(cell.column("fp").to_pylist(), object), np.flatnonzero(is_member), np.flatnonzero(~is_member)
        firsts, seconds, links = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        if at_m.size and at_q.size:
            packed = cell.column("vec").to_pylist()
            xm, xq = _unit([packed[i] for i in at_m], dim), _unit([packed[i] for i in at_q], dim)
            copies = cell.column("copies").to_numpy(zero_copy_only=False)[at_m].astype(np.int64)
            fm, fq = fp[at_m], fp[at_q]
            quantiser = quantisers.get(dim)
            if quantiser is None:
                maybe = np.ones((len(xq), len(xm)), bool)
            else:
                raw = cell.column("codes").to_pylist()
                codes = np.frombuffer(b"".join([raw[i] for i in at_m]), np.uint8).reshape(len(at_m), -1)
                error = cell.column("error").to_numpy(zero_copy_only=False)[at_m].astype(float)
                maybe = quantiser.distances(xq, which, codes) <= radius + error + 1e-6
            a, b = np.nonzero(maybe)
            cosine = np.concatenate([np.einsum("ij,ij->i", xq[a[k : k + 65536]], xm[b[k : k + 65536]]) for k in range(0, len(a), 65536)] or [np.zeros(0)])
            good = (cosine >= least) & (fq[a] != fm[b])
            a, b = a[good], b[good]
            n_links = np.bincount(a, copies[b], len(xq)).astype(np.int64)
            # links of the cell as stars: at most one row an entity goes out
            names, places = np.unique(np.concatenate([fq[a], fm[b]]), return_inverse=True)
            parent = list(range(len(names)))

            def root(i: int) -> int:
                while parent[i] != i:
                    parent[i] = parent[parent[i]]
                    i = parent[i]
                return i

            for x, y in zip(places[: len(a)].tolist(), places[len(a) :].tolist(), strict=True):
                x, y = root(x), root(y)
                if x != y:
                    parent[max(x, y)] = min(x, y)
            # where each name stands in the cell
            rows = np.zeros(len(names), np.int64)
            rows[places] = np.concatenate([at_q[a], at_m[b]])
            counts = np.zeros(len(names), np.int64)
            counts[places[: len(a)]] = n_links[a]
            firsts, seconds, links = rows, rows[[root(i) for i in range(len(names))]], counts
        return pa.table({"fp": cell.column("fp").take(firsts), "least": cell.column("least").take(firsts), "links": links, "root_fp": cell.column("fp").take(seconds), "root_least": cell.column("least").take(seconds)})

    cells = members.unionByName(queries).groupBy(*where, "m", "q").applyInArrow(compare, f"fp string, least {id_kind}, links bigint, root_fp string, root_least {id_kind}")
    found = materialise(cells, "cells")
    # nodes sort by their smallest vec_id, nulls last, so a component's root has its smallest
    node = lambda least, fp: F.struct(F.col(least).isNull().alias("unknown"), F.col(least).alias("least"), F.col(fp).alias("fp"))
    roots = components(found.select(node("least", "fp").alias("a"), node("root_least", "root_fp").alias("b")))
    links = found.groupBy("fp").agg(F.sum("links").alias("links"))
    linked = roots.select(F.col("node.fp").alias("fp"), F.col("root.least").alias("root_least"))
    answers = entities.select("fp", "least", "copies").join(links, "fp", "left").join(linked, "fp", "left")
    answers = answers.select("fp", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root_least", "least").alias("component_id"))
    done = rows.join(materialise(answers, "answers"), "fp", "left")
    component = F.coalesce("component_id", "vec_id")
    return done.select("vec_id", F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
