"""Nearest neighbours of tiles, the graph they make, and a reduction of vectors by its smoothest functions.

``nearest`` compares blocks of tiles pair by pair, as density clustering does, so pairs of tiles exist in tasks alone
and the work grows with the square of the tiles (at most ``density.MOST``). ``neighbour_graph`` weighs the links by
the tiles' own scales. ``reduce_by_neighbours`` finds the leading eigenvectors of the graph's normalised matrix by
subspace iteration with a Chebyshev filter: a product with the matrix is a join of links and tiles and one sum per tile,
and the driver sees sums of products of vectors, a matrix of a few rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written
from .density import BLOCK, MOST, _opened, _pairs, distances
from .split import global_rank

#: Vectors beside those wanted: they let the last wanted ones settle.
GUARDS = 3
#: Products with the matrix between two written tables.
HOPS = 6
LINK = "array<struct<d: double, other: long>>"


def placed(tiles: DataFrame, metric: str = "cosine") -> DataFrame:
    """``id, tile_key, vec``: tiles with a vector, from 0 in the order of the keys' digests; unit vectors for ``cosine``.

    A vector of zeros has no direction and stays as it is, so its cosine distance to any other is 0.5.
    """
    t = tiles.where("vec is not null").select("tile_key", F.col("vec").cast("array<double>").alias("vec"))
    if metric == "cosine":
        length = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))
        t = t.withColumn("l", length).select("tile_key", F.when(F.col("l") > 0, F.transform("vec", lambda x: x / F.col("l"))).otherwise(F.col("vec")).alias("vec"))
    elif metric != "euclidean":
        raise ValueError(f"metric {metric!r}: cosine or euclidean")
    return global_rank(t, F.md5("tile_key"), "id").withColumn("id", F.col("id") - 1)


def nearest(points: DataFrame, n: int, k: int, metric: str = "cosine") -> DataFrame:
    """``id, d, other``: the ``k`` nearest others of each of ``n`` points (``id, vec``; all others, if fewer), nearest
    first by distance to nine decimals and by id. Points with copies have these at distance 0.

    ``cosine`` expects unit vectors, for which 1 - cosine is half the squared distance.
    """
    def near(batches):
        for alone, vec, ids in _opened(batches, ["id"]):
            d = distances(vec, vec)
            d = np.round(d * d / 2 if metric == "cosine" else d, 9)
            block = ids // BLOCK
            # In a pair of two blocks only what lies between them is new.
            d[(block[:, None] == block) if not alone else np.eye(len(ids), dtype=bool)] = np.inf
            # Columns by id, so that a stable order settles ties.
            by_id = np.argsort(ids)
            order = by_id[np.argsort(d[:, by_id], axis=1, kind="stable")[:, :k]]
            kept = np.take_along_axis(d, order, axis=1)
            there = np.isfinite(kept)
            offsets = np.concatenate([[0], np.cumsum(there.sum(axis=1))]).astype(np.int32)
            links = pa.StructArray.from_arrays([pa.array(kept[there]), pa.array(ids[order][there])], ["d", "other"])
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.ListArray.from_arrays(pa.array(offsets), links)], ["id", "x"])

    few = _pairs(points.select("id", "vec"), n).mapInArrow(near, f"id long, x {LINK}")
    best = few.groupBy("id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("x"))), 1, k).alias("x"))
    return best.select("id", F.posexplode("x").alias("p", "x")).select("id", (F.col("p") + 1).alias("k"), "x.d", "x.other")


def nearest_tiles(tiles: DataFrame, k: int, metric: str = "cosine") -> DataFrame:
    """``tile_key, k, other, d``: the ``k`` nearest other tiles of each tile (``tile_key, vec``), from 1. Tiles without a vector take no part."""
    points = placed(tiles, metric)
    n = _bounded(points)
    names = points.select(F.col("id").alias("other"), F.col("tile_key").alias("name"))
    near = nearest(points, n, k, metric).join(points.select("id", "tile_key"), "id").join(names, "other")
    return near.select("tile_key", "k", F.col("name").alias("other"), "d")


def _bounded(points: DataFrame) -> int:
    n = points.count()
    if n > MOST:
        raise ValueError(f"{n} tiles; neighbours are found among at most {MOST}")
    return n


def neighbour_graph(near: DataFrame) -> DataFrame:
    """``a, b, w``: links of ``nearest`` in both directions, whoever of the two is near the other.

    A point's scale is the distance of its farthest link; a link weighs ``exp(-d^2 / (scale_a scale_b))``, and 1 between copies.
    """
    scale = near.groupBy("id").agg(F.max("d").alias("s"))
    pairs = near.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"), "d").groupBy("a", "b").agg(F.min("d").alias("d"))
    j = pairs.join(scale.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(scale.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    # A copy's scale may be 0; its farther links then weigh as little as a double holds.
    w = F.when(F.col("d") == 0, 1.0).otherwise(F.greatest(F.exp(-F.col("d") * F.col("d") / F.greatest(F.col("sa") * F.col("sb"), F.lit(1e-300))), F.lit(1e-12)))
    g = j.select("a", "b", w.alias("w"))
    return g.unionByName(g.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))


def _combined(names: list[str], matrix: np.ndarray, shift: np.ndarray | None = None) -> list:
    """Columns ``names @ matrix``, less ``u`` times ``shift``."""
    out = []
    for j in range(matrix.shape[1]):
        e = sum((F.col(n) * float(x) for n, x in zip(names, matrix[:, j])), F.lit(0.0))
        out.append(e if shift is None else e - F.col("u") * float(shift[j]))
    return out


def _products(rows: DataFrame, pairs: list[tuple[str, str]]) -> np.ndarray:
    return np.array(rows.agg(*[F.coalesce(F.sum(F.col(a) * F.col(b)), F.lit(0.0)).alias(f"p{i}") for i, (a, b) in enumerate(pairs)]).first())


def _basis(gram: np.ndarray) -> np.ndarray:
    """Columns that turn vectors with these products into orthonormal ones; directions without length go."""
    size, turn = np.linalg.eigh(gram)
    keep = size > max(size.max(initial=0.0), 0.0) * 1e-12
    return turn[:, keep] / np.sqrt(size[keep])


def graph_functions(graph: DataFrame, dims: int, rounds: int = 25, tolerance: float = 1e-3) -> tuple[DataFrame, np.ndarray]:
    """``id, f1 ... f<dims>`` and their eigenvalues: the smoothest functions on a graph's points (``a, b, w``), largest
    eigenvalue of the random walk first, without the constant one, in units of their root mean square over the links.

    Ends when each wanted vector is an eigenvector up to ``tolerance``, or after ``rounds`` tables; links that
    fall in several parts have an eigenvalue 1 for each part but one. With fewer points than functions the last ones are 0.
    """
    degree = graph.groupBy(F.col("a").alias("id")).agg(F.sum("w").alias("g"))
    degree = written(degree, "degrees")
    total = degree.agg(F.sum("g")).first()[0]
    if not total:
        return degree.select("id", *[F.lit(0.0).alias(f"f{i + 1}") for i in range(dims)]), np.zeros(dims)
    side = lambda x: degree.select(F.col("id").alias(x), F.col("g").alias("g" + x))
    links = graph.join(side("a"), "a").join(side("b"), "b").select("a", "b", (F.col("w") / F.sqrt(F.col("ga") * F.col("gb"))).alias("w"))
    # A point meets itself with weight 0: that row carries its own values along.
    links = written(links.unionByName(degree.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0.0).alias("w"))), "links")
    m = dims + GUARDS
    # The start depends on ids alone.
    start = [(F.pmod(F.xxhash64("id", F.lit(i)), F.lit(1 << 20)) / float(1 << 20) - 0.5).alias(f"y{i}") for i in range(m)]
    rows = written(degree.select("id", F.sqrt(F.col("g") / total).alias("u"), *start), "vectors")
    cut = 0.0
    for step in range(rounds + 1):
        y = [f"y{i}" for i in range(m)]
        got = _products(rows, [("u", a) for a in y] + [(a, b) for i, a in enumerate(y) for b in y[i:]])
        along, gram = got[:m], np.zeros((m, m))
        gram[np.triu_indices(m)] = got[m:]
        gram = gram + np.triu(gram, 1).T - np.outer(along, along)
        basis = _basis(gram)
        m = basis.shape[1]
        if not m:
            break
        q, s, y, z = ([f"{c}{i}" for i in range(m)] for c in "qsyz")
        now = rows.select("id", "u", *[e.alias(n) for e, n in zip(_combined([f"y{i}" for i in range(len(along))], basis, along @ basis), q)])
        # s = S q, then y = 2 (S - c) / e y - z, z the y before: values of the unwanted part of the spectrum, [-1, cut], stay below 1.
        middle, half = (cut - 1) / 2, (cut + 1) / 2
        own = F.col("a") == F.col("b")

        def product(t: DataFrame, of: list[str], carry: list[str]) -> DataFrame:
            j = links.join(t.withColumnRenamed("id", "b"), "b")
            return j.groupBy(F.col("a").alias("id")).agg(*[F.sum(F.col("w") * F.col(n)).alias("p" + n) for n in of], *[F.sum(F.when(own, F.col(n))).alias(n) for n in carry])

        t = product(now, q, ["u", *q])
        t = t.select("id", "u", *q, *[F.col("p" + a).alias(b) for a, b in zip(q, s)], *[((F.col("p" + a) - middle * F.col(a)) / half).alias(b) for a, b in zip(q, y)], *[F.col(a).alias(b) for a, b in zip(q, z)])
        for _ in range(HOPS - 1):
            t = product(t, y, ["u", *q, *s, *y, *z])
            t = t.select("id", "u", *q, *s, *[(2 * (F.col("p" + a) - middle * F.col(a)) / half - F.col(b)).alias(a) for a, b in zip(y, z)], *[F.col(a).alias(b) for a, b in zip(y, z)])
        rows = written(t.select("id", "u", *q, *s, *y), "vectors")
        got = _products(rows, [(a, b) for a in q for b in s] + [(a, b) for a in s for b in s])
        inner, outer = got[:m * m].reshape(m, m), got[m * m:].reshape(m, m)
        value, turn = np.linalg.eigh((inner + inner.T) / 2)
        value, turn = value[::-1], turn[:, ::-1]
        rest = np.sqrt(np.maximum(np.einsum("ij,ik,kj->j", turn, outer, turn) - value ** 2, 0))
        if step == rounds or (rest[:dims] <= tolerance).all():
            break
        cut = float(np.clip(value[-1], -0.5, 0.995)) if m > dims else cut
    if not m:
        return rows.select("id", *[F.lit(0.0).alias(f"f{i + 1}") for i in range(dims)]), np.zeros(dims)
    found = min(dims, m)
    f = [(e / F.col("u")).alias(f"f{i + 1}") for i, e in enumerate(_combined(q, turn[:, :found]))]
    return rows.select("id", *f, *[F.lit(0.0).alias(f"f{i + 1}") for i in range(found, dims)]), np.concatenate([value[:found], np.zeros(dims - found)])


def reduce_by_neighbours(tiles: DataFrame, dims: int = 2, k: int = 15, metric: str = "cosine", rounds: int = 25, tolerance: float = 1e-3, out: str = "reduced") -> DataFrame:
    """``tile_key`` and ``out``, an array of ``dims`` values: tiles (``tile_key, vec``) that are near one another, or linked by
    many short ways, are near in the few dimensions, too.

    Values are rounded to nine decimals. Tiles without a vector have null, a single tile zeros; no tiles give no rows.
    More than ``density.MOST`` tiles are an error.
    """
    points = placed(tiles, metric)
    n = _bounded(points)
    if n < 2:
        return tiles.select("tile_key", F.when(F.col("vec").isNotNull(), F.array(*[F.lit(0.0)] * dims)).alias(out))
    points = written(points, "points")
    f, _ = graph_functions(written(neighbour_graph(nearest(points, n, k, metric)), "graph"), dims, rounds, tolerance)
    at = points.select("id", "tile_key").join(f, "id").select("tile_key", F.array(*[F.round(f"f{i + 1}", 9) + F.lit(0.0) for i in range(dims)]).alias(out))
    # Repeated keys with vectors are points of their own; a key without one comes back once per row.
    return at.unionByName(tiles.where("vec is null").select("tile_key", F.lit(None).cast("array<double>").alias(out)))
