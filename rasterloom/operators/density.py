"""Density clustering of one vector per tile: core distances, minimum spanning tree, stable clusters.

A tile's core distance is that to its ``min_samples``-th neighbour; two tiles are as far apart as the largest of their
distance and both core distances. The minimum spanning tree of these distances tells how clusters merge; of the
merges of at least ``min_size`` tiles, those are kept whose clusters persist longest, and what belongs to none is noise (-1).

Tiles lie in blocks; each pair of blocks is a task, which keeps the nearest few of each tile, and then the spanning tree of its two
blocks: the whole tree is among those trees' edges. Edges are merged group by group, each group keeping its own
forest, until ``n - 1`` are left. So pairs of tiles exist in tasks alone. The work grows with
the square of the tiles (a row per tile, not per pixel), and the last step walks the tree in one task, hence the bound ``MOST``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .split import global_rank

BLOCK = 1024
MOST = 1_000_000  # tiles, at most: the tree's edges in one task (24 bytes each)
EDGE = "w double, a long, b long"


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances, band by band, so that equal vectors are at 0."""
    d = np.zeros((len(x), len(y)))
    for i in range(x.shape[1]):
        d += (x[:, i:i + 1] - y[:, i]) ** 2
    return np.sqrt(d)


def spanning_tree(w: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Edges ``w, a, b`` (a < b) of the tree of a full matrix; ties by the edge's ids."""
    n = len(ids)
    left = np.arange(1, n)
    at, best, far = 0, np.full(n, np.inf), np.zeros((n, 2), np.int64)
    out = []
    while len(left):
        a, b = np.minimum(ids[at], ids[left]), np.maximum(ids[at], ids[left])
        new = w[at, left]
        better = (new < best[left]) | ((new == best[left]) & ((a < far[left, 0]) | ((a == far[left, 0]) & (b < far[left, 1]))))
        j = left[better]
        best[j], far[j, 0], far[j, 1] = new[better], a[better], b[better]
        k = np.lexsort((far[left, 1], far[left, 0], best[left]))[0] if (best[left] == best[left].min()).sum() > 1 else int(best[left].argmin())
        at = left[k]
        out.append((best[at], *far[at]))
        left = np.delete(left, k)
    return np.array(out, dtype=[("w", float), ("a", np.int64), ("b", np.int64)])


class Sets:
    """Union and find."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def of(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = x = self.up.get(y, y)
        return x


def forest(edges: np.ndarray) -> np.ndarray:
    """Edges of the minimum spanning forest, in order."""
    sets, keep = Sets(), []
    edges = edges[np.lexsort((edges["b"], edges["a"], edges["w"]))]
    for i, (_, a, b) in enumerate(edges.tolist()):
        p, q = sets.of(a), sets.of(b)
        if p != q:
            sets.up[p] = q
            keep.append(i)
    return edges[keep]


def stable_clusters(edges: np.ndarray, n: int, min_size: int) -> np.ndarray:
    """Cluster of each of ``n`` points (-1: noise) from the sorted edges of their tree."""
    labels = np.full(n, -1, np.int64)
    if n < 2:
        return labels
    sets, node, size, kids, height = Sets(), {}, [1] * n, [None] * n, [0.0] * n
    for w, a, b in edges.tolist():
        p, q = sets.of(a), sets.of(b)
        x, y = node.get(p, p), node.get(q, q)
        sets.up[p] = q
        node[q] = len(size)
        size.append(size[x] + size[y])
        kids.append((x, y))
        height.append(w)

    def points(top: int) -> list[int]:
        todo, out = [top], []
        while todo:
            x = todo.pop()
            if kids[x] is None:
                out.append(x)
            else:
                todo += kids[x]
        return out

    # Clusters from the top: a split into two large parts ends one and begins two, small parts fall out.
    density = lambda w: np.inf if w == 0 else 1 / w
    born, parent, stability, fallen = [0.0], [-1], [0.0], [[]]
    todo = [(len(size) - 1, 0)]
    while todo:
        x, c = todo.pop()
        if kids[x] is None:
            fallen[c].append(x)
            continue
        at = density(height[x])
        gain = 0.0 if at == born[c] else at - born[c]
        big = [k for k in kids[x] if size[k] >= min_size]
        if len(big) == 2:
            for k in kids[x]:
                stability[c] += gain * size[k]
                born.append(at)
                parent.append(c)
                stability.append(0.0)
                fallen.append([])
                todo.append((k, len(born) - 1))
            continue
        for k in kids[x]:
            if size[k] < min_size:
                stability[c] += gain * size[k]
                fallen[c] += points(k)
            else:
                todo.append((k, c))
    chosen, below = [True] * len(born), [0.0] * len(born)
    for c in range(len(born) - 1, 0, -1):
        if below[c] > stability[c]:
            chosen[c], stability[c] = False, below[c]
        below[parent[c]] += stability[c]
    chosen[0] = False
    inside, number = [-1] * len(born), 0
    for c in range(1, len(born)):
        inside[c] = inside[parent[c]]
        if inside[c] < 0 and chosen[c]:
            inside[c], number = number, number + 1
        labels[fallen[c]] = inside[c]
    return labels


def _edges(batch: pa.RecordBatch) -> np.ndarray:
    out = np.zeros(batch.num_rows, dtype=[("w", float), ("a", np.int64), ("b", np.int64)])
    for i, n in enumerate(("w", "a", "b")):
        out[n] = batch.column(batch.schema.get_field_index(n)).to_numpy()
    return out


def _edge_batch(e: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(e[n])) for n in ("w", "a", "b")], ["w", "a", "b"])


def _pairs(points: DataFrame, n: int) -> DataFrame:
    """Each pair of blocks of ``id, vec`` (and more) as one row with the rows of both."""
    b = points.groupBy(F.expr(f"id div {BLOCK}").alias("b")).agg(F.collect_list(F.struct(*points.columns)).alias("x"))
    last = (n - 1) // BLOCK
    b = b.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(last))))
    return b.groupBy(F.least("b", "o").alias("lo"), F.greatest("b", "o").alias("hi")).agg(F.flatten(F.collect_list("x")).alias("x"))


def _opened(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple]:
    for batch in batches:
        x = batch.column(batch.schema.get_field_index("x"))
        same = [a == b for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
        for i, alone in enumerate(same):
            v = x[i].values
            got = [v.field(n).to_numpy() for n in names]
            vec = v.field("vec").flatten().to_numpy().reshape(len(got[0]), -1)
            yield alone, vec, *got


def core_distances(points: DataFrame, n: int, k: int) -> DataFrame:
    """``id, core``: distance of each of ``n`` points to its ``k``-th neighbour (the last one, if there are fewer)."""
    def near(batches):
        for alone, vec, ids in _opened(batches, ["id"]):
            d = distances(vec, vec)
            block = ids // BLOCK
            # In a pair of two blocks only what lies between them is new.
            d[(block[:, None] == block) if not alone else np.eye(len(ids), dtype=bool)] = np.inf
            d.sort(axis=1)
            d = d[:, :k]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([r[np.isfinite(r)] for r in d], pa.list_(pa.float64()))], ["id", "d"])

    few = _pairs(points.select("id", "vec"), n).mapInArrow(near, "id long, d array<double>")
    least = F.slice(F.array_sort(F.flatten(F.collect_list("d"))), 1, k)
    return few.groupBy("id").agg(least.alias("d")).select("id", F.coalesce(F.try_element_at("d", F.lit(-1)), F.lit(0.0)).alias("core"))


def density_clusters(tiles: DataFrame, min_size: int, min_samples: int | None = None, out: str = "cluster") -> DataFrame:
    """``tile_key`` and its cluster, from 0 (-1: noise). ``tiles``: ``tile_key, vec``, a vector per tile.

    Ties of distance are decided by the tiles' places in seeded order, so results repeat. A single
    cluster over everything does not count as one. More than ``MOST`` tiles are an error.
    """
    n = tiles.count()
    if n > MOST:
        raise ValueError(f"{n} tiles; at most {MOST} can be clustered by density")
    k = max(1, min_samples or min_size)
    points = global_rank(tiles.select("tile_key", "vec"), F.md5("tile_key"), "id").withColumn("id", F.col("id") - 1)
    if not n:
        return points.select("tile_key", F.lit(-1).cast("long").alias(out))
    with_core = points.select("id", "vec").join(core_distances(points, n, k), "id")

    def trees(batches):
        for _, vec, ids, core in _opened(batches, ["id", "core"]):
            if len(ids) > 1:
                yield _edge_batch(spanning_tree(np.maximum(distances(vec, vec), np.maximum(core[:, None], core)), ids))

    edges = _pairs(with_core.select("id", "vec", "core"), n).mapInArrow(trees, EDGE)
    blocks = -(-n // BLOCK)
    total = blocks * (blocks + 1) // 2 * 2 * BLOCK
    while total > 8 * n:
        # A group's forest has fewer edges than tiles, so groups of 8 n edges shrink to n.
        groups = -(-total // (8 * n))
        edges = edges.repartition(groups, F.xxhash64("a", "b")).mapInArrow(_shrunk, EDGE)
        total = groups * n

    def label(batches):
        held = [_edges(b) for b in batches]
        found = stable_clusters(forest(np.concatenate(held)), n, min_size) if held else np.full(n, -1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(found, pa.int64())], ["id", out])

    return edges.repartition(1).mapInArrow(label, f"id long, {out} long").join(points.select("id", "tile_key"), "id").select("tile_key", out)


def _shrunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [_edges(b) for b in batches]
    if held:
        yield _edge_batch(forest(np.concatenate(held)))
