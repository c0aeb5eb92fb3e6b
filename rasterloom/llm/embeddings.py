"""Embedding near-deduplication by product quantisation.

A coarse k-means and, for residuals, one codebook per subspace are fitted on a bounded
sample; then every vector is indexed. Beyond ``LISTS`` lists a second coarse level of
residual centroids divides each list, so lists grow with the table.

A vector goes to each list that can hold a point within half the link distance: such a
point lies at most that far behind the plane between the two centroids. The midpoint of
two linked vectors is that near to both, so they meet in its list, at least; a pair
counts in the first list that both are in. In a list, asymmetric distances are sums of
table look-ups; a member stays a candidate while its look-up distance is within the link
distance plus the error of its codes (the triangle inequality), so neither step can lose
a link. Exact cosine in double precision decides.

Each vector is sent once to each of its lists. Lists longer than ``BLOCK`` are compared
a block against a block at a time, so no task holds a whole list. A block returns a
count per vector and one edge per linked vector to the smallest one it reaches there,
never its pairs. Equal vectors of a label collapse to one with a weight beforehand.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, attach, connected_components, with_ids, with_numbers

SAMPLE = 16_384  # vectors that fit the quantisers, at most
PER_LIST = 512  # vectors of a list, on average, over all labels
LISTS = 1024  # lists of one level, at most
SUBSPACES = 8
CODES = 64
BLOCK = 1024
TILE = 1024  # members of a block that a task compares at a time: a million pairs
STEPS = 8


def _kmeans(x: np.ndarray, k: int) -> np.ndarray:
    """Centroids of Lloyd's algorithm from a fixed start."""
    k = min(k, len(x))
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(STEPS):
        of = _nearest(x, c)
        n = np.bincount(of, minlength=k)
        s = np.zeros_like(c)
        np.add.at(s, of, x)
        c = np.where(n[:, None] > 0, s / np.maximum(n, 1)[:, None], c)
    return c


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c * c).sum(1) - 2 * x @ c.T).argmin(1)


def _within(x: np.ndarray, c: np.ndarray, far: float) -> np.ndarray:
    """Matrix of booleans: whether the cell of each centroid can hold a point within ``far`` of x."""
    d2 = (x * x).sum(1)[:, None] + (c * c).sum(1) - 2 * x @ c.T
    own = d2.argmin(1)
    apart = np.sqrt(np.maximum((c * c).sum(1)[own][:, None] + (c * c).sum(1) - 2 * c[own] @ c.T, 1e-30))
    hit = (d2 - d2[np.arange(len(x)), own][:, None]) / (2 * apart) <= far + 1e-7
    hit[np.arange(len(x)), own] = True
    return hit


class Quantiser:
    """Coarse centroids on one or two levels and residual codebooks of one vector length."""

    def __init__(self, sample: np.ndarray, lists: int):
        most = min(LISTS, max(1, len(sample) // 16))
        self.coarse = _kmeans(sample, min(lists, most))
        rest = sample - self.coarse[_nearest(sample, self.coarse)]
        # The second level has the lists that the first may not: its centroids serve all lists.
        inner = min(-(-lists // len(self.coarse)), most)
        self.inner = _kmeans(rest, inner) if inner > 1 else np.zeros((1, sample.shape[1]))
        rest = rest - self.inner[_nearest(rest, self.inner)]
        self.parts = np.array_split(np.arange(sample.shape[1]), min(SUBSPACES, sample.shape[1]))
        self.books = [_kmeans(rest[:, p], CODES) for p in self.parts]

    def centroid(self, which: np.ndarray) -> np.ndarray:
        return self.coarse[which // len(self.inner)] + self.inner[which % len(self.inner)]

    def lists(self, x: np.ndarray, far: float) -> tuple[np.ndarray, np.ndarray]:
        """Rows of x and the lists that can hold a point within ``far`` of them, by row and list."""
        row, outer = np.nonzero(_within(x, self.coarse, far))
        if len(self.inner) == 1:
            return row, outer
        at, inner = np.nonzero(_within(x[row] - self.coarse[outer], self.inner, far))
        return row[at], outer[at] * len(self.inner) + inner

    def codes(self, x: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Residual codes of x in lists ``which``, and the error that they leave."""
        rest = x - self.centroid(which)
        codes = np.stack([_nearest(rest[:, p], b) for p, b in zip(self.parts, self.books)], 1)
        left = sum(((rest[:, p] - b[codes[:, m]]) ** 2).sum(1) for m, (p, b) in enumerate(zip(self.parts, self.books)))
        return codes.astype(np.uint8), np.sqrt(left)

    def distances(self, q: np.ndarray, which: int, codes: np.ndarray) -> np.ndarray:
        """Squared look-up distances of queries to members of list ``which``."""
        rest = q - self.centroid(np.array([which]))
        out = np.zeros((len(q), len(codes)))
        for m, (p, b) in enumerate(zip(self.parts, self.books)):
            r = rest[:, p]
            table = (r * r).sum(1)[:, None] + (b * b).sum(1) - 2 * r @ b.T
            out += table[:, codes[:, m]]
        return out


def _matrices(col: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of each length, and their vectors as a matrix; null components are NaN."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    start, length = col.offsets.to_numpy(), col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = col.values.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    for d in np.unique(length[length > 0]):
        at = np.flatnonzero(length == d)
        yield at, flat[start[at][:, None] + np.arange(d)]


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1))[:, None]


def fit(rows: DataFrame, lists: int, sample: int = SAMPLE) -> dict[int, Quantiser]:
    """A quantiser for each vector length, from at most ``sample`` vectors chosen by hash."""
    got = rows.orderBy(F.xxhash64("vec_id", "rid"), "rid").limit(sample).select("v").toArrow()
    return {x.shape[1]: Quantiser(_unit(x), lists) for _, x in _matrices(got["v"])} if got.num_rows else {}


def _components(n: int, a: np.ndarray, b: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Smallest id that each of n nodes reaches over edges a-b."""
    low = ids.copy()
    while len(a):
        m = np.minimum(low[a], low[b])
        nxt = low.copy()
        np.minimum.at(nxt, a, m)
        np.minimum.at(nxt, b, m)
        if (nxt == low).all():
            break
        low = nxt
    return low


_ROW = "vec_id long, label string, digest binary, v array<double>"
_MEMBER = "rid long, label string, vec_id long, w long, v array<double>, dim int, list int, lists array<int>, codes binary, err double"


def near_duplicates(vectors: DataFrame, cosine: float = 0.98, sample: int = SAMPLE, scratch: Scratch | None = None) -> DataFrame:
    """One row per vector: ``vec_id, n_links, component_id, kept``.

    Two vectors link if their labels are equal and not null and their cosine is at
    least ``cosine``. Vectors that are null, empty, zero, or hold null or non-finite
    components link with nothing, nor do those of different lengths, of a null label or
    with a null vec_id. Each row is a vector: a repeated row links with its repeats. Ids may be of
    any type that sorts; vectors of any length count with all their components.
    Other columns are ignored; an empty table gives an empty result.
    """
    scratch = scratch or Scratch(vectors.sparkSession)
    vectors, names = with_numbers(vectors.select("vec_id", "embedding", "label"), "vec_id", scratch)
    far = float(np.sqrt(2 - 2 * cosine))

    def prepare(batches):
        for b in batches:
            digest: list[bytes | None] = [None] * b.num_rows
            v: list[np.ndarray | None] = [None] * b.num_rows
            known = np.array(b.column(0).is_valid()) & np.array(b.column(2).is_valid())
            for at, x in _matrices(b.column(1)):
                most = np.abs(x).max(1)
                ok = np.isfinite(most) & (most > 0) & known[at]
                # By a power of two, which changes no cosine, so that no square over- or underflows.
                x = np.ldexp(x[ok] + 0.0, -np.frexp(most[ok])[1][:, None])
                for i, y, size in zip(at[ok], x, np.frexp(most[ok])[1]):
                    digest[i], v[i] = hashlib.blake2b(y.tobytes() + int(size).to_bytes(4, "little", signed=True), digest_size=16).digest(), y
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(digest, pa.binary()), pa.array(v, pa.list_(pa.float64()))],
                                             ["vec_id", "label", "digest", "v"])

    rows = scratch.keep(vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"), F.col("label").cast("string"))
                        .mapInArrow(prepare, _ROW), rows=F.count(F.lit(1)))
    # Equal vectors of a label have equal digests; a label is part of the group's one key.
    ids = rows.select("vec_id", "label", "v", F.when(F.col("digest").isNotNull(), F.concat("digest", F.col("label").cast("binary"))).alias("same"))
    same = ids.where("same is not null").groupBy("same").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("w"), F.min("label").alias("label"), F.first("v").alias("v"))
    same = scratch.keep(same.withColumn("rid", F.monotonically_increasing_id()), rows=F.count(F.lit(1)))
    quantisers = fit(same, max(16, same.seen["rows"] // PER_LIST), sample)
    spark_bc = vectors.sparkSession.sparkContext.broadcast(quantisers)  # at most 2 * LISTS centroids and the codebooks

    def index(batches):
        for b in batches:
            for at, x in _matrices(b.column(4)):
                x, q = _unit(x), spark_bc.value.get(x.shape[1])
                if q is None:  # a length that the sample lacks: one list, compared in full
                    row, which = np.arange(len(x)), np.zeros(len(x), np.int64)
                    codes, err = [b""] * len(x), np.zeros(len(x))
                else:
                    row, which = q.lists(x, far / 2)
                    code, err = q.codes(x[row], which)
                    codes = [c.tobytes() for c in code]
                all_ = pa.ListArray.from_arrays(np.searchsorted(row, np.arange(len(x) + 1)).astype(np.int32), pa.array(which, pa.int32()))
                own = b.take(pa.array(at[row]))
                yield pa.RecordBatch.from_arrays(
                    [*own.columns, pa.array(np.full(len(row), x.shape[1]), pa.int32()), pa.array(which, pa.int32()), all_.take(pa.array(row)),
                     pa.array(codes, pa.binary()), pa.array(err)], [c.split()[0] for c in _MEMBER.split(", ")])

    indexed = scratch.keep(same.select("rid", "label", "vec_id", "w", "v").mapInArrow(index, _MEMBER).withColumn("cell", F.struct("label", "dim", "list")),
                           rows=F.count(F.lit(1)))
    sizes = indexed.groupBy("cell").agg(F.count("*").alias("c")).where("c > 1")
    block = F.greatest(F.lit(float(BLOCK)), 4 * F.sqrt("c"))
    sizes = scratch.keep(sizes.withColumn("blocks", F.ceil(F.col("c") / block).cast("int")))
    met = attach(indexed, sizes, "cell", indexed.seen["rows"]).withColumn("own", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("cell", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "rid", "vec_id", "w", "v", "lists", "codes", "err")

    def compare(t: pa.Table) -> pa.Table:
        cell, lo, hi = t["cell"][0].as_py(), t["lo"][0].as_py(), t["hi"][0].as_py()
        ids, w, rid = (t[c].to_numpy() for c in ("vec_id", "w", "rid"))
        v = next(_matrices(t["v"]))[1]
        own = t["own"].to_numpy()
        qi = np.flatnonzero(own == lo)
        mi = np.flatnonzero(own == hi)
        links, low = np.zeros(len(v), np.int64), ids.copy()
        if len(v) > 1 and len(mi) and len(qi):
            u, q = _unit(v), spark_bc.value.get(cell["dim"])
            codes = None if q is None else np.frombuffer(b"".join(t["codes"].to_pylist()), np.uint8).reshape(len(v), -1)
            err, norm, earlier = t["err"].to_numpy(), np.sqrt((v * v).sum(1)), _earlier(t["lists"], cell["list"])
            first, root = np.zeros(0, np.int64), np.zeros(0, np.int64)
            # Some members against some others at a time, however large the block is.
            for i, j in ((i, j) for i in range(0, len(qi), TILE) for j in range(0, len(mi), TILE)):
                x, y = qi[i:i + TILE], mi[j:j + TILE]
                near = np.ones((len(x), len(y)), bool) if q is None else q.distances(u[x], cell["list"], codes[y]) <= (far + err[y] + 1e-6) ** 2
                if lo == hi:
                    near &= x[:, None] < y
                a, b = np.nonzero(near)
                a, b = x[a], y[b]
                keep = np.zeros(len(a), bool)
                for at in range(0, len(a), 1 << 16):
                    x, y = a[at:at + (1 << 16)], b[at:at + (1 << 16)]
                    yes = np.einsum("ij,ij->i", v[x], v[y]) / (norm[x] * norm[y]) >= cosine
                    yes[yes] = ~(earlier[x[yes]] & earlier[y[yes]]).any(1)
                    keep[at:at + (1 << 16)] = yes
                a, b = a[keep], b[keep]
                np.add.at(links, a, w[b])
                np.add.at(links, b, w[a])
                # Of the links so far one to each component's first member is enough.
                root = _components(len(v), np.concatenate((first, a)), np.concatenate((root, b)), np.arange(len(v)))
                first = np.arange(len(v))
            if len(first):
                low = ids.copy()
                np.minimum.at(low, root, ids)
                low = low[root]
        out = links > 0
        return pa.table({"rid": rid[out], "vec_id": ids[out], "links": links[out], "low": low[out]})

    found = scratch.keep(met.groupBy("cell", "lo", "hi").applyInArrow(compare, "rid long, vec_id long, links long, low long"))
    scratch.drop(indexed, sizes)
    comp = connected_components(found.where("vec_id <> low").select(F.col("vec_id").alias("a"), F.col("low").alias("b")), scratch)
    counts = found.groupBy("rid").agg(F.sum("links").alias("links"))
    per = same.select("rid", "same", F.col("vec_id").alias("node"), F.col("w").alias("c")).join(counts, "rid", "left").join(comp, "node", "left")
    per = per.where("c > 1 or links is not null or component is not null").select(
        "same", "c", (F.coalesce("links", F.lit(0)) + F.col("c") - 1).alias("n_links"), F.coalesce("component", "node").alias("component"))
    found = (attach(ids.drop("label", "v"), per, "same", rows.seen["rows"], "left")
             .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
             .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))))
    return with_ids(found, ["vec_id", "component_id"], names, scratch)


def _earlier(lists: pa.ChunkedArray, which: int) -> np.ndarray:
    """For each row, bits of the lists before ``which`` that it is in."""
    col = lists.combine_chunks()
    row = np.repeat(np.arange(len(col)), col.value_lengths().to_numpy())
    of = col.flatten().to_numpy()
    row, of = row[of < which], of[of < which]
    seen, at = np.unique(of, return_inverse=True)
    bits = np.zeros((len(col), len(seen)), bool)
    bits[row, at] = True
    return np.packbits(bits, axis=1) if len(seen) else np.zeros((len(col), 1), np.uint8)


#: DuckDB twin: all pairs of a label.
SQL = """
WITH RECURSIVE e AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = vec_id) AS n_links,
  least(vec_id, coalesce((SELECT min(b) FROM r WHERE r.a = vec_id), vec_id)) AS component_id,
  vec_id <= coalesce((SELECT min(b) FROM r WHERE r.a = vec_id), vec_id) AS kept
FROM embeddings
"""
