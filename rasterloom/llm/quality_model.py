"""Quality classifier: a generalised additive model with pairwise interactions.

Numeric features of the whole text are cut into bins at quantiles of the labelled
sample. Cyclic boosting visits the features in turn and fits a shallow tree of one
feature (then of the pairs that still explain most) to the residual; each tree is
added to the feature's look-up table. Scoring is a vectorised sum of table entries.

The model is fitted on the driver from a sample bounded by ``SAMPLE`` labelled rows,
chosen by hash; features are computed and texts are scored in Spark tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .minhash import _SPACE, _as_bytes, _chunks, shingle_sets

SAMPLE = 8192  # labelled rows that fit a model, at most
BINS = 24
ROUNDS = 120
PAIRS = 6
RATE = 0.15

FEATURES = ["words", "word_bytes", "upper", "digit", "symbol", "exclaim", "pipe", "punctuation", "other_bytes",
            "distinct_words", "distinct_pairs", "line_words", "distinct_lines"]
_CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "symbol": b"#*$%&<>@^~_=+\\/{}[]", "exclaim": b"!",
            "pipe": b"|", "punctuation": b".,;:?'\"()-"}
_CLASS = np.zeros((len(_CLASSES) + 2, 256), np.uint8)
for _i, _set in enumerate(_CLASSES.values()):
    _CLASS[_i, list(_set)] = 1
_CLASS[-2, 128:] = 1
_CLASS[-1] = ~_SPACE


def features(texts: list[bytes]) -> np.ndarray:
    """One row of ``FEATURES`` per text; zeros for a text without words."""
    out = np.zeros((len(texts), len(FEATURES)))
    for at, part in _chunks(texts):
        buf = np.frombuffer(b" ".join(part) + b" ", np.uint8)
        start = np.cumsum([0, *(len(t) + 1 for t in part)])[:-1]
        sums = np.stack([np.add.reduceat(c[buf], start, dtype=np.int64) for c in _CLASS], 1).astype(float)
        ink = np.maximum(sums[:, -1], 1)
        word = ~_SPACE[buf]
        heads = word & ~np.concatenate([[False], word[:-1]])
        words = np.add.reduceat(heads, start, dtype=np.int64).astype(float)
        one, two = shingle_sets(part, 1), shingle_sets(part, 2)
        for i, t in enumerate(part):
            n = words[i]
            if not n:
                continue
            lines = [x for x in t.split(b"\n") if x.strip()]
            out[at + i] = [np.log2(n), ink[i] / n, *(sums[i, :-1] / ink[i]),
                           len(one[i]) / n, len(two[i]) / max(n - 1, 1), np.log2(n / max(len(lines), 1)), len(set(lines)) / max(len(lines), 1)]
    return out


class Additive:
    """Look-up tables: one per feature, one per chosen pair of features."""

    def __init__(self, base: float, cuts: list[np.ndarray], single: np.ndarray, pairs: list[tuple[int, int, np.ndarray]]):
        self.base, self.cuts, self.single, self.pairs = base, cuts, single, pairs

    def score(self, x: np.ndarray) -> np.ndarray:
        b = np.stack([np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(self.cuts)], 1) if len(x) else np.zeros((0, len(self.cuts)), int)
        z = np.full(len(x), self.base)
        for j in range(b.shape[1]):
            z += self.single[j, b[:, j]]
        for i, j, t in self.pairs:
            z += t[b[:, i], b[:, j]]
        return 1 / (1 + np.exp(-z))


def _tree(g: np.ndarray, h: np.ndarray, leaves: int = 3) -> np.ndarray:
    """Step of each bin: a tree of few leaves on ordered bins, grown by best gain."""
    parts, lam = [(0, len(g))], 1.0
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    worth = lambda lo, hi: (cg[hi] - cg[lo]) ** 2 / (ch[hi] - ch[lo] + lam)
    for _ in range(leaves - 1):
        best = max(((worth(lo, m) + worth(m, hi) - worth(lo, hi), lo, m, hi) for lo, hi in parts for m in range(lo + 1, hi)), default=(0,))
        if best[0] <= 1e-9:
            break
        _, lo, m, hi = best
        parts.remove((lo, hi))
        parts += [(lo, m), (m, hi)]
    out = np.zeros(len(g))
    for lo, hi in parts:
        out[lo:hi] = (cg[hi] - cg[lo]) / (ch[hi] - ch[lo] + lam)
    return out


def _square(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """Step of each cell of a pair: the best cut of one feature, then one of the other on each side; its gain."""
    lam = 1.0
    best, step = 0.0, np.zeros_like(g)
    for flip in (False, True):
        a, b = (g.T, h.T) if flip else (g, h)
        ca, cb = a.cumsum(0).cumsum(1), b.cumsum(0).cumsum(1)
        total = ca[-1, -1] ** 2 / (cb[-1, -1] + lam)
        for m in range(len(a) - 1):
            gain, cells = -total, []
            for lo_a, lo_b, rows in ((ca[m], cb[m], slice(0, m + 1)), (ca[-1] - ca[m], cb[-1] - cb[m], slice(m + 1, None))):
                w = lo_a[:-1] ** 2 / (lo_b[:-1] + lam) + (lo_a[-1] - lo_a[:-1]) ** 2 / (lo_b[-1] - lo_b[:-1] + lam)
                k = int(w.argmax())
                gain += w[k]
                cells.append((rows, k, lo_a[k] / (lo_b[k] + lam), (lo_a[-1] - lo_a[k]) / (lo_b[-1] - lo_b[k] + lam)))
            if gain > best:
                best, s = gain, np.zeros_like(a)
                for rows, k, left, right in cells:
                    s[rows, :k + 1], s[rows, k + 1:] = left, right
                step = s.T if flip else s
    return step, best


def fit(x: np.ndarray, y: np.ndarray) -> Additive:
    """Fits the tables to labels 0 and 1; without both labels, a constant."""
    k = x.shape[1]
    if not len(y) or y.min() == y.max():
        rate = y.mean() if len(y) else 0.5
        return Additive(float(np.log((rate + 0.01) / (1.01 - rate))), [np.empty(0)] * k, np.zeros((k, 1)), [])
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(k)]
    b = np.stack([np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(cuts)], 1)
    base = float(np.log(y.mean() / (1 - y.mean())))
    single, z = np.zeros((k, BINS)), np.full(len(y), base)

    def grad():
        p = 1 / (1 + np.exp(-z))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(ROUNDS):
        for j in range(k):
            g, h = grad()
            n = len(cuts[j]) + 1
            step = RATE * _tree(np.bincount(b[:, j], g, n), np.bincount(b[:, j], h, n))
            single[j, :n] += step
            z += step[b[:, j]]
    g, h = grad()

    def cells(i, j, v):
        return np.bincount(b[:, i] * BINS + b[:, j], v, BINS * BINS).reshape(BINS, BINS)

    ranked = sorted(((_square(cells(i, j, g), cells(i, j, h))[1], i, j) for i in range(k) for j in range(i + 1, k)), reverse=True)
    pairs = [(i, j, np.zeros((BINS, BINS))) for _, i, j in ranked[:PAIRS]]
    for _ in range(ROUNDS // 6):
        for i, j, table in pairs:
            g, h = grad()
            step = RATE * _square(cells(i, j, g), cells(i, j, h))[0]
            table += step
            z += step[b[:, i], b[:, j]]
    return Additive(base, cuts, single, pairs)


def held_out(doc_id: Column) -> Column:
    """Rows that never teach: crc32 of the id's text divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Additive:
    """Model from the labelled documents that are not held out, ``sample`` of them at most, by hash."""
    chosen = (labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
              .groupBy("doc_id").agg(F.max("quality").alias("quality"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    # Ids are compared as they are; only where the tables' types differ, as text.
    same = dict(docs.dtypes)["doc_id"] == dict(chosen.dtypes)["doc_id"]
    key = lambda c: c if same else c.cast("string")
    rows = docs.select(key(F.col("doc_id")).alias("doc_id"), F.col("text").cast("string")).join(F.broadcast(chosen.withColumn("doc_id", key(F.col("doc_id")))), "doc_id")  # at most `sample` rows
    kind = dict(rows.dtypes)["doc_id"]

    def run(batches):
        for b in batches:
            x = features(_as_bytes(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array(x.tolist(), pa.list_(pa.float64()))], ["doc_id", "quality", "dig", "x"])

    dig = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    got = rows.select("doc_id", "text", F.col("quality").cast("int"), dig.alias("dig")).mapInArrow(run, f"doc_id {kind}, quality int, dig string, x array<double>")
    # Of the texts of one id the one with the smallest digest teaches.
    got = got.groupBy("doc_id").agg(F.min_by(F.struct("quality", "x"), "dig").alias("r")).select("doc_id", "r.quality", "r.x")
    got = sorted((r[0], r[1], r[2]) for r in got.collect())
    x = np.array([r[2] for r in got]).reshape(len(got), len(FEATURES))
    return fit(x, np.array([r[1] for r in got], float))


def _scored(docs: DataFrame, model: Additive) -> DataFrame:
    """Adds ``__score`` to ``doc_id``-less rows: a struct column ``__row`` and ``text``."""

    def run(batches):
        for b in batches:
            texts = _as_bytes(b.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(model.score(features(texts))), b.column(1)], ["score", "row"])

    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("row", docs.schema["row"].dataType)])
    return docs.select("text", "row").mapInArrow(run, schema)


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted``.

    Null and blank texts are scored, by zero features, and texts of any length as a
    whole. Labels may repeat, miss
    documents or be null; without labels of both kinds every score is one constant.
    doc_id is passed through, null or repeated; other columns are ignored; an empty
    table gives an empty result.
    """
    model = learn(docs, labels, sample)
    rows = docs.select(F.col("text").cast("string").alias("text"), F.struct(F.col("doc_id").alias("doc_id")).alias("row"))
    s = _scored(rows, model)
    return s.select("row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "score",
                    F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def keep_good(docs: DataFrame, model: Additive, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, with their own columns."""
    rows = docs.select(F.col("text").cast("string").alias("text"), F.struct("*").alias("row"))
    return _scored(rows, model).where(F.col("score") >= threshold).select("row.*")
