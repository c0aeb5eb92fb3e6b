"""Packing token sequences by non-negative least squares over length combinations.

Documents are tokenised and cut into full windows and one remainder. Remainders are
counted in units of ``window / UNITS`` tokens (rounded up). The histogram of units is
matched by combinations of up to ``DEPTH`` lengths that fill a window exactly: a
non-negative least-squares problem over at most a few thousand shallow combinations
gives how often to repeat each, rounding down keeps every count within the
histogram, and what remains is packed greedily, longest first into the fullest
window that still takes it. The histogram and the plan have a fixed size, whatever
the corpus; pieces find their sequence by their rank within their unit length.
"""

from __future__ import annotations

import os
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, fan_out, prefix_offsets
from .pieces import CACHE, chunks

UNITS = 128
SALTS = 64  # buckets, at least, that equal pieces are spread over
DEPTH = 3


class Encoder:
    """Ids of texts by the ``tokenizers`` library, which encodes each distinct piece once."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self._clear()

    def _clear(self) -> None:
        self.row: dict[int, int] = {}
        self.flat = np.empty(1 << 16, np.uint32)
        self.at = np.zeros(1 << 15, np.int64)  # where the ids of row i start; at[i + 1]: where they end

    def encode(self, texts: list[str], rule: str = "spaced") -> list[np.ndarray]:
        parts: list[list[np.ndarray]] = [[] for _ in texts]
        for c in chunks(texts, rule, self.specials):
            keys, first, of = np.unique(c.key, return_index=True, return_inverse=True)
            if len(self.row) > CACHE:
                self._clear()
            new = [i for i, k in enumerate(keys.tolist()) if k not in self.row]
            self._learn([c.piece(int(first[i])) for i in new], keys[new].tolist())
            rows = np.fromiter(map(self.row.__getitem__, keys.tolist()), np.int64, len(keys))[of]
            start, n = self.at[rows], self.at[rows + 1] - self.at[rows]
            stop = np.cumsum(n)
            ids = self.flat[np.repeat(start - stop + n, n) + np.arange(stop[-1] if len(stop) else 0)]
            cuts = np.flatnonzero(np.diff(c.owner, prepend=-1, append=-1))
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                parts[int(c.owner[lo])].append(ids[stop[lo] - n[lo]:stop[hi - 1]])
        return [np.concatenate(p) if p else np.empty(0, np.uint32) for p in parts]

    def _learn(self, pieces: list[str], keys: list[int]) -> None:
        for lo in range(0, len(pieces), 4096):
            got = [e.ids for e in self.tok.encode_batch_fast(pieces[lo:lo + 4096], add_special_tokens=False)]
            r, n = len(self.row), len(got)
            ends = np.cumsum(np.fromiter(map(len, got), np.int64, n)) + self.at[r]
            while r + n + 1 > len(self.at):
                self.at = np.concatenate([self.at, np.zeros_like(self.at)])
            while ends[-1] > len(self.flat):
                self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
            self.flat[self.at[r]:ends[-1]] = np.fromiter(chain.from_iterable(got), np.uint32)
            self.at[r + 1:r + n + 1] = ends
            self.row.update(zip(keys[lo:lo + 4096], range(r, r + n)))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each vocabulary file and worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


_PIECES = "start long, length long, ids_crc32 long, doc_tokens long"


def token_pieces(docs: DataFrame, path: str, window: int = 1024, end_id: int = 0) -> DataFrame:
    """Every document's ids with ``end_id`` after them, cut into windows and a remainder."""

    def run(batches):
        enc = encoder(path)
        for b in batches:
            rows: list[tuple] = []
            for lo in range(0, b.num_rows, 64):
                texts = [x or "" for x in b.column(1).slice(lo, 64).to_pylist()]
                for d, x in enumerate(enc.encode(texts), lo):
                    raw = np.append(x, np.uint32(end_id)).astype("<u4").tobytes()
                    n = len(raw) // 4
                    rows += [(d, s, min(window, n - s), zlib.crc32(raw[4 * s:4 * (s + window)]), n) for s in range(0, n, window)]
            own, *rest = [pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 5
            yield pa.RecordBatch.from_arrays([b.column(0).take(own), *rest], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, {_PIECES}")


def combinations(units: int, depth: int) -> list[tuple[int, ...]]:
    """Descending lengths, at most ``depth`` of them, that add up to ``units``."""
    out: list[tuple[int, ...]] = []

    def grow(part: tuple[int, ...], left: int) -> None:
        most = min(left, part[-1] if part else left)
        if most == left:
            out.append((*part, left))
        if len(part) + 1 < depth:
            for x in range(min(most, left - 1), 0, -1):
                if x * (depth - len(part)) < left:
                    break
                grow((*part, x), left - x)

    grow((), units)
    return out


def nnls(a: np.ndarray, b: np.ndarray, steps: int = 400) -> np.ndarray:
    """Minimises |a x - b| over x >= 0 by accelerated projected gradient descent."""
    rate = 1.0 / max(np.linalg.norm(a, 2) ** 2, 1e-12)
    x = y = np.zeros(a.shape[1])
    t = 1.0
    for _ in range(steps):
        nxt = np.maximum(y - rate * (a.T @ (a @ y - b)), 0.0)
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = nxt + (t - 1) / t2 * (nxt - x)
        x, t = nxt, t2
    return x


def plan(histogram: np.ndarray, depth: int = DEPTH) -> list[tuple[tuple[int, ...], int]]:
    """Combinations and how often each is used; together they use up the histogram exactly.

    ``histogram[u]``: pieces of ``u`` units, u from 1 to the window's units.
    """
    left = histogram.astype(np.int64).copy()
    units = len(left) - 1
    out: list[tuple[tuple[int, ...], int]] = []
    if left.sum():
        combos = combinations(units, depth)
        a = np.zeros((units, len(combos)))
        for j, c in enumerate(combos):
            for u in c:
                a[u - 1, j] += 1
        scale = float(left.max())
        x = nnls(a, left[1:] / scale) * scale
        for j in np.argsort(-x, kind="stable"):
            # Rounded to whole repeats, never more than the histogram still holds.
            need = {u: combos[j].count(u) for u in set(combos[j])}
            n = min(int(x[j] + 0.5), *(int(left[u]) // k for u, k in need.items()))
            if n > 0:
                out.append((combos[j], n))
                for u, k in need.items():
                    left[u] -= n * k
    while left.any():  # longest first; each further piece the longest that fits
        room, part, held = units, [], left.copy()
        while room and held[1:room + 1].any():
            u = int(np.flatnonzero(held[:room + 1])[-1])
            part.append(u)
            held[u] -= 1
            room -= u
        need = {u: part.count(u) for u in set(part)}
        n = min(int(left[u]) // k for u, k in need.items())
        out.append((tuple(part), n))
        for u, k in need.items():
            left[u] -= n * k
    return out


def pack(docs: DataFrame, path: str, window: int = 1024, end_id: int = 0, scratch: Scratch | None = None) -> DataFrame:
    """Packs all documents into sequences of at most ``window`` tokens.

    Returns one row per piece: ``doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset``. Null and empty texts hold the end id alone; texts of any length
    are cut into as many windows as they need; doc_id is passed through, null or repeated
    (each row is packed by itself), of any type; other columns are
    ignored; an empty table gives no pieces.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    per_unit = -(-window // UNITS)
    made = scratch.keep(token_pieces(docs, path, window, end_id)
                        .withColumn("unit", F.ceil(F.col("length") / per_unit).cast("int"))
                        # Written with the pieces, so it does not change; it spreads what is alike.
                        .withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")))
    counts = {r[0]: r[1] for r in made.groupBy("unit").count().collect()}  # at most UNITS rows
    buckets = fan_out(sum(counts.values()))
    histogram = np.zeros(UNITS + 1, np.int64)
    for u, n in counts.items():
        histogram[u] = n
    # For each unit length: ranks from `first` on sit in sequences from `seq` on, `times` in each.
    first: dict[int, list[int]] = {u: [] for u in counts}
    where: dict[int, list[tuple[int, int, int]]] = {u: [] for u in counts}
    used, seq = dict.fromkeys(counts, 0), 0
    for combo, n in plan(histogram):
        place = 0
        for u in sorted(set(combo), reverse=True):
            times = combo.count(u)
            first[u].append(used[u])
            where[u].append((seq, times, place))
            used[u] += n * times
            place += times
        seq += n

    spread = made.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "salt"), F.lit(buckets)).cast("int"))
    sums = spread.groupBy("unit", "bucket").agg(F.count("*").alias("n"))
    offs = prefix_offsets(sums, ["unit"], "bucket", "n", "before").select("unit", "bucket", "before")
    rank = F.row_number().over(Window.partitionBy("unit", "bucket").orderBy("doc_id", "start", "ids_crc32")) - 1
    ranked = spread.withColumn("in_bucket", rank).join(offs, ["unit", "bucket"]).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "unit", (F.col("before") + F.col("in_bucket")).alias("rank"))

    runs = {u: (np.array(first[u], np.int64), np.array(where[u], np.int64).reshape(-1, 3)) for u in counts}

    def place_all(batches):
        for b in batches:
            unit, rank = b.column(5).to_numpy(), b.column(6).to_numpy()
            sid, slot = np.empty(len(unit), np.int64), np.empty(len(unit), np.int64)
            for u in np.unique(unit).tolist():
                at = np.flatnonzero(unit == u)
                starts, runs_of = runs[u]
                k = np.searchsorted(starts, rank[at], side="right") - 1
                seq, times, place = runs_of[k].T
                sid[at], slot[at] = seq + (rank[at] - starts[k]) // times, place + (rank[at] - starts[k]) % times
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(5)), pa.array(sid), pa.array(slot)],
                                             ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "slot"])

    placed = ranked.mapInArrow(place_all, f"doc_id {dict(docs.dtypes)['doc_id']}, {_PIECES}, sequence_id long, slot long")
    before = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return (placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0).cast("long")))
            .drop("slot"))
