"""Substring deduplication by external induced sorting of suffixes.

A text's bytes are removed where a string of ``length`` bytes covers them that also starts
earlier in the corpus (smaller document, or earlier in the same one). Sorting all suffixes
would write many times the input, so only sampled ones are sorted, and the others are
induced from them:

1. *Sampled suffixes.* In every window of ``length`` bytes the smallest of its ``SEED``-byte
   strings, under a fixed hash order, is sampled. That choice depends on the window alone, so
   equal windows have their sample at the same offset, and a sample stands for a run of
   adjacent windows. Its tuple holds its name (64 bits of its first ``SEED`` bytes), the
   name of all bytes of its run, document and place.
2. *Sort.* Tuples are shuffled and sorted by name, which is Spark's external sort: it spills,
   so nothing has to fit in memory. A class of one member is unique and done, most are.
   Members after the first with an equal run repeat it, all its windows go. A class of
   equal runs needs no more.
3. *Recursion.* Only the first ones of the different runs of a class go on, with their bytes.
   In a class they are sorted by the bytes to the right and by those to the left, with the
   common-prefix values of neighbours in both orders.
4. *Induction.* A window that starts ``d`` bytes before its sample equals another one if the
   samples share ``d`` bytes to the left and ``length - d`` to the right: classes by
   common prefixes, for each ``d``, without sorting again.

A name that many different runs share (a widespread line) would make one large class. A task
that meets more than ``MANY`` of them passes each window of theirs on under its own name; their class
hears of it by one tuple. Within a task repeated runs and windows are dropped before the
shuffle, so that a key has at most one row (or ``MANY``) per batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ranked, whole

SEED = 24  # bytes that name a sampled suffix
MANY = 64  # different runs of a name in one batch (or 16 times as many in its class) that make it widespread
CHUNK = 1 << 17  # windows that are looked at together
ROWS = 20_000  # members that are induced together, at least whole classes
BITS = 12  # of a run's count and of its distance to the sample: length is below 2 ** BITS
TUPLE, HINT, GONE, WIDE, OPEN = range(5)
MASK = (1 << BITS) - 1
ROW = "key long, name long, doc long, sub long, at long, kind int"
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def _constants():
    rng = np.random.default_rng(20_011)
    return [(rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1), np.uint64(b), np.uint64(pow(b, -1, 2**64))) for b in BASES]


def _powers(base: np.uint64, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Namer:
    """Samples and names of a batch of texts; the tables are built once per task."""

    def __init__(self, length: int):
        self.length, self.seed = length, max(1, min(SEED, length // 2))
        n = CHUNK + 2 * length
        self.tables = [(t, _powers(b, n), _powers(i, n)) for t, b, i in _constants()]

    def samples(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple]:
        """``row, lo, count, dist, name, run``: windows lo to lo + count - 1 of a row, whose sample lies dist after the last one's start."""
        length, k = self.length, self.seed
        for s in range(0, len(data) - length + 1, CHUNK):
            x = data[s:s + CHUNK + length - 1]
            first, last = np.searchsorted(offsets, [s, s + len(x)], "right")
            ends = np.repeat(offsets[first:last + 1], np.diff(np.clip(offsets[first - 1:last + 1], s, s + len(x))))
            one, two = (np.concatenate(([np.uint64(0)], np.cumsum(t[x] * p[:len(x)], dtype=np.uint64))) for t, p, _ in self.tables)
            (_, _, back1), (_, _, back2) = self.tables
            h = _mix((one[k:] - one[:-k]) * back1[:len(x) - k + 1])
            low = np.uint64((1 << 18) - 1)
            least, size, want = (h & ~low) | np.arange(len(h), dtype=np.uint64), 1, length - k + 1
            while size * 2 <= want:
                least, size = np.minimum(least[:-size], least[size:]), size * 2
            if want > size:
                least = np.minimum(least[:size - want], least[want - size:])
            n = len(x) - length + 1
            at = np.where(ends[:n] >= np.arange(s, s + n) + length, (least[:n] & low).astype(np.int64), -1)
            # A window's row changes where the one before is cut off by the row's end, so samples differ there.
            cut = np.flatnonzero(np.diff(at)) + 1
            lo, hi = np.concatenate(([0], cut)), np.concatenate((cut, [n])) - 1
            some = at[lo] >= 0
            lo, hi = lo[some], hi[some]
            a = at[lo]
            run = _mix((two[hi + length] - two[lo]) * back2[lo])
            run = _mix(run + (a - lo).astype(np.uint64) * np.uint64(1 << BITS) + (a - hi).astype(np.uint64))
            row = np.searchsorted(offsets, lo + s, "right") - 1
            yield row, lo + s - offsets[row], hi - lo + 1, a - hi, h[a].view(np.int64), run.view(np.int64)

    def window_names(self, windows: np.ndarray) -> list[np.ndarray]:
        """Two names of each row of a matrix of bytes."""
        return [_mix((t[windows] * p[:windows.shape[1]]).sum(1, dtype=np.uint64)).view(np.int64) for t, p, _ in self.tables]


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows and the offset of each; null rows are empty."""
    c = column.cast(pa.large_binary()).fill_null(b"")
    o = np.frombuffer(c.buffers()[1], np.int64)[c.offset:c.offset + len(c) + 1]
    data = np.frombuffer(c.buffers()[2], np.uint8) if c.buffers()[2] is not None and len(c.buffers()[2]) else np.zeros(0, np.uint8)
    return data[o[0]:o[-1]] if len(o) else data, o - o[0]


def _longs(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in names]


def _batch(schema: str, *columns) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [f.split(" ") for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], [n for n, _ in fields])


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where any of the sorted keys differs from the row before."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return new


def _order(doc: np.ndarray, sub: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each row among the documents of a batch, and whether it is the first one of its document."""
    o = np.lexsort((sub, doc))
    place, once = np.empty(len(o), np.int64), np.zeros(len(o), bool)
    place[o] = np.arange(len(o))
    once[o] = _starts(doc[o], sub[o]) if len(o) else True
    return place, once


def _spread(doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    return _mix(doc.astype(np.uint64) * np.uint64(BASES[0]) + at.astype(np.uint64)).view(np.int64)


def _name_batches(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        namer = Namer(length)
        for b in batches:
            data, offsets = _bytes_of(b.column(2))
            parts = list(namer.samples(data, offsets))
            if not parts:
                continue
            row, lo, n, dist, name, runs = (np.concatenate(p) for p in zip(*parts))
            doc, sub = _longs(b, "doc", "sub")
            place, once = _order(doc, sub)
            at = lo << 2 * BITS | n << BITS | dist
            o = np.lexsort((at, place[row], runs, name))
            o = o[once[row[o]]]
            row, at, name, runs = row[o], at[o], name[o], runs[o]
            first = _starts(name, runs)
            head = _starts(name)
            of = np.cumsum(head) - 1
            wide = (np.bincount(of, first) > MANY)[of]
            kind = np.where(~first, GONE, np.where(wide, WIDE, TUPLE)).astype(np.int32)
            key = np.where(kind == TUPLE, name, _spread(doc[row], at))
            hint = head & wide
            take = np.concatenate((np.arange(len(o)), np.flatnonzero(hint)))
            key = np.concatenate((key, name[hint]))
            kind = np.concatenate((kind, np.full(hint.sum(), HINT, np.int32)))
            yield _batch(ROW, key, runs[take], doc[row[take]], sub[row[take]], at[take], kind)

    return run


def _whole_keys(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Sorted batches regrouped so that no key is cut; about ``rows`` rows at a time."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n < rows:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        key = t.column("key").to_numpy()
        at = int(np.searchsorted(key, key[-1], "left"))
        if at:
            yield t.slice(0, at)
        held, n = t.slice(at).to_batches(), t.num_rows - at
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in _whole_keys(batches, 200_000):
        key, name, doc, sub, at, kind = (t.column(c).to_numpy() for c in ("key", "name", "doc", "sub", "at", "kind"))
        done = np.isin(kind, (GONE, WIDE))
        i = np.flatnonzero(~done)
        k, m = key[i], name[i]
        if len(i):
            # A row that appears twice is not its own earlier copy: count from the first place of a run.
            first = _starts(k, m)
            lead = np.maximum.accumulate(np.where(first, np.arange(len(i)), 0))
            same = (doc[i] == doc[i][lead]) & (sub[i] == sub[i][lead]) & (at[i] == at[i][lead])
            of = np.cumsum(_starts(k)) - 1
            runs = np.bincount(of, first)[of]
            hinted = (np.bincount(of, kind[i] == HINT) > 0)[of]
            now = np.where(~same, GONE, np.where(first & (kind[i] == TUPLE) & ((runs > 1) | hinted), np.where(hinted | (runs > 16 * MANY), WIDE, OPEN), -1))
            now = np.where((kind[i] == HINT), -1, now)
            o = np.flatnonzero(now >= 0)
            i, now = i[o], now[o]
        else:
            now = np.zeros(0, np.int64)
        take = np.concatenate((np.flatnonzero(done), i))
        yield _batch("key long, doc long, sub long, at long, kind int", key[take], doc[take], sub[take], at[take], np.concatenate((kind[done], now)).astype(np.int32))


CONTEXT = "key long, doc long, sub long, at long, kind int, bytes binary"


def _contexts(length: int):
    """Open runs with their bytes; windows of widespread ones each under its own name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        namer = Namer(length)
        for b in batches:
            doc, sub = _longs(b, "doc", "sub")
            texts = b.column(2).to_pylist()
            opened = b.column(3)
            row = np.repeat(np.arange(b.num_rows), np.diff(opened.offsets.to_numpy()))
            flat = opened.flatten()
            key, at, kind = (flat.field(n).to_numpy(zero_copy_only=False) for n in ("key", "at", "kind"))
            lo, n = at >> 2 * BITS, at >> BITS & MASK
            o = np.flatnonzero(kind == OPEN)
            yield _batch(CONTEXT, key[o], doc[row[o]], sub[row[o]], at[o], kind[o], [texts[r][i:i + m - 1 + length] for r, i, m in zip(row[o], lo[o], n[o])])
            w = np.flatnonzero(kind == WIDE)
            w = np.repeat(w, n[w])
            if not len(w):
                continue
            begin = _starts(w)
            start = lo[w] + np.arange(len(w)) - np.maximum.accumulate(np.where(begin, np.arange(len(w)), 0))
            names = []
            for s in range(0, len(w), CHUNK // 8):
                part = b"".join(texts[r][i:i + length] for r, i in zip(row[w[s:s + CHUNK // 8]], start[s:s + CHUNK // 8]))
                names.append(namer.window_names(np.frombuffer(part, np.uint8).reshape(-1, length)))
            one, two = (np.concatenate(x) for x in zip(*names))
            place, once = _order(doc, sub)
            o = np.lexsort((start, place[row[w]], two, one))
            o = o[once[row[w[o]]]]
            r, start, one, two = row[w][o], start[o], one[o], two[o]
            first = _starts(one, two)
            at = start << 2 * BITS | 1 << BITS
            yield _batch(CONTEXT, one[first], doc[r[first]], sub[r[first]], at[first], np.full(first.sum(), OPEN), [texts[i][s:s + length] for i, s in zip(r[first], start[first])])
            yield _batch(CONTEXT, _spread(doc[r[~first]], at[~first]), doc[r[~first]], sub[r[~first]], at[~first], np.full((~first).sum(), GONE), [None] * int((~first).sum()))

    return run


def _sorted_with_prefixes(key: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of ``x`` within their key, and how many bytes each shares with the one before (-1 for another key)."""
    o = np.argsort(np.ascontiguousarray(x).view(f"S{x.shape[1]}").ravel(), kind="stable")
    o = o[np.argsort(key[o], kind="stable")]
    differ = x[o[1:]] != x[o[:-1]]
    common = np.where(differ.any(1), differ.argmax(1), x.shape[1])
    return o, np.concatenate(([-1], np.where(key[o[1:]] != key[o[:-1]], -1, common)))


def induce(key: np.ndarray, lo: np.ndarray, n: np.ndarray, dist: np.ndarray, data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and distances of windows that an earlier row of their key holds, too; rows come in order within each key."""
    left = dist + n - 1
    a, end = offsets[:-1] + left, offsets[1:]

    def around(index: np.ndarray, ok: np.ndarray) -> np.ndarray:
        return np.where(ok, data[np.where(ok, index, 0)], np.uint8(0))

    j = np.arange(length)
    o, common = _sorted_with_prefixes(key, around(a[:, None] + j, a[:, None] + j < end[:, None]))
    j = np.arange(max(1, int(left.max())))
    p, shared = _sorted_with_prefixes(key, around(a[:, None] - 1 - j, j < left[:, None]))
    rows, ds = [], []
    right, before = np.empty(len(key), np.int64), np.empty(len(key), np.int64)
    for d in range(int(left.max()) + 1):
        m = np.flatnonzero((dist <= d) & (d <= left))
        if len(m) < 2:
            continue
        right[o], before[p] = np.cumsum(common < length - d), np.cumsum(shared < d)
        both = right[m] * (len(key) + 1) + before[m]
        again = np.ones(len(m), bool)
        again[np.unique(both, return_index=True)[1]] = False
        rows.append(m[again])
        ds.append(np.full(again.sum(), d))
    none = np.zeros(0, np.int64)
    return (np.concatenate(rows), np.concatenate(ds)) if rows else (none, none)


def _induced(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_keys(batches, ROWS):
            key, doc, sub, at, kind = (t.column(c).to_numpy() for c in ("key", "doc", "sub", "at", "kind"))
            gone = kind == GONE
            yield _batch("doc long, sub long, at long", doc[gone], sub[gone], at[gone])
            i = np.flatnonzero(~gone)
            # The same row of a repeated document stands for both.
            i = i[_starts(key[i], doc[i], sub[i], at[i])] if len(i) else i
            if not len(i):
                continue
            data, offsets = _bytes_of(t.column("bytes").combine_chunks().take(pa.array(i)))
            lo, n, dist = at[i] >> 2 * BITS, at[i] >> BITS & MASK, at[i] & MASK
            rows, d = induce(key[i], lo, n, dist, data, offsets, length)
            if not len(rows):
                continue
            start = (lo + n - 1 + dist)[rows] - d
            o = np.lexsort((start, rows))
            rows, start = rows[o], start[o]
            new = _starts(rows, start - np.arange(len(start)))
            begin = np.flatnonzero(new)
            many = np.diff(np.append(begin, len(new)))
            r = i[rows[begin]]
            yield _batch("doc long, sub long, at long", doc[r], sub[r], start[begin] << 2 * BITS | many << BITS)

    return run


def _cut(length: int):
    """Merged spans of each text and the bytes outside them."""
    kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans, kept = [], []
            for text, at in zip(b.column(b.schema.get_field_index("__bytes")).to_pylist(), b.column(b.schema.get_field_index("__at"))):
                text = text or b""
                if not at.is_valid:
                    spans.append([])
                    kept.append(text)
                    continue
                x = np.sort(at.values.to_numpy())
                lo, hi = x >> 2 * BITS, (x >> 2 * BITS) + (x >> BITS & MASK) - 1 + length
                hi = np.maximum.accumulate(hi)
                new = np.flatnonzero(np.concatenate(([True], lo[1:] > hi[:-1])))
                lo, hi = lo[new], hi[np.append(new[1:] - 1, len(hi) - 1)]
                spans.append([{"begin": p, "end": q} for p, q in zip(lo.tolist(), hi.tolist())])
                kept.append(b"".join(text[p:q] for p, q in zip([0, *hi.tolist()], [*lo.tolist(), len(text)])))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t or b"") for t in b.column(1).to_pylist()], pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())],
                                             ["doc_id", "n_bytes", "spans", "kept"])

    return run


def _placed(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """``doc_id, __bytes, doc, sub``: the order of documents in two numbers."""
    text = whole(F.col("text").cast("string")).cast("binary")
    whole_number = dict(docs.dtypes)["doc_id"] in ("tinyint", "smallint", "int", "bigint")
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)) if whole_number else F.lit(0).cast("long")
    rows = docs.select("doc_id", text.alias("__bytes"), doc.alias("doc"))
    twice = scratch.keep(rows.groupBy("doc").agg(F.count("*").alias("c")).where("c > 1").select("doc"), n=F.count(F.lit(1)))
    if not twice.seen["n"]:
        return rows.withColumn("sub", F.lit(0).cast("long"))
    order = [F.col("doc_id").isNull().alias("__none"), F.col("doc_id"), F.md5("__bytes").alias("__md5")]
    several = rows.join(twice, "doc", "left_semi").select("doc", *order).distinct()
    several = ranked(several, [], ["doc", "__none", "doc_id", "__md5"], scratch).select(F.col("doc_id").alias("__id"), "__md5", F.col("rank").alias("sub"))
    rows = rows.withColumn("__own", F.md5("__bytes"))
    j = rows.join(several, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__md5")), "left")
    return j.select("doc_id", "__bytes", "doc", F.coalesce("sub", F.lit(0).cast("long")).alias("sub"))


def deduplicated(docs: DataFrame, length: int = 100, scratch: Scratch | None = None) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, spans`` (removed, as ``begin, end`` in bytes) and the bytes ``kept``.

    Texts are UTF-8 bytes; a null text is empty, and texts below ``length`` bytes stay whole.
    Documents come in the order of doc_id, null ids last; rows that share an id, or have
    none, in the order of their text's digest, and equal rows of one id are one document, so
    neither loses bytes to the other. Ids may be of any type that sorts. Texts of any length count as a
    whole; other columns are ignored; an empty table gives an empty result.
    """
    if not 2 <= length <= MASK // 2:
        raise ValueError(f"length must lie in 2 to {MASK // 2}")
    scratch = scratch or Scratch(docs.sparkSession)
    rows = _placed(docs, scratch)
    named = rows.select("doc", "sub", "__bytes").mapInArrow(_name_batches(length), ROW)
    named = named.repartition(F.col("key")).sortWithinPartitions("key", "name", "doc", "sub", "at")
    first = scratch.keep(named.mapInArrow(_classes, "key long, doc long, sub long, at long, kind int"))
    opened = first.where(F.col("kind") > GONE).groupBy("doc", "sub").agg(F.collect_list(F.struct("key", "at", "kind")).alias("opened"))
    context = rows.select("doc", "sub", "__bytes").join(opened, ["doc", "sub"]).mapInArrow(_contexts(length), CONTEXT)
    context = context.repartition(F.col("key")).sortWithinPartitions("key", "doc", "sub", "at")
    second = scratch.keep(context.mapInArrow(_induced(length), "doc long, sub long, at long"))
    gone = first.where(F.col("kind") == GONE).select("doc", "sub", "at").unionByName(second)
    gone = scratch.keep(gone.groupBy("doc", "sub").agg(F.collect_set("at").alias("__at")))
    out = rows.join(gone, ["doc", "sub"], "left").select("doc_id", "__bytes", "__at")
    kind = dict(docs.dtypes)["doc_id"]
    return out.mapInArrow(_cut(length), f"doc_id {kind}, n_bytes long, spans array<struct<begin: long, end: long>>, kept binary")


def digests(found: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of the operator's result."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["begin"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
