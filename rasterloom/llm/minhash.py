"""MinHash near-deduplication with bottom-k sketches from one hash function.

1. One pass over the texts hashes each document's distinct word shingles and keeps
   the ``k`` smallest values (its sketch), the set's size, a 128-bit digest of the
   word sequence and a 256-bit fold of the set (one bit of the smallest value in each
   of 256 hash ranges).
2. Documents of one and the same word sequence collapse to the smallest id by a grouped
   minimum, so groups of copies cost one row.
3. Inverted lists of retained values generate overlaps. The ``KEYS`` smallest values of
   a document are ordered by how many documents hold them, rarest first. Similar
   documents share at least ``t`` of them, so some of the first ``KEYS - t + 1``, and
   only those index the document: a value of a widespread passage indexes only
   documents that consist of little else. Each list links its members to its first and
   its last one: rows stay linear in the list's length. Then components are found, and
   what this left apart is compared: members outside a list's largest component with
   all its members, in blocks. No pair is dropped for the length of its list.
4. The fold, then the union-sketch estimate, discard pairs far below the threshold;
   exact Jaccard similarity of the full shingle sets of the whole texts decides, and
   links are confirmed on the words themselves.

At similarity J each of the union's smallest values is shared with probability J. ``t``
is such that of the ``KEYS`` smallest fewer than ``t`` are shared with a probability of
at most ``RISK`` (13 of 32 at 0.8: 1.9e-7); sets no larger than ``KEYS`` obey the exact
bound instead. The fold's margin has the same risk and is exact for small sets (a bit
differs only where a shingle does); the estimate's is five standard deviations, which
shrinks to nothing as the sketches cover the sets.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, GroupedData, Window
from pyspark.sql import functions as F

from .common import Scratch, attach, connected_components, with_ids, with_numbers

K = 256  # retained values of a document, 32 leading bits of each
KEYS = 32  # retained values that can index a document, all 64 bits of each
FOLD = 4  # words of 64 bits of a fold
RISK = 3e-7  # of losing a pair at the threshold, at most, for each filter
SALT = 2048  # rows of a list that meet in one task, roughly
BLOCK = 512  # members of a block, at least, where lists are compared block by block
TILE = 1024  # members of a block that a task compares at a time: a million pairs
CROWD = 4  # likely pairs for each member of a block, from which their sketches are compared there
CHUNK = 1 << 20  # bytes of text hashed at a time

_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BYTE[ord("A"):ord("Z") + 1] = _BYTE[ord("a"):ord("z") + 1]  # A-Z count as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_pow = np.ones(1, _U)


def _mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (the public MurmurHash3 constants)."""
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> _U(33))
    h = h * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


def _powers(n: int) -> np.ndarray:
    global _pow
    if len(_pow) < n:
        _pow = np.full(1 << int(n - 1).bit_length(), _BASE, _U)
        _pow[0] = 1
        _pow = np.cumprod(_pow, dtype=_U)
    return _pow[:n]


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; a text with fewer words
    than a shingle has its whole sequence as one; one without words has none. A word
    hashes to the sum of a random value per byte times a power of its place.
    """
    sep = b" "
    buf = np.frombuffer(sep + sep.join(texts) + sep, np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    space = _SPACE[buf]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    start, stop = edge[::2], edge[1::2]
    out = [np.empty(0, _U)] * len(texts)
    if not len(start):
        return out
    length = stop - start
    cuts = np.empty(2 * len(start), np.int64)
    cuts[::2], cuts[1::2] = start, stop
    place = np.arange(len(buf)) - np.repeat(np.concatenate([[0], start]), np.diff(np.concatenate([[0], start, [len(buf)]])))
    longest = int(length.max()) + 1
    val = _BYTE[buf] * _powers(max(longest, 1))[np.minimum(place, longest - 1)]
    word = _mix(np.add.reduceat(val, cuts)[::2] + length.astype(_U) * _U(0xD6E8FEB86659FD93))
    of = np.searchsorted(ends, start, side="left")
    first = np.searchsorted(of, np.arange(len(texts) + 1))
    mult = [_U(pow(0xA24BAED4963EE407, i + 1, 1 << 64) | 1) for i in range(words)]
    full = np.zeros(max(len(word) - words + 1, 0), _U)
    for i in range(words):
        full += word[i:i + len(full)] * mult[i]
    full = _mix(full)
    for d in range(len(texts)):
        lo, hi = first[d], first[d + 1]
        n = hi - lo
        if n >= words:
            out[d] = np.unique(full[lo:hi - words + 1])
        elif n:
            own = word[lo:hi] * np.array(mult[:n], _U)
            out[d] = _mix(own.sum(dtype=_U, keepdims=True) + _U(n))
    return out


def _chunks(texts: list[bytes]):
    at, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > CHUNK:
            yield at, texts[at:i]
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield at, texts[at:]


def _as_bytes(col: pa.Array) -> list[bytes]:
    return [x or b"" for x in col.cast(pa.binary()).to_pylist()]


def _fold(sets: np.ndarray) -> list[int]:
    """A bit of the smallest value in each of ``64 * FOLD`` ranges; 0 where a range is empty."""
    slot = (sets >> _U(65 - (64 * FOLD).bit_length())).astype(np.int64)
    head = np.flatnonzero(np.diff(slot, prepend=-1))
    bits = (sets[head] & _U(1)) << (slot[head] & 63).astype(_U)
    cuts = np.searchsorted(slot[head], np.arange(0, 64 * FOLD + 1, 64))
    return [int(np.bitwise_or.reduce(bits[lo:hi], initial=_U(0)).astype(np.int64)) for lo, hi in zip(cuts, cuts[1:])]


FOLDS = [f"f{i}" for i in range(FOLD)]
_LONGS = ["n", *FOLDS]
_SKETCH = f"doc_id long, dig binary, {', '.join(f'{c} long' for c in _LONGS)}, keys array<long>, mins array<int>"


def _words(text: bytes) -> list[bytes]:
    """Words of a text with A-Z lower-cased: bytes split at just the six separators."""
    return text.lower().split()


def sketches(docs: DataFrame, words: int, k: int = K) -> DataFrame:
    """Sketch of each row: ``doc_id``, ``dig`` (digest of its words), ``n`` (size of its set), its
    fold, the ``KEYS`` smallest values as ``keys`` and the leading halves of the ``k`` smallest as ``mins``, ascending."""

    def run(batches):
        for b in batches:
            texts, ids = _as_bytes(b.column(1)), b.column(0)
            for at, part in _chunks(texts):
                longs, digs, keys, mins = [], [], [], []
                for t, s in zip(part, shingle_sets(part, words)):
                    digs.append(hashlib.blake2b(b" ".join(_words(t)), digest_size=16).digest())
                    longs.append([len(s), *_fold(s)])
                    # Flipped so that a signed comparison has the same order.
                    own = (s[:k] ^ _U(1 << 63)).astype(np.int64)
                    keys.append(own[:KEYS])
                    mins.append((own >> 32).astype(np.int32))
                lists = [pa.ListArray.from_arrays(np.cumsum([0, *map(len, x)]).astype(np.int32), pa.array(np.concatenate(x))) for x in (keys, mins)]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, len(part)), pa.array(digs, pa.binary()), *(pa.array(x, pa.int64()) for x in zip(*longs)), *lists],
                    ["doc_id", "dig", *_LONGS, "keys", "mins"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _SKETCH)


def _least(n: int, p: float, risk: float = RISK) -> int:
    """Largest t such that fewer than t hits in n tries of chance p have a probability of at most ``risk``."""
    below = 0.0
    for t in range(n + 1):
        below += math.comb(n, t) * p ** t * (1 - p) ** (n - t)
        if below > risk:
            return t
    return n


def _verify(pairs: DataFrame, docs: DataFrame, words: int, percent: int, scratch: Scratch) -> DataFrame:
    """Pairs ``a, b`` whose full sets reach ``percent`` hundredths of Jaccard similarity, kept, with ``rows`` seen."""
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    ids = scratch.keep(ids, rows=F.count(F.lit(1)))
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    # Only documents of some pair move; their ids are broadcast up to 8 MB of them, else joined: the same rows.
    texts = texts.join(F.broadcast(ids) if ids.seen["rows"] <= 1_000_000 else ids, "doc_id", "left_semi")

    def run(batches):
        for b in batches:
            left, right = _as_bytes(b.column(2)), _as_bytes(b.column(3))
            ok = np.zeros(b.num_rows, bool)
            for at, part in _chunks(left):
                known: dict = {}
                said: dict = {}
                sa = _sets_once(part, known, words)
                sb = _sets_once(right[at:at + len(part)], known, words)
                for i, (x, y) in enumerate(zip(sa, sb), at):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if both and 100 * both >= percent * (len(x) + len(y) - both):
                        one, two = (_said(t, said, words) for t in (left[i], right[i]))
                        both = len(one & two)
                        ok[i] = 100 * both >= percent * (len(one) + len(two) - both)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(ok)), b.column(1).filter(pa.array(ok))], ["a", "b"])

    full = (pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a")
            .join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")
            .select("a", "b", "ta", "tb"))
    out = scratch.keep(full.mapInArrow(run, "a long, b long"), rows=F.count(F.lit(1)))
    scratch.drop(ids)
    return out


def _sets_once(texts: list[bytes], known: dict, words: int) -> list[np.ndarray]:
    """Sets of texts, each different text hashed once, a chunk's worth at a time."""
    new = [t for t in dict.fromkeys(texts) if t not in known]
    for _, part in _chunks(new):
        known.update(zip(part, shingle_sets(part, words)))
    return [known[t] for t in texts]


def _said(text: bytes, known: dict, words: int) -> set:
    """The shingles of a text as tuples of its words."""
    if text not in known:
        w = _words(text)
        known[text] = set(zip(*(w[i:] for i in range(words)))) if len(w) >= words else {tuple(w)} if w else set()
    return known[text]


def _most(percent: int) -> int:
    """Bits of a fold that may differ, by chance alone, at the threshold."""
    return 64 * FOLD - _least(64 * FOLD, 1 - (1 - percent / 100) / 2)


def _likely(a: str, b: str, percent: int) -> Column:
    """Sizes that allow the similarity, and folds that agree on enough bits: a range's bits
    differ only if its smallest value is not common, and each differing shingle is in one range."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    differ = sum((F.bit_count(F.col(f"{a}.{f}").bitwiseXOR(F.col(f"{b}.{f}"))) for f in FOLDS[1:]), F.bit_count(F.col(f"{a}.f0").bitwiseXOR(F.col(f"{b}.f0"))))
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & (differ <= F.least(F.lit(_most(percent)), (na + nb) * (100 - percent) / (100 + percent)))


def _near(a: str, b: str, na, nb, percent: int, k: int):
    """Union-sketch estimate: the share of the union's ``k`` smallest values that both hold
    reaches the threshold less five standard deviations (none where the sketch is the union)."""
    both = F.array_intersect(a, b)
    j = percent / 100
    whole = (na + nb) / (1 + j)  # size of the union at the threshold

    def test(m):
        union = F.array_size(a) + F.array_size(b) - m
        seen = F.least(union, F.lit(k))
        margin = 5 * F.sqrt(j * (1 - j) / seen * F.greatest(F.lit(0.0), 1 - seen / whole))
        smallest = F.slice(F.sort_array(F.array_union(a, b)), 1, k)
        enough = lambda shared: shared >= (j - margin) * seen - 1e-9
        # What lies among the union's smallest is part of what both hold.
        return F.when(~enough(m), False).when(union <= k, True).otherwise(enough(F.array_size(F.array_intersect(both, smallest))))

    # As a lambda's variable the intersection is evaluated once.
    return F.get(F.transform(F.array(F.array_size(both)), test), F.lit(0))


def _mins(ids: DataFrame, cand: DataFrame, sk: DataFrame) -> DataFrame:
    """``doc, n, mins`` of the documents in ``ids``. Sketches of others do not move; ids are broadcast up to some 8 MB of them."""
    near = F.broadcast if ids.seen["rows"] <= 1_000_000 else lambda df: df
    some = near(cand.join(near(ids), "doc", "left_semi").select("rid", "doc", "n"))
    return sk.select("rid", "mins").join(some, "rid").select("doc", "n", "mins")


def _estimated(pairs: DataFrame, cand: DataFrame, sk: DataFrame, percent: int, k: int, scratch: Scratch) -> DataFrame:
    """Pairs ``a, b`` whose sketches are near, kept."""
    pairs = scratch.keep(pairs)
    ids = scratch.keep(pairs.select(F.col("a").alias("doc")).union(pairs.select("b")).distinct(), rows=F.count(F.lit(1)))
    docs = _mins(ids, cand, sk)
    both = pairs.join(docs.toDF("a", "na", "ma"), "a").join(docs.toDF("b", "nb", "mb"), "b")
    out = scratch.keep(both.where(_near("ma", "mb", F.col("na"), F.col("nb"), percent, k)).select("a", "b"))
    scratch.drop(pairs, ids)
    return out


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, k: int = K, scratch: Scratch | None = None) -> DataFrame:
    """Components of documents whose word-shingle sets have Jaccard similarity of ``percent`` / 100 or more.

    Takes ``doc_id`` and ``text`` (other columns are ignored) and returns one row
    per input row: ``doc_id, n_shingles, component_id, kept``. ``component_id`` is
    the smallest doc_id reachable by links, ``kept`` marks the row that bears it.

    Defined cases: a null or blank text has an empty set, links with nothing and is
    kept; texts of any length count as a whole; repeated rows come back as often as they
    went in; rows that share a doc_id count as one document; ids may be of any type that
    sorts; a null doc_id links with nothing (component null, kept); an empty table gives
    an empty result.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    docs, names = with_numbers(docs.select("doc_id", "text"), "doc_id", scratch)
    count = F.count(F.lit(1))
    sk = scratch.keep(sketches(docs, words, k).withColumn("rid", F.monotonically_increasing_id()), rows=count)
    rows = sk.seen["rows"]
    ids = scratch.keep(sk.select("rid", "doc_id", F.col("n").alias("n_shingles"), F.when(F.expr("n > 0 and doc_id is not null"), F.col("dig")).alias("dig")))
    heads = scratch.keep(ids.where("dig is not null").groupBy("dig").agg(F.min("doc_id").alias("doc"), F.min_by("rid", "doc_id").alias("rid"), count.alias("c")))
    cand = _candidates(sk, heads, percent, scratch)
    star = _estimated(_first_and_last(cand, percent), cand, sk, percent, k, scratch)
    edges = _verify(star, docs, words, percent, scratch).unionByName(_same_id(ids, heads, rows, scratch))
    comp = connected_components(edges, scratch)
    if (more := _between(cand, sk, comp, star, percent, k, scratch)) is not None:
        late = _verify(more, docs, words, percent, scratch)
        if late.seen["rows"]:
            comp = connected_components(comp.select(F.col("component").alias("a"), F.col("node").alias("b")).unionByName(late), scratch)
        scratch.drop(more, late)
    scratch.drop(cand, sk, star)

    of = heads.join(comp, F.col("doc") == F.col("node"), "left").where("c > 1 or component is not null")
    of = of.select("dig", F.coalesce("component", "doc").alias("component"), "c")
    found = (attach(ids.drop("rid"), of, "dig", rows, "left")
             .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
             .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))
    return with_ids(found, ["doc_id", "component_id"], names, scratch)


def _same_id(ids: DataFrame, heads: DataFrame, rows: int, scratch: Scratch) -> DataFrame:
    """Edges between the texts of one doc_id, if any doc_id has several."""
    h = F.xxhash64("dig")
    twice = scratch.keep(ids.where("dig is not null").groupBy("doc_id").agg(F.min(h).alias("lo"), F.max(h).alias("hi")).where("lo <> hi").select("doc_id"),
                         rows=F.count(F.lit(1)))
    if not twice.seen["rows"]:
        return twice.select(F.col("doc_id").alias("a"), F.col("doc_id").alias("b"))
    of = attach(ids.drop("rid"), heads.select("dig", "doc", "c"), "dig", rows).join(twice, "doc_id", "left_semi").select("doc_id", "doc").distinct()
    return of.join(of.groupBy("doc_id").agg(F.min("doc").alias("a")), "doc_id").select("a", F.col("doc").alias("b"))


def _candidates(sk: DataFrame, heads: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Documents that share enough retained values with others: ``rid, doc, n``, fold and
    ``prefix``, the values that index it, each with the number ``c`` of its documents."""
    kr = sk.select("rid", "n", "keys").join(heads.select("rid", "doc"), "rid")
    kr = scratch.keep(kr, values=F.sum(F.size("keys")))
    each = kr.select("rid", "n", F.explode("keys").alias("key"))
    counts = scratch.keep(each.groupBy("key").agg(F.count("*").alias("c")).where("c > 1"))
    shared = attach(each, counts, "key", kr.seen["values"] or 0)
    shared = shared.groupBy("rid", "n").agg(F.sort_array(F.collect_list(F.struct("c", "key"))).alias("p"))
    # So many of a document's values are common to it and any similar one; values of its own come first.
    j = percent / 100
    size = F.least("n", F.lit(KEYS))
    t = F.least(F.lit(_least(KEYS, j)), F.ceil(size * percent / 100).cast("int"))
    prefix = F.slice("p", F.lit(1), F.greatest(F.size("p") - t + 1, F.lit(0)))
    shared = shared.select("rid", prefix.alias("prefix")).where(F.size("prefix") > 0)
    out = shared.join(sk.select("rid", F.col("doc_id").alias("doc"), *_LONGS), "rid")
    out = scratch.keep(out, values=F.sum(F.size("prefix")))
    scratch.drop(kr, counts)
    return out


def _lists(cand: DataFrame, columns: list[str] = FOLDS) -> DataFrame:
    """Members of the inverted lists: ``key``, its documents ``c``, and the document."""
    own = ["doc", "n", *columns]
    return cand.select(*own, F.explode("prefix").alias("x")).select("x.key", "x.c", *own)


def _first_and_last(cand: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a`` < ``b`` of each list's first and last member with its others, if likely. Lists of up to ``SALT`` rows
    move once, by their key; longer ones are dealt to several tasks by a salt, to each of which their first and last go."""
    member = F.struct("doc", *_LONGS)
    rows = _lists(cand).select("key", "c", member.alias("y"))
    short, rows = rows.where(F.col("c") <= SALT), rows.where(F.col("c") > SALT)
    own = Window.partitionBy("key")  # at most SALT rows
    short = short.select("y", F.min("y").over(own).alias("lo"), F.max("y").over(own).alias("hi")).select("y", F.explode(F.array("lo", "hi")).alias("x"))
    parts = F.ceil(F.col("c") / SALT).cast("int")
    lead = rows.groupBy("key").agg(F.min("y").alias("lo"), F.max("y").alias("hi"), F.max("c").alias("c")).where("lo.doc <> hi.doc")
    lead = lead.select("key", "c", F.explode(F.array("lo", "hi")).alias("x")).select("key", F.explode(F.sequence(F.lit(0), parts - 1)).alias("salt"), "x")
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("y.doc"), parts).cast("int"))
    met = short.unionByName(rows.join(lead, ["key", "salt"]).select("y", "x"))
    return (met.where((F.col("x.doc") != F.col("y.doc")) & _likely("x", "y", percent))
            .select(F.least("x.doc", "y.doc").alias("a"), F.greatest("x.doc", "y.doc").alias("b")).distinct())


def _between(cand: DataFrame, sk: DataFrame, comp: DataFrame, tried: DataFrame, percent: int, k: int, scratch: Scratch) -> DataFrame | None:
    """Pairs of different components within the lists whose sketches are near, ``a`` < ``b``,
    without those ``tried``; None if no list has several.

    Lists of up to three members have no pair without the first or the last, so longer
    ones are left. Every pair of different components has a member outside the list's
    largest one, so those alone meet all members: a list that is one component but for a
    few costs a few times its length. Both sides go in blocks that grow with the root of
    the list, so rows are sent fewer times than its square.

    Members come with their folds only, which leave few pairs in most blocks. A list with
    a block that has many (of a group whose members are just not similar enough) comes again
    with the sketches, and a pair counts at the first value that indexes both.
    """
    own = _lists(cand.select("doc", "n", "prefix"), []).join(comp.withColumnRenamed("node", "doc"), "doc", "left")
    own = scratch.keep(own.select("key", "doc", "n", F.coalesce("component", "doc").alias("comp")))
    parts = own.groupBy("key", "comp").agg(F.count("*").alias("m")).groupBy("key").agg(
        F.sum("m").alias("c"), F.max(F.struct("m", "comp")).alias("top"), F.count("*").alias("comps"))
    block = F.greatest(F.lit(float(BLOCK)), 4 * F.sqrt("c"))
    blocks = lambda n: F.ceil(n / block).cast("int")
    lists = parts.where("comps > 1 and c > 3").select("key", "c", F.col("top.comp").alias("top"), blocks(F.col("c") - F.col("top.m")).alias("outs"), blocks(F.col("c")).alias("alls"))
    lists = scratch.keep(lists, rows=F.count(F.lit(1)))
    if not lists.seen["rows"]:
        scratch.drop(own, lists)
        return None
    values = cand.seen["values"] or 0
    rows = scratch.keep(attach(own, lists, "key", values).drop("c").join(cand.select("doc", *_LONGS), ["doc", "n"]))
    scratch.drop(own)
    deal = lambda n: F.pmod(F.xxhash64("doc"), F.col(n)).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    meet = ["key", "ob", "ab"]

    def in_blocks(rows: DataFrame, *columns: str) -> GroupedData:
        columns = [*meet, "out", "doc", "n", "comp", "top", *columns]
        every = rows.withColumn("ab", deal("alls")).withColumn("ob", upto("outs")).withColumn("out", F.expr("comp <> top and outs * alls = 1"))
        outside = rows.where("comp <> top and outs * alls > 1").withColumn("ob", deal("outs")).withColumn("ab", upto("alls"))
        return every.select(columns).unionByName(outside.withColumn("out", F.lit(None).cast("boolean")).select(columns)).groupBy(*meet)

    def sides(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """The members outside (``out`` is null if sent as such only) and all members."""
        out = t["out"].to_pylist()
        return np.array([i for i, o in enumerate(out) if o is None or o], np.int64), np.array([i for i, o in enumerate(out) if o is not None], np.int64)

    def ordered(t: pa.Table, a: np.ndarray, b: np.ndarray) -> dict:
        doc = t["doc"].to_numpy()
        return {"a": np.minimum(doc[a], doc[b]), "b": np.maximum(doc[a], doc[b])}

    def tiles(x: np.ndarray, y: np.ndarray):
        """A block is compared some members against some others at a time, however large it is."""
        for i in range(0, len(x), TILE):
            for j in range(0, len(y), TILE):
                yield x[i:i + TILE], y[j:j + TILE]

    def by_folds(t: pa.Table) -> pa.Table:
        x, y = sides(t)
        a, b, n = [x[:0]], [y[:0]], 0
        for u, v in tiles(x, y):
            i, j = np.nonzero(_apart(t, u, v, percent) & _folds_agree(t, u, v, percent))
            n += len(i)
            if n > CROWD * (len(x) + len(y)):
                null = pa.nulls(1, pa.int64())
                return pa.table({"a": null, "b": null, "key": t["key"].slice(0, 1)})
            a.append(u[i])
            b.append(v[j])
        return pa.table({**ordered(t, np.concatenate(a), np.concatenate(b)), "key": pa.nulls(n, pa.int64())})

    def by_sketches(t: pa.Table) -> pa.Table:
        x, y = sides(t)
        near = [(x[:0], y[:0]), *(_near_pairs(t, u, v, percent, k) for u, v in tiles(x, y))]
        return pa.table(ordered(t, *map(np.concatenate, zip(*near))))

    found = scratch.keep(in_blocks(rows, *FOLDS).applyInArrow(by_folds, "a long, b long, key long"), crowded=F.count("key"))
    pairs = found.where("key is null").select("a", "b").distinct().join(tried, ["a", "b"], "left_anti")
    out = _estimated(pairs, cand, sk, percent, k, scratch)
    if found.seen["crowded"]:
        crowded = lists.join(found.where("key is not null").select("key").distinct(), "key", "left_semi").select("key", "c")
        again = scratch.keep(attach(rows.drop(*FOLDS), crowded, "key", values))
        ids = scratch.keep(again.select("doc").distinct(), rows=F.count(F.lit(1)))
        by = cand.select("doc", "n", F.transform("prefix", lambda x: x["key"]).alias("by")).join(ids, "doc", "left_semi")
        again = again.join(_mins(ids, cand, sk), ["doc", "n"]).join(by, ["doc", "n"])
        again = in_blocks(again, "mins", "by").applyInArrow(by_sketches, "a long, b long").distinct().join(tried, ["a", "b"], "left_anti")
        out = scratch.keep(out.unionByName(again).distinct())
    scratch.drop(rows, lists, found)
    return out


def _apart(t: pa.Table, x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """Pairs of rows x and y in different components, each pair once, whose sizes allow the similarity."""
    doc, n, comp = (t[c].to_numpy() for c in ("doc", "n", "comp"))
    ok = (comp[x][:, None] != comp[y]) & ((comp[y] == t["top"][0].as_py()) | (doc[x][:, None] < doc[y]))
    return ok & (100 * np.minimum(n[x][:, None], n[y]) >= percent * np.maximum(n[x][:, None], n[y]))


def _folds_agree(t: pa.Table, x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """The same test of the folds as in ``_likely``."""
    n = t["n"].to_numpy()
    differ = np.zeros((len(x), len(y)), np.int32)
    for f in FOLDS:
        v = t[f].to_numpy().view(_U)
        differ += np.bitwise_count(v[x][:, None] ^ v[y])
    return differ <= np.minimum(_most(percent), (n[x][:, None] + n[y]) * (100 - percent) / (100 + percent))


def _near_pairs(t: pa.Table, x: np.ndarray, y: np.ndarray, percent: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows ``x`` and ``y`` of a block that are of different components, first meet here and have near sketches."""
    n, ok = t["n"].to_numpy(), _apart(t, x, y, percent)
    ok &= _common(t["by"], x, y, ok, below=t["key"][0].as_py()) == 0
    both = _common(t["mins"], x, y, ok)
    size = t["mins"].combine_chunks().value_lengths().to_numpy()
    i, j = np.nonzero(ok)
    both, (i, j) = both[i, j], (x[i], y[j])
    # As in ``_near``: what lies among the union's smallest is part of what both hold.
    p = percent / 100
    union = size[i] + size[j] - both
    seen = np.minimum(union, k)
    least = (p - 5 * np.sqrt(p * (1 - p) / seen * np.maximum(0.0, 1 - seen / ((n[i] + n[j]) / (1 + p))))) * seen - 1e-9
    near = both >= least
    mins = t["mins"].combine_chunks()
    start, flat = mins.offsets.to_numpy(), mins.values.to_numpy()
    for q in np.flatnonzero(near & (union > k)):
        u, v = (flat[start[r]:start[r + 1]] for r in (i[q], j[q]))
        last = np.partition(np.union1d(u, v), k - 1)[k - 1]
        near[q] = len(np.intersect1d(u[u <= last], v[v <= last], assume_unique=False)) >= least[q]
    return i[near], j[near]


def _common(lists: pa.ChunkedArray, x: np.ndarray, y: np.ndarray, ok: np.ndarray, below: int | None = None) -> np.ndarray:
    """Number of values (``below`` some value) that the lists of rows x and y have in common, for
    those with a pair that is still ``ok``: for each value of an x, the ys that hold it are counted."""
    col = lists.combine_chunks()
    start, flat = col.offsets.to_numpy(), col.values.to_numpy()

    def entries(rows, some):
        at = np.flatnonzero(some)
        lo, length = start[rows[at]], start[rows[at] + 1] - start[rows[at]]
        value = flat[np.repeat(lo - np.cumsum(length) + length, length) + np.arange(length.sum())]
        of = np.repeat(at, length)
        return (value, of) if below is None else (value[value < below], of[value < below])

    (u, ui), (v, vi) = entries(x, ok.any(1)), entries(y, ok.any(0))
    order = np.argsort(v, kind="stable")
    v, vi = v[order], vi[order]
    lo, m = np.searchsorted(v, u), np.searchsorted(v, u, side="right")
    m = m - lo
    out = np.zeros(len(x) * len(y), np.int32)
    at, total = 0, np.cumsum(m)
    while at < len(u):  # some millions of meetings at a time
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + (1 << 22))))
        c = m[at:to]
        ys = vi[np.repeat(lo[at:to] - np.cumsum(c) + c, c) + np.arange(c.sum())]
        out += np.bincount(np.repeat(ui[at:to], c) * len(y) + ys, minlength=len(out)).astype(np.int32)
        at = to
    return out.reshape(len(x), len(y))


#: DuckDB twin for two-word shingles: all pairs that share a shingle.
SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda s: s <> '') AS w FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS sh FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (
  SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
m AS (SELECT a, min(b) AS low FROM r GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id, doc_id <= coalesce(low, doc_id) AS kept
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN m ON a = doc_id
"""
