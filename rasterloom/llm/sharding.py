"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Groups are documents of equal text. They are sorted by size and each enters the bin
whose remaining capacity is the tightest that still holds it, found in a balanced
tree; a new bin opens when none holds it. The capacity starts at an equal share and
grows in small steps until the given number of shards suffices.

Groups of one size are alike, so the plan works on sizes: the tightest bin takes groups
of a size one after the other while it holds another, which is one step however many
they are. Groups find their bin by their rank within their size. Sizes above ``FINE``
bytes are rounded up in their ``BITS`` leading bits (by less than 0.05 %), so that there
are at most some ten thousands of them, whatever the corpus. Only a group that exceeds a
whole shard's equal share is divided, as no shard of equal size could hold it.
"""

from __future__ import annotations

import random
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, attach, fan_out, prefix_offsets, whole

FINE, BITS = 4096, 11
PARTS = 256  # of a group above a shard's share
STEP = 0.0005  # growth of the capacity while the shards do not suffice


class Tree:
    """Balanced search tree (a treap) of keys in order; finds the smallest key from a bound on."""

    def __init__(self):
        self.root, self.dice = None, random.Random(7)

    def _split(self, t, key):
        if t is None:
            return None, None
        if t[0] < key:
            lo, hi = self._split(t[3], key)
            return [t[0], t[1], t[2], lo], hi
        lo, hi = self._split(t[2], key)
        return lo, [t[0], t[1], hi, t[3]]

    def _merge(self, a, b):
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            return [a[0], a[1], a[2], self._merge(a[3], b)]
        return [b[0], b[1], self._merge(a, b[2]), b[3]]

    def add(self, key) -> None:
        lo, hi = self._split(self.root, key)
        self.root = self._merge(self._merge(lo, [key, self.dice.random(), None, None]), hi)

    def take(self, bound):
        """Removes and returns the smallest key that is not below ``bound``, or None."""
        t, best = self.root, None
        while t is not None:
            best, t = (t[0], t[2]) if t[0] >= bound else (best, t[3])
        if best is not None:
            lo, rest = self._split(self.root, best)
            _, hi = self._split(rest, (best[0], best[1] + 1))
            self.root = self._merge(lo, hi)
        return best


def best_fit_decreasing(sizes: Iterable[tuple[int, int]], capacity: int) -> list[tuple[int, int, int, int]]:
    """Runs ``size, first, count, bin`` of (size, count) classes: groups ``first`` to
    ``first + count - 1`` of the size go to the bin; as few bins as the rule opens.

    A bin that has taken a group is the tightest for the next of the same size while it
    holds it, so a run takes as many at once as the rule would one by one.
    """
    tree, runs, bins = Tree(), [], 0
    for size, count in sorted(sizes, reverse=True):
        done = 0
        while done < count:
            found = tree.take((size, -1))
            if found is None:
                found, bins = (max(capacity, size), bins), bins + 1
            n = min(count - done, found[0] // size)
            runs.append((size, done, n, found[1]))
            tree.add((found[0] - n * size, found[1]))
            done += n
    return runs


def plan(sizes: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int, int]]:
    """Runs at the smallest capacity, in steps from an equal share, at which ``shards`` bins suffice."""
    capacity = max(1, -(-sum(s * n for s, n in sizes) // shards), max((s for s, _ in sizes), default=1))
    while True:
        runs = best_fit_decreasing(sizes, capacity)
        if max((r[3] for r in runs), default=0) < shards:
            return runs
        capacity += max(1, int(capacity * STEP))


def _class(size: Column) -> Column:
    """A size, rounded up in its leading bits above ``FINE``."""
    low = F.greatest(F.length(F.bin(size)) - BITS, F.lit(0))
    up = F.call_function("shiftleft", F.call_function("shiftright", size + F.call_function("shiftleft", F.lit(1).cast("long"), low) - 1, low), low)
    return F.when(size <= FINE, size).otherwise(up)


def shard(docs: DataFrame, shards: int = 16, scratch: Scratch | None = None) -> DataFrame:
    """One row per document: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.

    ``size`` is the text's UTF-8 bytes plus 1; the law is ``bytes``: shard sizes are
    nearly equal, and equal texts share a shard unless they exceed a shard's share.
    ``slot`` numbers the documents of a shard from 0 without gaps. Null texts count as
    empty and group with them; texts of any length count as a whole; doc_id is passed
    through, null or repeated; other columns are ignored; an empty table gives an empty
    result.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    spark = docs.sparkSession
    text = whole(F.col("text").cast("string"))
    count = F.count(F.lit(1))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.md5(text.cast("binary")).alias("digest"))
    rows = scratch.keep(rows.withColumn("rid", F.monotonically_increasing_id()), rows=count, bytes=F.sum("size"))
    share = -(-(rows.seen["bytes"] or 0) // shards)
    groups = rows.groupBy("digest").agg(F.sum("size").alias("bytes"), count.alias("c")).withColumn("over", F.col("bytes") > share)
    groups = scratch.keep(groups.withColumn("cls", F.when(~F.col("over"), _class(F.col("bytes")))), rows=count)

    # Groups that are divided, fewer than shards, in PARTS parts each; other sizes with their number.
    big = groups.where("over").select("digest", F.col("c"))
    part = F.pmod(F.xxhash64("rid"), F.lit(PARTS)).cast("int")
    parts = rows.join(F.broadcast(big.select("digest")), "digest", "left_semi").groupBy("digest", part.alias("part")).agg(F.sum("size").alias("bytes")).collect()
    classes = [(r[0], r[1]) for r in groups.where("not over").groupBy("cls").agg(count).collect()]
    runs = plan(classes + [(r["bytes"], 1) for r in parts], shards)

    # Whoever is of a size by rank: parts first, then whole groups.
    singles: dict[int, list] = {}
    for r in sorted(parts, key=lambda r: (r["digest"], r["part"])):
        singles.setdefault(r["bytes"], []).append((r["digest"], r["part"]))
    homes, spans = [], []
    for size, first, n, home in _rejoin(runs):
        own = singles.get(size, [])
        homes += [(*x, home) for x in own[first:first + n]]
        if first + n > len(own):
            spans.append((size, max(first - len(own), 0), first + n - len(own), home))
    homes = spark.createDataFrame(homes, "digest string, part int, shard int")  # at most shards * PARTS rows
    spans = spark.createDataFrame(spans, "cls long, lo long, hi long, shard int")

    digits = 1
    while 16 ** digits * 50_000 < groups.seen["rows"]:
        digits += 1
    g = groups.where("not over").withColumn("bucket", F.substring("digest", 1, digits))
    before = prefix_offsets(g.groupBy("cls", "bucket").agg(count.alias("n")), ["cls"], "bucket", "n", "before").select("cls", "bucket", "before")
    rank = F.row_number().over(Window.partitionBy("cls", "bucket").orderBy("digest")) - 1
    g = g.withColumn("at", rank).join(before, ["cls", "bucket"]).withColumn("at", F.col("at") + F.col("before"))
    # Spans are bounded as sizes are: a few for each, at most ``shards`` more.
    home = g.join(F.broadcast(spans), (g["cls"] == spans["cls"]) & (F.col("at") >= F.col("lo")) & (F.col("at") < F.col("hi"))).select("digest", "c", "shard")
    home = scratch.keep(home.unionByName(big.withColumn("shard", F.lit(None).cast("int"))))

    columns = ["doc_id", "size", "text_crc32", "rid", "shard"]
    placed = attach(rows, home, "digest", rows.seen["rows"])
    divided = placed.where("shard is null").drop("shard").withColumn("part", part).join(F.broadcast(homes), ["digest", "part"])
    placed = placed.where("shard is not null").select(columns).unionByName(divided.select(columns))
    placed = scratch.keep(placed.withColumn("bucket", F.pmod(F.xxhash64("rid"), F.lit(fan_out(rows.seen["rows"]))).cast("int")))
    offs = prefix_offsets(placed.groupBy("shard", "bucket").agg(count.alias("n")), ["shard"], "bucket", "n", "before")
    rank = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "rid")) - 1
    return (placed.withColumn("rank", rank).join(offs.select("shard", "bucket", "before"), ["shard", "bucket"])
            .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                    (F.col("before") + F.col("rank")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")))


def _rejoin(runs: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Runs of one size numbered through, also where the size came more than once."""
    out, at = [], {}
    for size, _, n, home in runs:
        out.append((size, at.get(size, 0), n, home))
        at[size] = at.get(size, 0) + n
    return out


def write_shards(docs: DataFrame, path: str, shards: int = 16, key: str = "doc_id") -> None:
    """Writes ``docs`` (unique non-null ``key``) as one folder per shard."""
    docs.join(shard(docs, shards).select(key, "shard"), key).write.partitionBy("shard").parquet(path)
