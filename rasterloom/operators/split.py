"""Zone-stratified splits with exact allocation, caps, and seeded order.

Random choices are an order by ``md5(seed:key)``: tile membership differs from any other
generator's shuffle, all counts agree. Global ranks are a rank within a hash bucket plus
the sizes of the buckets before it, so no window spans all rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPLITS = ("train", "val", "test")
#: Different sets of classes that a multilabel split deals with, at most: all of 16 classes.
LABEL_SETS = 65_536


def seeded(key: str = "tile_key", seed: int = 42) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), key))


def allocate(zones: DataFrame, ratios: tuple[float, float, float] = (1.0, 0.1, 0.1), total: float | None = None) -> DataFrame:
    """``zone, split, n``: items of each zone (``zone, items``) over the splits with a ratio.

    Floors first; then, where there are as many items as splits, empty splits get one each
    by ratio while the remainder lasts; what is left goes by largest fraction. ``total``
    is the exact sum of the ratios, given as a literal so that no addition rounds it.
    """
    pos = [(i, name, r) for i, (name, r) in enumerate(zip(SPLITS, ratios)) if r > 0]
    if not pos:
        return zones.select("zone", F.lit("train").alias("split"), F.col("items").alias("n"))
    total = total if total is not None else float(f"{sum(r for _, _, r in pos):.12g}")
    dim = F.explode(F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(n).alias("split"), F.lit(float(r)).alias("ratio")) for i, n, r in pos]))
    z = zones.select("zone", "items", dim.alias("s")).select("zone", "items", "s.*")
    w = Window.partitionBy("zone")
    z = z.withColumn("raw", F.col("items") * F.col("ratio") / total).withColumn("low", F.floor("raw")).withColumn("frac", F.col("raw") - F.col("low"))
    z = z.withColumn("remain", F.col("items") - F.sum("low").over(w)).withColumn("zero", F.col("low") == 0)
    z = z.withColumn("zrank", F.row_number().over(w.orderBy(F.desc("zero"), F.desc("ratio"), "ord")))
    give = F.col("zero") & (F.col("items") >= len(pos)) & (F.col("zrank") <= F.col("remain"))
    z = z.withColumn("give", give.cast("int"))
    z = z.withColumn("rest", F.col("remain") - F.sum("give").over(w)).withColumn("frank", F.row_number().over(w.orderBy(F.desc("frac"), "ord")))
    rounds = F.expr(f"rest div {len(pos)}") + F.when(F.col("frank") <= F.col("rest") % len(pos), 1).otherwise(0)
    return z.select("zone", "split", (F.col("low") + F.col("give") + rounds).cast("long").alias("n"))


def stratified(tiles: DataFrame, ratios: tuple[float, float, float] = (1.0, 0.1, 0.1), seed: int = 42) -> DataFrame:
    """``tile_key, zone, split``: each zone's tiles in seeded order, cut at its allocation."""
    n = allocate(tiles.groupBy("zone").agg(F.count("*").alias("items")), ratios)
    cut = n.groupBy("zone").agg(*[F.coalesce(F.sum(F.when(F.col("split").isin(*SPLITS[:k + 1]), F.col("n"))), F.lit(0)).alias(f"upto_{k}") for k in (0, 1)])
    t = global_rank(tiles, seeded(seed=seed), "k", "zone").join(F.broadcast(cut), "zone")  # one row per zone
    split = F.when(F.col("k") <= F.col("upto_0"), "train").when(F.col("k") <= F.col("upto_1"), "val").otherwise("test")
    return t.select("tile_key", "zone", split.alias("split"))


def round_robin(tiles: DataFrame, n: int, order: Column | None = None, ordinal: str = "tile_id", by_name: bool = False) -> DataFrame:
    """``n`` tiles, one zone after the other: the first of each zone, then the second, and so on.

    Zones come in the order of their first tile, also with fewer places than zones, unless
    ``by_name`` asks for the zones' names then (as the cap on training tiles does).
    """
    order = seeded() if order is None else order
    first = tiles.groupBy("zone").agg(F.min(ordinal).alias("zone_ord"))
    ranked = global_rank(tiles, order, "rank", "zone").withColumn("rank", F.col("rank").cast("int"))
    t = ranked.join(F.broadcast(first), "zone")  # one row per zone
    place = F.col("zone_ord")
    if by_name:
        t = t.join(F.broadcast(tiles.agg(F.count_distinct("zone").alias("zones"))))  # one row
        place = F.when(F.col("zones") > n, F.lit(0)).otherwise(place)
    return t.orderBy("rank", place, "zone").limit(n).select("tile_key", "zone", "rank")


def global_rank(rows: DataFrame, key: Column, out: str = "rank", *group: str, per_bucket: int = 50_000) -> DataFrame:
    """Rank by a hexadecimal hash ``key`` from 1, within ``group`` if given: sizes of the buckets of
    leading digits, and ranks within buckets. The digits grow with the rows, so that no window is larger."""
    digits, n = 1, rows.count()
    while 16 ** digits * per_bucket < n:
        digits += 1
    return _bucket_rank(rows.withColumn("__k", key), F.substring("__k", 1, digits), out, group)


def _bucket_rank(rows: DataFrame, bucket: Column, out: str, group: tuple[str, ...] = ()) -> DataFrame:
    r = rows.withColumn("__b", bucket)
    sizes = r.groupBy(*group, "__b").agg(F.count("*").alias("n"))
    # A window over one row per bucket.
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*group).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy(*group, "__b").orderBy("__k"))
    return (r.withColumn("__i", inside).join(sizes.withColumn("__before", before).drop("n"), [*group, "__b"])
            .withColumn(out, (F.col("__before") + F.col("__i")).cast("long")).drop("__k", "__b", "__i", "__before"))


def unstratified(tiles: DataFrame, ratios: tuple[float, float, float] = (1.0, 0.1, 0.1), seed: int = 42) -> DataFrame:
    """Half-even rounded shares of all tiles in seeded order."""
    denom = ratios[0] + ratios[1] + ratios[2]
    n = tiles.agg(F.count("*").alias("n"))
    t = global_rank(tiles, seeded(seed=seed)).join(F.broadcast(n))  # one row
    a, b = (F.bround(F.col("n") * r / denom) for r in ratios[:2])
    return t.select("tile_key", F.when(F.col("rank") <= a, "train").when(F.col("rank") <= a + b, "val").otherwise("test").alias("split"))


def uncovered_zones(splits: DataFrame, left: DataFrame | None = None) -> DataFrame:
    """Zone and split pairs without a tile (in ``left``, if given); empty if coverage holds."""
    grid = splits.select("zone").distinct().join(F.broadcast(splits.select("split").distinct()))  # a row per split
    return grid.join(splits if left is None else left, ["zone", "split"], "left_anti")


def evenly_spaced(rows: DataFrame, key: str, k: int, per_bucket: int = 50_000) -> DataFrame:
    """``k`` of n rows in key order, evenly spaced, with their ordinal from 0.

    Ranks come from buckets of leading characters, more of them until no bucket is large
    (or keys have no more), and the ordinals to pick are joined.
    """
    size = F.octet_length(key)
    n, longest = rows.agg(F.count("*"), F.coalesce(F.max(size), F.lit(0))).first()
    first = 1
    while first < longest and rows.groupBy(F.substring(key, 1, first)).count().where(F.col("count") > per_bucket).limit(1).count():
        first += 2
    ranked = _bucket_rank(rows.withColumn("__k", F.col(key)), F.substring("__k", 1, first), "rank")
    places = min(k, n)
    i = rows.sparkSession.range(places)
    picks = i.select((F.expr(f"id * {n - 1} div {k - 1}") if k > 1 else F.lit(0).cast("long")).alias("ordinal")).distinct()
    return ranked.withColumn("ordinal", F.col("rank") - 1).join(F.broadcast(picks), "ordinal").select(key, "ordinal")  # at most k rows


def rarest_class(hist: DataFrame) -> DataFrame:
    """Stratum of each tile: the class it has that is rarest over all tiles (ties: smallest class)."""
    total = hist.groupBy("cls").agg(F.sum("n").alias("all"))
    return hist.where("n > 0").join(total, "cls").groupBy("tile_key").agg(F.min_by("cls", F.struct("all", "cls")).alias("zone"))


def _spread_over(want: dict[int, list[float]], all_want: list[float], label: int | None, n: int) -> list[int]:
    """How many of ``n`` equal items each split gets, one by one to the split that wants the label most (ties: most
    items, then the first), and takes off ``all_want``; what every greedy step is sure to give goes at once."""
    need = want[label] if label is not None else all_want
    got = [0] * len(need)
    order = sorted(need, reverse=True)
    k = next((i for i in range(len(order), 0, -1) if sum(order[:i]) - i * order[i - 1] <= n), 1)
    level = (sum(order[:k]) - n) / k
    for j, d in enumerate(need):
        got[j] = max(0, math.floor(d - level - 3) + 1)
    while sum(got) < n:
        j = max(range(len(need)), key=lambda j: (need[j] - got[j], all_want[j] - got[j], -j))
        got[j] += 1
    return got


def allocate_sets(sets: dict[int, int], ratios: tuple[float, ...]) -> dict[int, list[int]]:
    """Items of each label set (a bit per label) over the splits: iterative stratification.

    The label with the fewest items left is served first; each of its items goes to the split
    that lacks most of it, and counts for all labels of its set. Items of one set are alike, so they are dealt
    together. Items without a label come last, to the split that lacks most items.
    """
    share = [r / sum(ratios) for r in ratios]
    labels = sorted({i for s in sets for i in range(s.bit_length()) if s >> i & 1})
    left = dict(sets)
    want = {i: [sum(n for s, n in sets.items() if s >> i & 1) * r for r in share] for i in labels}
    every = [sum(sets.values()) * r for r in share]
    out = {}
    while left:
        count = {i: c for i in labels if (c := sum(n for s, n in left.items() if s >> i & 1))}
        rare = min(count, key=lambda i: (count[i], i)) if count else None
        for s in sorted(s for s in left if rare is None or s >> rare & 1):
            got = _spread_over(want, every, rare, left.pop(s))
            out[s] = got
            for j, g in enumerate(got):
                every[j] -= g
                for i in labels:
                    if s >> i & 1:
                        want[i][j] -= g
    return out


def multilabel(tiles: DataFrame, ratios: tuple[float, float, float] = (1.0, 0.1, 0.1), seed: int = 42, classes: int = 13) -> DataFrame:
    """``tile_key, split`` of ``tile_key, labels`` (an array of classes below ``classes``), so that each class is shared by the ratios.

    Tiles count by their set of classes, of which there are at most ``LABEL_SETS`` (more are an error);
    only these counts come to the driver. A set's tiles lie in seeded order and are cut at its allocation.
    """
    if classes > 62:
        raise ValueError("at most 62 classes")
    bits = F.aggregate(F.array_distinct("labels"), F.lit(0).cast("long"), lambda a, x: a + F.call_function("shiftleft", F.lit(1).cast("long"), x.cast("int")))
    t = tiles.select("tile_key", F.coalesce(bits, F.lit(0).cast("long")).alias("set"))
    counts = t.groupBy("set").agg(F.count("*").alias("n")).limit(LABEL_SETS + 1).collect()
    if len(counts) > LABEL_SETS:
        raise ValueError(f"more than {LABEL_SETS} sets of classes")
    plan = allocate_sets({r["set"]: r["n"] for r in counts}, ratios)
    rows = [(s, *(sum(got[:k + 1]) for k in range(2))) for s, got in plan.items()]
    cut = tiles.sparkSession.createDataFrame(rows, "set long, upto_0 long, upto_1 long")
    r = global_rank(t, seeded(seed=seed), "k", "set").join(F.broadcast(cut), "set")  # a row per set
    return r.select("tile_key", F.when(F.col("k") <= F.col("upto_0"), "train").when(F.col("k") <= F.col("upto_1"), "val").otherwise("test").alias("split"))


def subsample(tiles: DataFrame, share: float, seed: int = 42) -> DataFrame:
    """int(n * share) tiles in seeded order."""
    n = tiles.agg(F.floor(F.count("*") * share).alias("n"))
    return global_rank(tiles, seeded(seed=seed)).join(F.broadcast(n)).where("rank <= n").select("tile_key")  # one row


def append_new(splits: DataFrame, keys: DataFrame, split: str) -> DataFrame:
    """``splits`` and the ``keys`` that ``split`` does not have yet, as its members."""
    new = keys.distinct().join(splits.where(F.col("split") == split), "tile_key", "left_anti")
    return splits.unionByName(new.select("tile_key", F.lit(split).alias("split")))
