"""Tile selection: quotas per zone, entropy bins, caps. Every ranking has a total order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Ranges that tiles are dealt to by entropy, at most, and rows that one is meant to hold until then.
RANGES, PER_RANGE = 512, 50_000


def top_of(tiles: DataFrame, limits: DataFrame, group: list[str], per_range: int = PER_RANGE) -> DataFrame:
    """The first ``limit`` tiles (a column of ``limits``, one row per group) of each group by falling entropy, with their ``rank``.

    Tiles are dealt to ranges of (entropy, key) whose edges come from a sample by hash, at most ``RANGES``,
    so that equal entropies fall into several ranges, too. Sizes of the ranges tell where
    each group is cut; only ranges before the cut are read again, and ranked each for itself.
    """
    key = F.struct((-F.col("entropy")).alias("e"), F.col("tile_key").alias("k"))
    n = tiles.count()
    ranges = min(RANGES, -(-n // per_range))
    rows = tiles.withColumn("__b", F.lit(0))
    if ranges > 1:
        # Some 32 keys of the sample per range: RANGES * 32 keys, whatever the number of tiles.
        some = tiles.where(F.pmod(F.xxhash64("tile_key"), F.lit(max(1, n // (ranges * 32)))) == 0).select(key.alias("x"))
        edges = some.orderBy("x").agg(F.array_sort(F.collect_list("x")).alias("x")).select(F.expr("filter(x, (v, i) -> i % 32 = 31)").alias("__edges"))
        rows = tiles.join(F.broadcast(edges)).withColumn("__b", F.size(F.filter("__edges", lambda v: v < key))).drop("__edges")  # one row
    sizes = rows.groupBy(*group, "__b").agg(F.count("*").alias("n"))
    # A window over one row per range.
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*group).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = sizes.withColumn("__before", before).join(limits.select(*group, F.col("limit").alias("__limit")), group).where("__before < __limit").drop("n")
    w = Window.partitionBy(*group, "__b").orderBy(F.desc("entropy"), "tile_key")
    r = rows.join(cut, [*group, "__b"]).withColumn("rank", (F.row_number().over(w) + F.col("__before")).cast("int"))
    return r.where("rank <= __limit").select(*tiles.columns, "rank")


def top_per_zone(tiles: DataFrame, per_zone: int) -> DataFrame:
    """Tiles of highest entropy in each zone, a fixed number of them."""
    return top_of(tiles, tiles.select("zone").distinct().withColumn("limit", F.lit(per_zone)), ["zone"])


def equal_share(tiles: DataFrame, max_tiles: int) -> DataFrame:
    """The same number per zone: ``max_tiles`` over the number of zones."""
    zones = tiles.select("zone").distinct()
    many = zones.agg(F.count("zone").alias("zones"))
    return top_of(tiles, zones.join(F.broadcast(many)).select("zone", F.expr(f"{max_tiles} div zones").alias("limit")), ["zone"])  # one row


def proportional_share(tiles: DataFrame, max_tiles: int) -> DataFrame:
    """A number per zone in proportion to its tiles, rounded down."""
    zones = tiles.groupBy("zone").agg(F.count("*").alias("nz"))
    every = zones.agg(F.sum("nz").alias("all"))
    return top_of(tiles, zones.join(F.broadcast(every)).select("zone", F.expr(f"({max_tiles} * nz) div all").alias("limit")), ["zone"])  # one row


def entropy_edges(tiles: DataFrame, bins: int) -> DataFrame:
    """Entropy quantiles of each zone, moved up by 1e-8 where they do not increase.

    Exact percentiles over counts of equal values: a zone's buffer holds its distinct
    entropies (16 bytes each; tiles of one class, the usual case, are one of them).
    """
    tiles = tiles.groupBy("zone", "entropy").agg(F.count("*").alias("n"))
    qs = F.percentile("entropy", F.array(*[F.lit(i / bins) for i in range(bins + 1)]), F.col("n"))
    fold = F.aggregate(F.col("q"), F.array().cast("array<double>"), lambda a, x: F.concat(a, F.array(
        F.when((F.size(a) > 0) & (x <= F.try_element_at(a, F.lit(-1))), F.try_element_at(a, F.lit(-1)) + 1e-8).otherwise(x))))
    return tiles.groupBy("zone").agg(qs.alias("q")).select("zone", fold.alias("edges"))


def assign_bins(tiles: DataFrame, edges: DataFrame, bins: int) -> DataFrame:
    """Bin of each tile: edges at or below its entropy, less one, capped."""
    below = F.size(F.filter("edges", lambda e: e <= F.col("entropy")))
    return tiles.join(edges, "zone").withColumn("bin", F.least(F.lit(bins - 1), below - 1)).drop("edges")


def bin_targets(binned: DataFrame, quota: int | None, bins: int, low_share: float = 0.3) -> DataFrame:
    """``zone, bin, size, q, target, take``: the zone's quota over its bins, clipped by their sizes."""
    grid = binned.select("zone").distinct().join(binned.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")))
    n = binned.groupBy("zone", "bin").agg(F.count("*").alias("size"))
    g = grid.join(n, ["zone", "bin"], "left").withColumn("size", F.coalesce("size", F.lit(0)))
    all_ = F.sum("size").over(Window.partitionBy("zone"))
    g = g.withColumn("q", F.least(F.lit(quota), all_) if quota is not None else all_)
    if bins == 2:
        low = F.bround(F.col("q") * low_share).cast("long")
        target = F.when(F.col("bin") == 0, low).otherwise(F.col("q") - low)
    else:
        base = F.expr(f"q div {bins}")
        target = base + F.when(F.col("bin") == 0, F.col("q") - base * bins).otherwise(0)
    return g.withColumn("target", target).withColumn("take", F.least("target", "size"))


def backfill(targets: DataFrame, rare: DataFrame | None = None, bonus: float = 0.5) -> DataFrame:
    """Leftover quota into bins with room, by room times (1 + bonus where ``rare`` zone, bin); largest remainder."""
    zone = Window.partitionBy("zone")
    t = targets.withColumn("left", F.col("q") - F.sum("take").over(zone)).withColumn("room", F.col("size") - F.col("take"))
    if rare is not None:
        t = t.join(rare.select("zone", "bin").distinct().withColumn("rare", F.lit(True)), ["zone", "bin"], "left")
    weight = F.col("room").cast("double") * (1 + (F.when(F.col("rare"), bonus).otherwise(0.0) if rare is not None else F.lit(0.0)))
    t = t.withColumn("w", weight).withColumn("ws", F.sum("w").over(zone))
    t = t.withColumn("share", F.when(F.col("ws") > 0, F.col("w") / F.col("ws") * F.col("left")).otherwise(0.0))
    t = t.withColumn("whole", F.floor("share")).withColumn("rem", F.when(F.col("ws") > 0, F.col("left") - F.sum("whole").over(zone)).otherwise(0))
    rank = F.row_number().over(zone.orderBy(F.desc(F.col("share") - F.col("whole")), "bin"))
    more = F.col("whole") + F.when(F.col("rank") <= F.col("rem"), 1).otherwise(0)
    return (t.withColumn("rank", rank).withColumn("take", F.col("take") + F.least(more, F.col("room")))
            .select("zone", "bin", "size", "q", "target", "take"))


def low_share_limits(takes: DataFrame, floor: float = 0.2, cap: float = 0.4) -> DataFrame:
    """For two bins: raise the low bin to its floor by what bin 1's room allows, then cut it to its cap.

    The cap step may raise bin 1 past its size, as the selection that follows under-fills then.
    """
    z = takes.groupBy("zone").agg(F.max("q").alias("q"), *[F.max(F.when(F.col("bin") == b, F.col(c))).alias(f"{c}{b}") for b in (0, 1) for c in ("take", "size")])
    need = F.ceil(F.col("q") * floor) - F.col("take0")
    up = F.when((F.col("q") > 0) & (F.col("take0") / F.col("q") < floor), F.greatest(F.lit(0), F.least(need, F.greatest(F.lit(0), F.col("size1") - F.col("take1"))))).otherwise(0)
    z = z.withColumn("up", up).withColumn("take0", F.col("take0") + F.col("up")).withColumn("take1", F.col("take1") - F.col("up"))
    over = F.col("take0") / F.col("q")
    down = F.when((F.col("q") > 0) & (over > cap), F.greatest(F.lit(0), F.least(F.floor(F.col("q") * (over - cap)), F.col("take0")))).otherwise(0)
    z = z.withColumn("down", down)
    return z.select("zone", (F.col("take0") - F.col("down")).cast("long").alias("take0"), (F.col("take1") + F.col("down")).cast("long").alias("take1"))


def take_from_bins(binned: DataFrame, takes: DataFrame) -> DataFrame:
    """The tiles of highest entropy of each zone and bin, ``take`` of them."""
    return top_of(binned, takes.select("zone", "bin", F.col("take").alias("limit")), ["zone", "bin"])


def global_cap(tiles: DataFrame, n: int) -> DataFrame:
    """The ``n`` tiles of highest entropy."""
    return tiles.orderBy(F.desc("entropy"), "tile_key").limit(n)


def top_percent(tiles: DataFrame, percent: int, n: int) -> DataFrame:
    """The top ``percent`` of tiles by entropy, at most ``n`` of them. The number of rows is
    one grouped count; the cut is an ordered limit."""
    keep = tiles.count() * percent // 100
    return tiles.orderBy(F.desc("entropy"), "tile_key").limit(min(keep, n))
