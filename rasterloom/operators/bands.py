"""Band mathematics on ``bands`` arrays, and statistics per band.

Statistics use one aggregate expression per band instead of exploding the array, so a
tile with 64 bands keeps one row per pixel.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written

NODATA = -32768.0


def all_nodata(bands: str = "bands", nodata: float = NODATA) -> Column:
    return F.forall(bands, lambda x: x == nodata)


def scale_valid(bands: str = "bands", factor: float = 10000.0, nodata: float = NODATA) -> Column:
    """Values over a factor; the sentinel stays."""
    return F.transform(bands, lambda x: F.when(x == nodata, x).otherwise(x / factor))


def rescale(bands: str = "bands", factor: float = 32768.0) -> Column:
    return F.transform(bands, lambda x: x / factor)


def fill_zero(bands: str = "bands", nodata: float = NODATA) -> Column:
    """Nodata becomes 0; a pixel whose bands are all 255 becomes all 0."""
    return F.when(F.forall(bands, lambda x: x == 255), F.transform(bands, lambda x: F.lit(0.0))).otherwise(
        F.transform(bands, lambda x: F.when(x == nodata, 0.0).otherwise(x)))


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def channel_stats(pixels: DataFrame, n_bands: int, nodata: float = NODATA) -> DataFrame:
    """``band, n_valid, sum, sumsq, mean, std`` over finite values that are not nodata;
    mean 0 and deviation 1 where a band has none."""
    aggs = []
    for i in range(n_bands):
        x = F.get("bands", F.lit(i)).cast("double")
        ok = finite(x) & (x != nodata)
        aggs.append(F.struct(F.lit(i).alias("band"), F.count_if(ok).alias("n_valid"), F.coalesce(F.sum(F.when(ok, x)), F.lit(0.0)).alias("sum"),
                             F.coalesce(F.sum(F.when(ok, x * x)), F.lit(0.0)).alias("sumsq")))
    s = pixels.agg(F.array(*aggs).alias("s")).select(F.explode("s").alias("s")).select("s.*")
    mean = F.when(F.col("n_valid") > 0, F.col("sum") / F.col("n_valid")).otherwise(0.0)
    var = F.col("sumsq") / F.col("n_valid") - F.col("mean") * F.col("mean")
    return s.withColumn("mean", mean).withColumn("std", F.when(F.col("n_valid") > 0, F.sqrt(F.greatest(F.lit(0.0), var))).otherwise(1.0))


def normalise(pixels: DataFrame, stats: DataFrame, nodata: float = NODATA) -> DataFrame:
    """Invalid values become the band's mean, then (x - mean) / (std + 1e-6). One row of statistics is broadcast."""
    one = stats.agg(F.array_sort(F.collect_list(F.struct("band", "mean", "std"))).alias("__s"))
    z = F.zip_with("bands", "__s", lambda x, s: (F.when(finite(x) & (x != nodata), x).otherwise(s["mean"]) - s["mean"]) / (s["std"] + 1e-6))
    return pixels.join(F.broadcast(one)).withColumn("bands", z).drop("__s")


def select_bands(bands: str, start: int, n: int, drop: tuple[int, ...] = ()) -> Column:
    """``n`` bands from an offset, without those at ``drop`` (counted before the offset)."""
    kept = F.filter(bands, lambda x, i: ~i.isin(*drop)) if drop else F.col(bands)
    return F.slice(kept, start + 1, n)


def pick_bands(bands: str, index: list[int]) -> Column:
    return F.array(*[F.get(bands, F.lit(i)) for i in index])


def band_count(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("tile_key").agg(F.max(F.size("bands")).alias("n_bands"))


def valid_counts(pixels: DataFrame, n_bands: int, nodata: float = NODATA) -> DataFrame:
    """Valid pixels per tile and band."""
    n = F.array(*[F.count_if(F.get("bands", F.lit(i)) != nodata) for i in range(n_bands)])
    return pixels.groupBy("tile_key").agg(n.alias("n")).select("tile_key", F.posexplode("n").alias("band", "n_valid"))


def tile_means(pixels: DataFrame, n_bands: int) -> DataFrame:
    """Mean vector of each tile."""
    return pixels.groupBy("tile_key").agg(F.array(*[F.avg(F.get("bands", F.lit(i))) for i in range(n_bands)]).alias("vec"))


def input_stats(pixels: DataFrame) -> DataFrame:
    """Minimum, maximum, mean and deviation over all values of a tile, and the share of all-zero pixels."""
    fold = lambda f: F.aggregate("bands", F.lit(0.0), lambda a, x: a + f(x))
    t = pixels.groupBy("tile_key").agg(
        F.min(F.array_min("bands")).alias("lo"), F.max(F.array_max("bands")).alias("hi"), F.sum(F.size("bands")).alias("k"), F.sum(fold(lambda x: x)).alias("s"),
        F.sum(fold(lambda x: x * x)).alias("q"), F.avg(F.forall("bands", lambda x: x == 0).cast("int")).alias("zero_share"))
    mean = F.col("s") / F.col("k")
    return t.select("tile_key", "lo", "hi", mean.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), F.col("q") / F.col("k") - mean * mean)).alias("std"), "zero_share")


def fingerprint(pixels: DataFrame, first: int = 5) -> DataFrame:
    """Mean, deviation and order-independent checksum of band 0, and the first bands of pixel (0, 0)."""
    b0 = F.get("bands", F.lit(0))
    origin = (F.col("r") == 0) & (F.col("c") == 0)
    return pixels.groupBy("tile_key").agg(F.avg(b0).alias("mean"), F.stddev_pop(b0).alias("std"), F.bit_xor(F.xxhash64("r", "c", b0)).alias("checksum"),
                                          F.max(F.when(origin, F.slice("bands", 1, first))).alias("first"))


#: Values of a tile's band that one task sorts, at most; more are narrowed down first.
SORTED = 1_000_000
#: Ranges that each step of narrowing cuts a range into.
STEPS = 1024


def exact_percentiles(pixels: DataFrame, n_bands: int, shares: list[float], valid: Callable[[Column], Column], most: int = SORTED) -> DataFrame:
    """``tile_key, band, q``: percentiles of each band's valid values, between neighbours as by linear interpolation.

    The place of a percentile is known from the count. Bands of up to ``most`` values are sorted as they are. In a larger one
    the range of values is cut into ``STEPS`` parts and counted, and only the part that holds a wanted place is cut again, until it holds
    one value or few enough to be sorted. Each step is a grouped count, so no task holds a band.
    """
    values = pixels.select("tile_key", F.posexplode(F.array(*[F.get("bands", F.lit(i)).cast("double") for i in range(n_bands)])).alias("band", "x")).where(valid(F.col("x")))
    sizes = values.groupBy("tile_key", "band").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).withColumn("big", F.col("n") > most)
    key = ["tile_key", "band"]
    asked = F.array(*map(F.lit, shares))
    few = values.join(sizes.where("not big").select(*key), key).groupBy(*key).agg(F.percentile("x", asked).alias("q"))
    if sizes.where("big").isEmpty():
        return few
    # Two neighbouring places for each share; ``base`` values lie below the range lo..hi that holds the place.
    place = (F.col("n") - 1) * F.col("share")
    want = sizes.where("big").select(*key, "n", "lo", "hi", F.posexplode(asked).alias("i", "share"))
    want = want.select(*key, "i", "share", "n", F.explode(F.array_distinct(F.array(F.floor(place), F.ceil(place)))).alias("place"), "lo", "hi").withColumn("base", F.lit(0).cast("long")).withColumn("inside", F.col("n"))
    # A row per wanted place: bands beyond the bound, twice the shares. Tables cut the lineage between steps.
    want, done = written(want, "places"), None
    while True:
        ready = want.where(f"lo = hi or inside <= {most}")
        done = ready if done is None else done.unionByName(ready)
        want = want.where(f"lo < hi and inside > {most}")
        if want.isEmpty():
            break
        part = F.least(F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * STEPS), F.lit(STEPS - 1))
        j = values.join(want, key).where("x >= lo and x <= hi")
        counts = j.groupBy(*want.columns, part.alias("part")).agg(F.count("*").alias("c"), F.min("x").alias("a"), F.max("x").alias("b"))
        w = Window.partitionBy(*key, "i", "place").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # at most STEPS rows
        counts = counts.withColumn("below", F.col("base") + F.coalesce(F.sum("c").over(w), F.lit(0))).where("place >= below and place < below + c")
        nxt = counts.select(*key, "i", "share", "n", "place", F.col("a").alias("lo"), F.col("b").alias("hi"), F.col("below").alias("base"), F.col("c").alias("inside"))
        want = written(nxt, "places")
    found = written(done, "places")
    known = found.where("lo = hi").select(*key, "i", "share", "n", "place", F.col("lo").alias("v"))
    rest = found.where("lo < hi")
    inside = values.join(rest, key).where("x >= lo and x <= hi").groupBy(*rest.columns).agg(F.array_sort(F.collect_list("x")).alias("xs"))  # at most ``most`` values
    inside = inside.select(*key, "i", "share", "n", "place", F.element_at("xs", (F.col("place") - F.col("base") + 1).cast("int")).alias("v"))
    at = known.unionByName(inside).groupBy(*key, "i", "share", "n").agg(F.min_by("v", "place").alias("a"), F.max_by("v", "place").alias("b"))
    part = place - F.floor(place)
    at = at.withColumn("q", F.when(part == 0, F.col("a")).otherwise((1 - part) * F.col("a") + part * F.col("b")))
    return few.unionByName(at.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "q"))), lambda x: x["q"]).alias("q")))


def robust_stretch(pixels: DataFrame, n_bands: int, nodata: float = NODATA, low: float = 0.02, high: float = 0.98, most: int = SORTED) -> DataFrame:
    """Each band of a tile from its 2nd to its 98th percentile onto 0..1. In a band without
    spread valid pixels are 1; nodata and values that are not finite become 0 everywhere."""
    x = lambda i: F.get("bands", F.lit(i)).cast("double")
    valid = lambda v: F.coalesce(finite(v) & (v != nodata), F.lit(False))
    ok = lambda i: valid(x(i))
    own = pixels.columns
    # A count of pixels needs no cell, so it is far cheaper than the pixels; of large tiles there is one per ``most`` pixels at most.
    large = written(pixels.groupBy("tile_key").agg(F.count("*").alias("n")).where(F.col("n") > most).select("tile_key"), "large")
    some = not large.isEmpty()
    small = pixels.join(F.broadcast(large), "tile_key", "left_anti") if some else pixels
    tile = Window.partitionBy("tile_key")  # at most ``most`` rows
    t = small.select(*own, *[F.percentile(F.when(ok(i), x(i)), F.array(F.lit(low), F.lit(high))).over(tile).alias(f"q{i}") for i in range(n_bands)])
    if some:
        rest = pixels.join(F.broadcast(large), "tile_key", "left_semi")
        q = exact_percentiles(rest, n_bands, [low, high], valid, most)
        q = q.groupBy("tile_key").agg(*[F.max(F.when(F.col("band") == i, F.col("q"))).alias(f"q{i}") for i in range(n_bands)])
        t = t.unionByName(rest.join(F.broadcast(q), "tile_key", "left").select(t.columns))
    out = []
    for i in range(n_bands):
        lo, hi = F.get(f"q{i}", F.lit(0)), F.get(f"q{i}", F.lit(1))
        scaled = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (x(i) - lo) / F.nullif(hi - lo, F.lit(0.0))))
        out.append(F.when(~ok(i), 0.0).when(hi <= lo, 1.0).otherwise(scaled))
    return t.withColumn("bands", F.array(*out)).drop(*[f"q{i}" for i in range(n_bands)])


def stack(groups: list[DataFrame]) -> DataFrame:
    """Bands of several files per pixel, concatenated in the order given."""
    keys = ["tile_key", "r", "c"]
    out = groups[0].select(*keys, F.col("bands").alias("s0"))
    for i, g in enumerate(groups[1:], 1):
        out = out.join(g.select(*keys, F.col("bands").alias(f"s{i}")), keys)
    return out.select(*keys, F.concat(*[f"s{i}" for i in range(len(groups))]).alias("bands"))
