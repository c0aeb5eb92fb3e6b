"""Class histograms and what is derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

IGNORE, CLASSES = 255, 13


def class_histogram(labels: DataFrame, keys: list[str], label: str = "label", ignore: int = IGNORE) -> DataFrame:
    """Pixels per key and class without the ignore class: partial and final hash aggregation."""
    return labels.where(F.col(label) != ignore).groupBy(*keys, F.col(label).alias("cls")).agg(F.count("*").alias("n"))


def dense_histogram(hist: DataFrame, keys: list[str], classes: int = CLASSES) -> DataFrame:
    """One vector of counts per key, zeros where a class is absent."""
    return hist.groupBy(*keys).agg(F.array(*[F.sum(F.when(F.col("cls") == i, F.col("n")).otherwise(0)) for i in range(classes)]).alias("vec"))


def entropy_nat(hist: DataFrame, keys: list[str]) -> DataFrame:
    """Natural-log entropy over the nonzero entries of a histogram."""
    t = F.sum("n").over(Window.partitionBy(*keys)).cast("double")
    p = F.col("n") / F.col("t")
    return hist.where("n > 0").withColumn("t", t).groupBy(*keys).agg((-F.sum(p * F.ln(p)) + 0.0).alias("entropy"))


def entropy_bits_smooth(labels: DataFrame, keys: list[str], classes: int = CLASSES) -> DataFrame:
    """Base-2 entropy with 1e-6 added to every bin; a value past the classes, as 255, widens the bins up to it."""
    n = labels.groupBy(*keys, "label").agg(F.count("*").alias("n"))
    t = n.groupBy(*keys).agg(F.sum("n").alias("s"), F.max("label").alias("m"), F.count("*").alias("k"), F.collect_list("n").alias("ns"))
    bins = F.greatest(F.lit(classes), F.col("m") + 1)
    total = F.col("s") + bins * 1e-6
    part = lambda x: -(x / total) * F.log2(x / total)
    full = F.aggregate(F.array_sort("ns"), F.lit(0.0), lambda a, x: a + part(x + 1e-6))
    return t.select(*keys, (full + (bins - F.col("k")) * part(F.lit(1e-6))).alias("entropy"))


def entropy_bits_eps(hist: DataFrame, keys: list[str]) -> DataFrame:
    """Base-2 entropy with 1e-8 inside the logarithm and under the total."""
    t = F.sum("n").over(Window.partitionBy(*keys)) + 1e-8
    p = F.col("n") / F.col("t")
    return hist.withColumn("t", t).groupBy(*keys).agg((-F.sum(p * F.log2(p + 1e-8)) + 0.0).alias("entropy"))


def presence(hist: DataFrame, keys: list[str], classes: int = CLASSES) -> DataFrame:
    """0/1 per class."""
    return hist.groupBy(*keys).agg(F.array(*[F.max(F.when((F.col("cls") == i) & (F.col("n") > 0), 1).otherwise(0)) for i in range(classes)]).alias("present"))


def class_totals(selected: DataFrame, hist: DataFrame, classes: int = CLASSES, ignore: int = IGNORE) -> DataFrame:
    """Pixels per class over the selected keys; classes without pixels count 0, codes out of range are dropped."""
    dim = selected.sparkSession.range(classes).select(F.col("id").cast("int").alias("cls"))
    n = (hist.join(selected.select("tile_key").distinct(), "tile_key", "left_semi")
         .where((F.col("cls") != ignore) & F.col("cls").between(0, classes - 1)).groupBy("cls").agg(F.sum("n").alias("n")))
    return dim.join(n, "cls", "left").select("cls", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def coverage(selected: DataFrame, hist: DataFrame) -> DataFrame:
    """Selected keys with and without a cached histogram."""
    known = hist.select("tile_key").distinct().withColumn("hit", F.lit(True))
    return selected.join(known, "tile_key", "left").agg(F.count_if(F.col("hit").isNotNull()).alias("covered"), F.count_if(F.col("hit").isNull()).alias("missing"))


def clean_histogram(raw: DataFrame, ignore: int = IGNORE) -> DataFrame:
    """``tile_key, hist map<string,string>`` to long form: whole-number keys, ignore dropped, equal keys merged."""
    e = raw.select("tile_key", F.explode("hist").alias("k", "v")).select("tile_key", F.col("k").try_cast("int").alias("cls"), F.col("v").try_cast("long").alias("n"))
    return e.where(f"cls is not null and n is not null and cls <> {ignore}").groupBy("tile_key", "cls").agg(F.sum("n").alias("n"))


def tile_metrics(hist: DataFrame, background: int = 0, water: int = 10, wetland: range = range(1, 13), with_water: bool = True) -> DataFrame:
    """Fractions of background, water and wetland, and the entropy, of each tile."""
    t = F.sum("n").over(Window.partitionBy("tile_key")).cast("double")
    wet = [c for c in wetland if with_water or c != water]
    share = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)) / F.sum("n")
    p = F.col("n") / F.col("t")
    return hist.withColumn("t", t).groupBy("tile_key", "zone").agg(
        F.sum("n").alias("total"), share(F.col("cls") == background).alias("bg_frac"), share(F.col("cls") == water).alias("water_frac"),
        share(F.col("cls").isin(wet)).alias("wet_frac"), (-F.sum(p * F.ln(p)) + 0.0).alias("entropy"))


def tile_reason(mode: str = "filtered", bg_max: float = 0.9, water_max: float = 0.5, wet_min: float = 0.0, wet_max: float = 1.0, entropy_min: float = 0.0) -> Column:
    """Why a tile is rejected, null if it is accepted; the water cap comes before the mode."""
    bg = F.col("bg_frac")
    r = F.when(F.col("water_frac") > water_max, "water_gt_threshold")
    if mode == "simple":
        return r.when((bg >= 1) | (F.abs(bg - 1) <= 1e-8 + 1e-5), "all_background")
    return (r.when(bg > bg_max, "background_gt_threshold").when(F.col("wet_frac") < wet_min, "wetland_lt_min")
            .when(F.col("wet_frac") > wet_max, "wetland_gt_max").when(F.col("entropy") < entropy_min, "entropy_lt_min"))
