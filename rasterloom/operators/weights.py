"""Class weights, sample weights, weighted sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-12


def _mean_one(w: DataFrame) -> DataFrame:
    """Weights over their mean; a window over one row per class."""
    return w.withColumn("weight", F.col("w") / (F.avg("w").over(Window.partitionBy()) + EPS)).drop("w")


def inverse_frequency(counts: DataFrame) -> DataFrame:
    """A class without pixels swamps the mean, as total / 1e-12 does."""
    every = Window.partitionBy()
    return _mean_one(counts.withColumn("w", F.sum("n").over(every) / (F.col("n") + EPS) / F.count("*").over(every)))


def median_frequency(counts: DataFrame) -> DataFrame:
    """Classes without pixels weigh 0 and count in the mean."""
    every = Window.partitionBy()
    c = counts.withColumn("freq", F.col("n") / (F.sum("n").over(every) + EPS))
    med = F.median(F.when(F.col("freq") > 0, F.col("freq"))).over(every)
    c = c.withColumn("med", med)
    w = F.when(F.col("med").isNull(), 1.0).when(F.col("freq") > 0, F.col("med") / (F.col("freq") + EPS)).otherwise(0.0)
    scaled = _mean_one(c.withColumn("w", w).drop("freq"))
    return scaled.withColumn("weight", F.when(F.col("med").isNull(), 1.0).otherwise(F.col("weight"))).drop("med")


def effective_number(counts: DataFrame, beta: float = 0.9999, mode: str = "reference") -> DataFrame:
    """``reference`` inverts (1 - beta) / (1 - beta ** n) once more, so frequent classes weigh more;
    ``corrected`` uses it as the weight."""
    eff = (1.0 - beta) / (1.0 - F.pow(F.lit(beta), F.col("n").cast("double") + EPS))
    return _mean_one(counts.withColumn("w", eff if mode == "corrected" else 1.0 / (eff + EPS)))


def legacy(counts: DataFrame) -> DataFrame:
    """1 / (n + 1e-6), scaled to add up to the number of classes."""
    every = Window.partitionBy()
    w = counts.withColumn("w", 1.0 / (F.col("n") + 1e-6))
    return w.withColumn("weight", F.col("w") * F.count("*").over(every) / F.sum("w").over(every)).drop("w")


def pixel_weights(pixels: DataFrame, weights: DataFrame, label: str = "label") -> DataFrame:
    """Weight of each pixel's class; a class without one weighs 1. One row per class is broadcast."""
    w = weights.select(F.col("cls").alias(label), "weight")
    return pixels.join(F.broadcast(w), label, "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))


def sample_weights(hist: DataFrame, weights: DataFrame) -> DataFrame:
    """Mean class weight of a tile's valid pixels, and its score: weight ** 1.5 over their sum."""
    w = hist.join(F.broadcast(weights), "cls", "left")
    t = w.groupBy("tile_key").agg(F.coalesce(F.sum(F.col("n") * F.coalesce("weight", F.lit(1.0))) / F.sum("n"), F.lit(0.0)).alias("weight"))
    total = t.agg(F.sum(F.pow("weight", F.lit(1.5))).alias("total"))
    return t.join(F.broadcast(total)).select("tile_key", "weight", (F.pow("weight", F.lit(1.5)) / F.col("total")).alias("score"))  # one row


def cumulative(scores: DataFrame, per_bucket: int = 50_000) -> DataFrame:
    """``tile_key, lo, hi``: intervals of cumulated whole-number ``mass`` in key-hash order, by sums of
    buckets, whose number grows with the rows, and sums within buckets."""
    digits, n = 1, scores.count()
    while 16 ** digits * per_bucket < n:
        digits += 1
    s = scores.withColumn("h", F.md5("tile_key")).withColumn("b", F.substring("h", 1, digits))
    sums = s.groupBy("b").agg(F.sum("mass").alias("m"))
    before = F.coalesce(F.sum("m").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # 16 ** digits rows
    inside = F.sum("mass").over(Window.partitionBy("b").orderBy("h").rowsBetween(Window.unboundedPreceding, 0))
    s = s.withColumn("in", inside).join(sums.withColumn("before", before).drop("m"), "b")
    hi = F.col("before") + F.col("in")
    return s.select("tile_key", (hi - F.col("mass")).alias("lo"), hi.alias("hi"))


def draw(intervals: DataFrame, draws: DataFrame, total: int, bins: int = 256) -> DataFrame:
    """Interval that holds each draw's ``u``: equal bins first, then the range. No inequality-only join."""
    width = max(1, -(-total // bins))
    i = intervals.where("hi > lo").withColumn("bin", F.explode(F.sequence(F.expr(f"lo div {width}"), F.expr(f"(hi - 1) div {width}"))))
    d = draws.withColumn("bin", F.expr(f"u div {width}"))
    return d.join(i, "bin").where((F.col("lo") <= F.col("u")) & (F.col("u") < F.col("hi"))).drop("bin", "lo", "hi")
