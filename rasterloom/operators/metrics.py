"""Accuracy tables and losses from counts and per-pixel sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def confusion(pred: DataFrame, truth: str = "label", guess: str = "pred", valid: str = "label <> 255") -> DataFrame:
    """Pixels per truth and prediction: at most K x K groups after the map-side sums."""
    return pred.where(valid).groupBy(F.col(truth).alias("truth"), F.col(guess).alias("pred")).agg(F.count("*").alias("n"))


def row_normalised(conf: DataFrame) -> DataFrame:
    return conf.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("truth")))


def per_class(conf: DataFrame, classes: int) -> DataFrame:
    """``cls, tp, fp, fn, support`` for every class, zeros where it is absent."""
    dim = conf.sparkSession.range(classes).select(F.col("id").cast("int").alias("cls"))
    parts = conf.select(F.explode(F.array(
        F.struct(F.col("truth").alias("cls"), F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0).alias("tp"), F.lit(0).cast("long").alias("fp"),
                 F.when(F.col("truth") != F.col("pred"), F.col("n")).otherwise(0).alias("fn"), F.col("n").alias("support")),
        F.struct(F.col("pred").alias("cls"), F.lit(0).cast("long").alias("tp"), F.when(F.col("truth") != F.col("pred"), F.col("n")).otherwise(0).alias("fp"),
                 F.lit(0).cast("long").alias("fn"), F.lit(0).cast("long").alias("support")))).alias("x")).select("x.*")
    sums = parts.groupBy("cls").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "support")])
    return dim.join(sums, "cls", "left").select("cls", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("tp", "fp", "fn", "support")])


def scores(per: DataFrame, variant: str = "per_class_zero_div") -> DataFrame:
    """Precision, recall, f1 and iou of each class. ``eps_mean`` guards with 1e-9, ``per_class_zero_div`` gives 0 for 0 / 0."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    if variant == "eps_mean":
        p, r = tp / (tp + fp + 1e-9), tp / (tp + fn + 1e-9)
        return per.withColumn("precision", p).withColumn("recall", r).withColumn("f1", 2 * p * r / (p + r + 1e-9)).withColumn("iou", tp / (tp + fp + fn + 1e-9))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return (per.withColumn("precision", ratio(tp, tp + fp)).withColumn("recall", ratio(tp, tp + fn))
            .withColumn("f1", ratio(2 * tp, 2 * tp + fp + fn)).withColumn("iou", ratio(tp, tp + fp + fn)))


def mean_scores(per: DataFrame) -> DataFrame:
    """Named variants of mean iou and f1, and the accuracy, on one row."""
    e = scores(per, "eps_mean").select("cls", F.col("f1").alias("ef1"), F.col("iou").alias("eiou"))
    j = scores(per).join(e, "cls")
    union = F.col("tp") + F.col("fp") + F.col("fn")
    return j.agg(F.avg("eiou").alias("miou_eps_mean"), F.avg(F.when(union > 0, F.col("iou"))).alias("miou_skip_empty"),
                 F.avg("ef1").alias("f1_eps_mean"), F.avg(F.when(union > 0, F.col("f1"))).alias("f1_macro_present"),
                 (F.sum("tp") / F.sum("support")).alias("accuracy"))


def cross_entropy(probs: DataFrame, p: str = "p", weight: str = "weight") -> DataFrame:
    return probs.agg((F.sum(F.col(weight) * -F.ln(p)) / F.sum(weight)).alias("loss"))


def focal(probs: DataFrame, alpha: float = 0.25, gamma: float = 2.0, p: str = "p", weight: str = "weight") -> DataFrame:
    """Focal loss with a weight per pixel (as 0.4 on edges, which lowers them there)."""
    each = alpha * F.pow(1 - F.col(p), F.lit(gamma)) * -F.ln(p) * F.col(weight)
    return probs.agg((F.sum(each) / F.greatest(F.sum(weight), F.lit(1e-8))).alias("loss"))


def tversky(long_probs: DataFrame, classes: int, alpha: float = 0.7, beta: float = 0.3, smooth: float = 1e-6) -> DataFrame:
    """``cls, p, hit`` rows to one loss; an ignored label counts as the last class, as clamping makes it."""
    hit = F.col("hit").cast("double")
    s = long_probs.groupBy("cls").agg(F.sum(F.col("p") * hit).alias("tp"), F.sum(F.col("p") * (1 - hit)).alias("fp"), F.sum((1 - F.col("p")) * hit).alias("fn"))
    t = (F.col("tp") + smooth) / (F.col("tp") + alpha * F.col("fp") + beta * F.col("fn") + smooth)
    return s.agg((1 - F.avg(t)).alias("loss"))


def boundary_dice(cells: DataFrame, smooth: float = 1e-6) -> DataFrame:
    """``tile_key, cls, p, sd`` to one loss: of each tile and class, the overlap of the
    probabilities with the distances scaled to 0..1, over the sums of their squares; tiles
    averaged within classes, then classes."""
    w = Window.partitionBy("tile_key", "cls")
    low = F.min("sd").over(w)
    d = cells.withColumn("d", (F.col("sd") - low) / (F.max("sd").over(w) - low + 1e-8))
    t = d.groupBy("tile_key", "cls").agg(F.sum(F.col("p") * F.col("d")).alias("i"), F.sum(F.col("p") * F.col("p")).alias("pp"), F.sum(F.col("d") * F.col("d")).alias("dd"))
    loss = 1 - 2 * F.col("i") / (F.col("pp") + F.col("dd") + smooth)
    return t.groupBy("cls").agg(F.avg(loss).alias("loss")).agg(F.avg("loss").alias("loss"))


def combined_loss(focal_loss: DataFrame, tversky_loss: DataFrame, boundary_loss: DataFrame | None = None, boundary_weight: float = 0.4) -> DataFrame:
    """Half of each of two losses (one row each), and a weighted third."""
    j = focal_loss.select(F.col("loss").alias("f")).join(F.broadcast(tversky_loss.select(F.col("loss").alias("t"))))  # one row each
    total = 0.5 * F.col("f") + 0.5 * F.col("t")
    if boundary_loss is not None:
        j = j.join(F.broadcast(boundary_loss.select(F.col("loss").alias("b"))))
        total = total + boundary_weight * F.col("b")
    return j.select(total.alias("loss"))
