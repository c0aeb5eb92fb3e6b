"""Window scoring: pluggable models, averaging, calibration, probabilities."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .grid import patches


def softmax(logits: str = "logits", temperature: float = 1.0) -> Column:
    e = F.transform(logits, lambda x: F.exp((x - F.array_max(logits)) / temperature))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))


def argmax(values: str) -> Column:
    """First position of the maximum."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def linear_scores(pixels: DataFrame, weights: list[list[float]], bias: list[float], out: str = "logits") -> DataFrame:
    """Logits of a linear model as column expressions; its weights are literals."""
    def one(w, b):
        terms = F.zip_with("bands", F.array(*map(F.lit, w)), lambda x, y: x * y)
        return F.aggregate(terms, F.lit(float(b)), lambda a, x: a + x)

    return pixels.withColumn(out, F.array(*[one(w, b) for w, b in zip(weights, bias)]))


def model_scores(pixels: DataFrame, model: Callable, out: str = "logits") -> DataFrame:
    """Logits of a model that takes a matrix of pixels by bands and returns pixels by classes."""
    import pandas as pd

    columns = [c for c in pixels.columns if c != "bands"]
    kinds = dict(pixels.dtypes)

    def run(frames):
        import numpy as np

        for f in frames:
            got = model(np.array(f["bands"].tolist())) if len(f) else []
            yield pd.DataFrame({**{c: f[c] for c in columns}, out: list(map(list, got))})

    return pixels.mapInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in columns) + f", {out} array<double>")


def average_logits(scores: DataFrame, classes: int, keys: list[str]) -> DataFrame:
    """Mean of the logits of all windows that cover a pixel, one aggregate per class."""
    return scores.groupBy(*keys).agg(F.array(*[F.avg(F.get("logits", F.lit(i))) for i in range(classes)]).alias("logits"))


def debias(scores: DataFrame, classes: int) -> DataFrame:
    """Subtracts the calibration vector: the mean of the tiles' mean logits (one row)."""
    tile = scores.groupBy("tile_key").agg(F.array(*[F.avg(F.get("logits", F.lit(i))) for i in range(classes)]).alias("m"))
    vec = tile.agg(F.array(*[F.avg(F.get("m", F.lit(i))) for i in range(classes)]).alias("bias"))
    return scores.join(F.broadcast(vec)).withColumn("logits", F.zip_with("logits", "bias", lambda x, b: x - b)).drop("bias")


_debias = debias


def zero_bias(scorer: Callable[[DataFrame], DataFrame], pixels: DataFrame, classes: int, n_bands: int) -> DataFrame:
    """One row ``bias``: the scorer's mean logits for an input of zeros on the cells of one tile."""
    one = pixels.agg(F.min("tile_key").alias("tile_key"))
    blank = pixels.join(F.broadcast(one), "tile_key", "left_semi").withColumn("bands", F.array_repeat(F.lit(0.0), n_bands))  # one row
    return scorer(blank).agg(F.array(*[F.avg(F.get("logits", F.lit(i))) for i in range(classes)]).alias("bias"))


def predict(pixels: DataFrame, scorer: Callable[[DataFrame], DataFrame], classes: int, n_bands: int, size: int = 256, stride: int = 128,
            temperature: float = 1.0, debias: str | DataFrame | None = None) -> DataFrame:
    """``tile_key, r, c, pred, probs``: scoring of tiles in overlapping windows.

    ``scorer`` adds ``logits`` to cells (``tile_key, r, c, bands`` and the window's ``pi, pj``).
    ``debias`` is taken off them: ``"zero"``, the logits of an empty input, ``"tiles"``, the
    mean of the tiles' mean logits, or a row with ``bias``. The windows' logits of a cell are
    averaged, divided by the temperature (a positive one) and made probabilities.
    """
    scores = scorer(patches(pixels, size, stride, "pad_edge"))
    if isinstance(debias, DataFrame) or debias == "zero":
        bias = zero_bias(scorer, pixels, classes, n_bands) if debias == "zero" else debias
        scores = scores.join(F.broadcast(bias.select("bias"))).withColumn("logits", F.zip_with("logits", "bias", lambda x, b: x - b))  # one row
    elif debias == "tiles":
        scores = _debias(scores, classes)
    mean = average_logits(scores, classes, ["tile_key", "r", "c"])
    probs = softmax("logits", temperature if temperature > 0 else 1.0)
    return mean.select("tile_key", "r", "c", argmax("logits").alias("pred"), probs.alias("probs"))


def mask_ignored(pred: str, label: str, ignore: int = 255) -> Column:
    """Prediction, 255 where the label is ignored or nothing was predicted."""
    return F.when(F.col(label) == ignore, ignore).otherwise(F.coalesce(F.col(pred), F.lit(ignore))).cast("int")
