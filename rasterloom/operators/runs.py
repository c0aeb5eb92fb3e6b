"""Training runs: where a run stops, which saved artifact is the best."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def early_stop(log: DataFrame, patience: int = 5, save_every: int = 5, metric: str = "loss") -> DataFrame:
    """``run, stop``: the epoch at which each run (``run, epoch`` and the metric) ends early, else null.

    An epoch improves if its ``loss`` is lower (any other metric: higher) than at all epochs
    before. It is saved if it improves or is a multiple of ``save_every``; a run stops at the
    first epoch that is not saved and lies ``patience`` epochs or more past the last improvement.
    """
    w = Window.partitionBy("run").orderBy("epoch")
    value = F.col(metric) if metric == "loss" else -F.col(metric)
    m = log.withColumn("__v", value).withColumn("__best", F.min("__v").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    # Before the first epoch the best loss is infinite, any other metric -1.
    start = F.lit(float("inf") if metric == "loss" else 1.0)
    m = m.withColumn("__better", F.col("__v") < F.least(F.coalesce("__best", start), start))
    last = F.coalesce(F.last(F.when(F.col("__better"), F.col("epoch")), ignorenulls=True).over(w), F.lit(0))
    over = ~F.col("__better") & (F.col("epoch") % save_every != 0) & (F.col("epoch") - F.col("__last") >= patience)
    return m.withColumn("__last", last).groupBy("run").agg(F.min(F.when(over, F.col("epoch"))).alias("stop"))


_NUMBER = r"\d+\.\d+|\.\d+|\d+"


def _after(name: Column, word: str) -> Column:
    """What stands behind each ``word`` in a name, whatever its case."""
    return F.slice(F.split(F.lower(name), word), 2, 1 << 20)


def artifact_metric(name: Column) -> Column:
    """Metric in a file name: after ``f1``, else after ``iou`` (any case, then =, _, - or nothing), else its second number."""
    def first(word: str) -> Column:
        leading = F.transform(_after(name, word), lambda rest: F.regexp_extract(rest, f"^[-_=]?({_NUMBER})", 1))
        return F.try_element_at(F.filter(leading, lambda n: n != ""), F.lit(1))

    second = F.try_element_at(F.regexp_extract_all(name, F.lit(f"({_NUMBER})"), 1), F.lit(2))
    return F.coalesce(first("f1"), first("iou"), second).try_cast("double")


def _says_epoch(name: Column, epoch: Column) -> Column:
    """Whether a name has ``epoch``, a separator and exactly that number, or begins with the number and a separator."""
    named = F.exists(F.slice(F.split(name, "epoch"), 2, 1 << 20), lambda rest: (F.regexp_extract(rest, r"^[-_=](\d+)", 1) == epoch) & (F.regexp_extract(rest, r"^[-_=]\d+([A-Za-z_]?)", 1) == ""))
    return named | (F.regexp_extract(name, r"^(\d+)[-_,]", 1) == epoch)


def best_artifact(files: DataFrame, best: DataFrame | None = None) -> DataFrame:
    """``run, path``: the best artifact of each run of ``files`` (``run, path``).

    If ``best`` (``run, epoch``) tells the best epoch: the first path whose file name says
    ``epoch`` and that number, or begins with it, else the first whose first number it is.
    Otherwise the highest metric in the name, the first path of ties; without any metric,
    a run's only file.
    """
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    f = files.withColumn("__name", name).withColumn("__metric", artifact_metric(F.col("__name")))
    rank = F.lit(None).cast("int")
    if best is not None:
        f = f.join(best.select("run", F.col("epoch").cast("string").alias("__e")), "run", "left")
        said = _says_epoch(F.col("__name"), F.col("__e"))
        own = F.regexp_extract("__name", r"([0-9]+)", 1).try_cast("long") == F.col("__e").cast("long")
        rank = F.when(said, 1).when(own, 2)
    w = Window.partitionBy("run")
    order = w.orderBy(F.asc_nulls_last("__rank"), F.when(F.col("__rank").isNull(), F.col("__metric")).desc_nulls_last(), "path")
    f = f.withColumn("__rank", rank).withColumn("__n", F.count("*").over(w)).withColumn("__k", F.row_number().over(order))
    return f.where("__k = 1 and (__rank is not null or __metric is not null or __n = 1)").select("run", "path")
