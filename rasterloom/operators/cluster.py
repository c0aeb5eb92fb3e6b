"""Segments, medoids, clusters, spatial intersection."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def segment_majority(pixels: DataFrame) -> DataFrame:
    """Most frequent valid label of each segment, the smallest of ties, and the segment's centre."""
    n = pixels.where("label <> 255").groupBy("tile_key", "segment_id", "label").agg(F.count("*").alias("n"))
    top = n.groupBy("tile_key", "segment_id").agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("major"))
    mid = pixels.groupBy("tile_key", "segment_id").agg(F.floor(F.avg("r")).cast("int").alias("cr"), F.floor(F.avg("c")).cast("int").alias("cc"))
    return mid.join(top, ["tile_key", "segment_id"], "left")


def relabel(pixels: DataFrame) -> DataFrame:
    """``tile_key, r, c, label``: each pixel with the majority label of its segment, 255 if that has none."""
    major = segment_majority(pixels).select("tile_key", "segment_id", "major")
    j = pixels.select("tile_key", "segment_id", "r", "c").join(major, ["tile_key", "segment_id"])
    return j.select("tile_key", "r", "c", F.coalesce("major", F.lit(255)).cast("int").alias("label"))


def last_mask(masks: DataFrame, value: str = "segment_id", order: str = "ord") -> DataFrame:
    """Value of the last mask that covers a pixel."""
    return masks.groupBy("tile_key", "r", "c").agg(F.max_by(value, F.struct(order, value)).alias(value))


def medoids(tiles: DataFrame, cluster: str = "cluster", vec: str = "vec", dims: int = 64) -> DataFrame:
    """Member of each cluster with the least sum of squared distances to the others: the one
    nearest the centroid, without any pairs. Noise (-1) is dropped."""
    t = tiles.where(F.col(cluster) != -1)
    c = t.groupBy(cluster).agg(F.array(*[F.avg(F.get(vec, F.lit(i))) for i in range(dims)]).alias("mid"))
    diff = F.zip_with(vec, "mid", lambda x, y: (x - y) * (x - y))
    d = t.join(F.broadcast(c), cluster).withColumn("d", F.round(F.aggregate(diff, F.lit(0.0), lambda a, x: a + x), 9))  # one row per cluster
    w = Window.partitionBy(cluster).orderBy("d", "tile_key")
    return d.withColumn("k", F.row_number().over(w)).where("k = 1").select(cluster, "tile_key")


def kmeans(rows: DataFrame, k: int, features: str = "bands", out: str = "cluster", seed: int = 42) -> DataFrame:
    """Cluster of each row by distributed k-means on an array column."""
    v = rows.withColumn("__f", array_to_vector(features))
    model = KMeans(k=k, seed=seed, featuresCol="__f", predictionCol=out, maxIter=10).fit(v)
    return model.transform(v).drop("__f")


def reduce_dimensions(rows: DataFrame, k: int, features: str = "bands", out: str = "reduced") -> DataFrame:
    """Principal components of an array column."""
    v = rows.withColumn("__f", array_to_vector(features))
    return PCA(k=k, inputCol="__f", outputCol="__p").fit(v).transform(v).withColumn(out, vector_to_array("__p")).drop("__f", "__p")


def drop_small(clusters: DataFrame, least: int, out: str = "cluster") -> DataFrame:
    """Clusters with fewer than ``least`` members become noise (-1)."""
    n = clusters.groupBy(out).agg(F.count("*").alias("__n"))
    return clusters.join(n, out).withColumn(out, F.when(F.col("__n") >= least, F.col(out)).otherwise(-1)).drop("__n")


def boxes_touching(grid: DataFrame, boxes: DataFrame, cell: float) -> DataFrame:
    """Pairs of intersecting boxes: an equi-join on grid bins, then the exact test, each pair once."""
    def bins(lo, hi):
        return F.explode(F.sequence(F.floor(F.col(lo) / cell).cast("long"), F.floor(F.col(hi) / cell).cast("long")))

    g = grid.withColumn("bx", bins("xmin", "xmax")).withColumn("by", bins("ymin", "ymax")).alias("g")
    b = boxes.withColumn("bx", bins("xmin", "xmax")).withColumn("by", bins("ymin", "ymax")).alias("b")
    hit = ((F.col("g.xmin") <= F.col("b.xmax")) & (F.col("b.xmin") <= F.col("g.xmax")) & (F.col("g.ymin") <= F.col("b.ymax")) & (F.col("b.ymin") <= F.col("g.ymax")))
    j = g.join(b, (F.col("g.bx") == F.col("b.bx")) & (F.col("g.by") == F.col("b.by"))).where(hit)
    return j.select("g.cell_id", "b.box_id").distinct()


def centres_inside(grid: DataFrame, edges: DataFrame) -> DataFrame:
    """Cells whose centre lies in a ring: an odd number of ring edges crosses the ray to the right.

    ``edges`` (``ring_id, x1, y1, x2, y2``) meet the cells in horizontal bands of the cell height.
    """
    g = grid.withColumn("cx", (F.col("xmin") + F.col("xmax")) / 2).withColumn("cy", (F.col("ymin") + F.col("ymax")) / 2).withColumn("band", F.floor("cy"))
    e = edges.where("y1 <> y2").withColumn("band", F.explode(F.sequence(F.floor(F.least("y1", "y2")), F.floor(F.greatest("y1", "y2")))))
    over = ((F.col("y1") > F.col("cy")) != (F.col("y2") > F.col("cy"))) & (F.col("cx") < F.col("x1") + (F.col("cy") - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1")))
    n = g.join(e, "band").where(over).groupBy("cell_id", "ring_id").agg(F.count("*").alias("n"))
    return n.where("n % 2 = 1").select("cell_id", "ring_id")


def outlines_touching(grid: DataFrame, edges: DataFrame, cell: float) -> DataFrame:
    """``cell_id, geom_id``: boxes of ``grid`` that an outline (all rings of it; inner ones are holes) touches or covers.

    A box meets an outline if one of its edges crosses or touches the box, or if the box lies in it, and so does its
    centre. Edges are dealt to the bins of width ``cell`` along their way and meet the boxes there. For containment,
    each line of centres is cut by the edges it passes, and consecutive cuts are the spans inside; a span meets
    centres in its bins only. Both are equi-joins whose size is that of the outline's length and of the result.
    """
    bin_of = lambda v: F.floor(v / cell).cast("long")
    each = lambda lo, hi: F.explode(F.sequence(bin_of(lo), bin_of(hi)))
    e = edges.withColumn("bx", each(F.least("x1", "x2"), F.greatest("x1", "x2")))
    # The part of the edge over the bin's column gives the bins of its way.
    y_at = lambda x: F.when(F.col("x1") == F.col("x2"), F.col("y1")).otherwise(F.col("y1") + (x - F.col("x1")) * (F.col("y2") - F.col("y1")) / (F.col("x2") - F.col("x1")))
    left, right = F.greatest(F.col("bx") * cell, F.least("x1", "x2")), F.least((F.col("bx") + 1) * cell, F.greatest("x1", "x2"))
    steep = F.col("x1") == F.col("x2")
    low = F.when(steep, F.least("y1", "y2")).otherwise(F.least(y_at(left), y_at(right)))
    high = F.when(steep, F.greatest("y1", "y2")).otherwise(F.greatest(y_at(left), y_at(right)))
    slack = cell * 1e-9
    e = e.withColumn("by", each(low - slack, high + slack))
    g = grid.withColumn("bx", each(F.col("xmin"), F.col("xmax"))).withColumn("by", each(F.col("ymin"), F.col("ymax")))
    side = [(F.col(x) - F.col("x1")) * (F.col("y2") - F.col("y1")) - (F.col(y) - F.col("y1")) * (F.col("x2") - F.col("x1")) for x in ("xmin", "xmax") for y in ("ymin", "ymax")]
    cut = ((F.least("x1", "x2") <= F.col("xmax")) & (F.greatest("x1", "x2") >= F.col("xmin")) & (F.least("y1", "y2") <= F.col("ymax")) & (F.greatest("y1", "y2") >= F.col("ymin"))
           & (F.least(*side) <= 0) & (F.greatest(*side) >= 0))
    crossed = g.join(e, ["bx", "by"]).where(cut).select("cell_id", "geom_id")
    c = grid.select("cell_id", ((F.col("xmin") + F.col("xmax")) / 2).alias("cx"), ((F.col("ymin") + F.col("ymax")) / 2).alias("cy"))
    lines = c.select("cy").distinct().withColumn("by", bin_of(F.col("cy")))
    over = edges.where("y1 <> y2").withColumn("by", each(F.least("y1", "y2"), F.greatest("y1", "y2"))).join(lines, "by").where((F.col("y1") > F.col("cy")) != (F.col("y2") > F.col("cy")))
    cuts = over.groupBy("geom_id", "cy").agg(F.array_sort(F.collect_list(F.col("x1") + (F.col("cy") - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1")))).alias("x"))
    spans = cuts.select("geom_id", "cy", F.explode(F.expr("transform(sequence(0, size(x) div 2 - 1), i -> struct(x[2 * i] as a, x[2 * i + 1] as b))")).alias("s")).select("geom_id", "cy", "s.a", "s.b")
    inside = spans.withColumn("bx", each(F.col("a"), F.col("b"))).join(c.withColumn("bx", bin_of(F.col("cx"))), ["cy", "bx"]).where("cx >= a and cx < b")
    return crossed.unionByName(inside.select("cell_id", "geom_id")).distinct()
