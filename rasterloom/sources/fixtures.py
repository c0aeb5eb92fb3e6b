"""Tile-shaped views derived from the given tables.

Raster files are not among the test tables, so pixels, labels, predictions, logits,
histograms, epoch logs and segments are derived from them with integer arithmetic;
``plans.oracle`` holds the same definitions as SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.labels import remap

NODATA, IGNORE, CLASSES = -32768, 255, 13


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per pixel: ``tile_key, zone, r, c, raw_label, b0..b3``; 32 columns wide, ragged last row."""
    order = Window.partitionBy("l_suppkey").orderBy(
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_shipdate")
    o = (table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
         .withColumn("px", F.row_number().over(order) - 1))
    zone = (32630 + F.col("s_nationkey") % 6).cast("string")
    empty = F.col("l_orderkey") % 97 == 0
    raw = (F.when(F.col("l_orderkey") % 50 == 0, NODATA).when(F.col("l_partkey") % 20 < F.col("l_suppkey") % 20, 0)
           .when((F.col("l_suppkey") % 7 == 0) & (F.col("l_linenumber") <= 5), 16).otherwise((F.col("l_orderkey") + F.col("l_linenumber")) % 23))
    band = lambda gap, col: F.when(gap, float(NODATA)).otherwise(F.col(col)).cast("double")
    return o.select(
        F.concat(zone, F.lit("_"), F.col("l_suppkey").cast("string")).alias("tile_key"), zone.alias("zone"),
        F.floor(F.col("px") / 32).cast("int").alias("r"), (F.col("px") % 32).cast("int").alias("c"), raw.cast("int").alias("raw_label"),
        band(empty, "l_quantity").alias("b0"), band(empty | (F.col("l_linenumber") == 7), "l_extendedprice").alias("b1"),
        band(empty, "l_discount").alias("b2"), band(empty, "l_tax").alias("b3"))


def banded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels with their bands as one array."""
    return labels(spark, sf_dir).withColumn("bands", F.array("b0", "b1", "b2", "b3"))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels(spark, sf_dir).withColumn("label", remap(F.col("raw_label")))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels with a prediction that is right four times out of five."""
    right = (F.col("r") * 7 + F.col("c")) % 5 < 4
    pred = (F.when(F.col("label") == IGNORE, (F.col("r") + F.col("c")) % CLASSES).when(right, F.col("label"))
            .otherwise((F.col("label") + F.col("r") + 1) % CLASSES))
    return labels(spark, sf_dir).withColumn("pred", pred.cast("int"))


def histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid pixels per tile and class: ``tile_key, zone, cls, n``."""
    return (labels(spark, sf_dir).where(F.col("label") != IGNORE).groupBy("tile_key", "zone", F.col("label").alias("cls"))
            .agg(F.count("*").alias("n")))


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct tiles with their number."""
    s = table(spark, sf_dir, "supplier")
    zone = (32630 + F.col("s_nationkey") % 6).cast("string")
    return s.select(F.concat(zone, F.lit("_"), F.col("s_suppkey").cast("string")).alias("tile_key"), zone.alias("zone"), F.col("s_suppkey").alias("tile_id"))


def embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64-band pixels of 5 x 5 tiles from the embeddings."""
    e = table(spark, sf_dir, "embeddings")
    tile = F.floor(F.col("vec_id") / 25)
    zone = (32630 + tile % 6).cast("string")
    return e.select(F.concat(zone, F.lit("_"), tile.cast("string")).alias("tile_key"), zone.alias("zone"),
                    F.floor(F.col("vec_id") % 25 / 5).cast("int").alias("r"), (F.col("vec_id") % 5).cast("int").alias("c"),
                    F.col("label"), F.col("embedding").cast("array<double>").alias("bands"), "vec_id")


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed(spark, sf_dir).withColumn("logits", F.slice("bands", 1, CLASSES)).drop("bands")


def epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Epoch log: ``run, epoch, loss, f1``."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run"), F.row_number().over(w).alias("epoch"), F.col("value").alias("loss"),
        (1 / (1 + F.abs("value"))).alias("f1"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled pixels in 4 x 4 segments with an order of masks."""
    seg = (F.floor(F.col("r") / 4) * 8 + F.floor(F.col("c") / 4)).cast("int")
    return labels(spark, sf_dir).withColumn("segment_id", seg).withColumn("ord", (seg * 5 % 7).cast("int"))


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names of every tile in the known patterns, with size and time."""
    t = tiles(spark, sf_dir)
    z, i = F.col("zone"), F.col("tile_id").cast("string")
    names = {
        "image": F.concat(F.lit("/in/img/google_embed_Europe_2018_10m_"), z, F.lit("_bands_00_63_"), i, F.lit(".tif")),
        "label": F.concat(F.lit("/in/lbl/ext_wetland_2018_Europe_2018_10m_"), z, F.lit("_"), i, F.lit(".tif")),
        "group": F.concat(F.lit("/in/raw/google_embed_Europe_2018_10m_"), z, F.lit("_bands_01_22_"), i, F.lit(".tif")),
        "json": F.concat(F.lit("/out/20250717_132657/hist/"), z, F.lit("_"), i, F.lit(".json")),
        "pred": F.concat(F.lit("/out/pred/"), z, F.lit("_"), i, F.lit("_pred.tif")),
        "array": F.concat(F.lit("/out/npy/tile_"), z, F.lit("_"), i, F.lit("_img.npy")),
        "array_label": F.concat(F.lit("/out/npy/tile_"), z, F.lit("_"), i, F.lit("_lbl.npy")),
    }
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("role"), v.alias("path")) for k, v in names.items()])).alias("x")
    return (t.select("tile_key", "zone", "tile_id", each).select("tile_key", "zone", "tile_id", "x.role", "x.path")
            .where(~((F.col("role") == "label") & (F.col("tile_id") % 9 == 0)) & ~((F.col("role") == "array_label") & (F.col("tile_id") % 8 == 0)))
            .withColumn("mtime", (F.col("tile_id") * 37 % 101).cast("long")))
