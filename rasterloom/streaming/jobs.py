"""Incremental jobs: confusion counts and tile histograms from files as they arrive.

Each micro-batch adds its own counts to an append-only table under its batch number; a
batch that runs again overwrites its own folder, so totals stay exact. The totals are
one small aggregate over those counts.

Where tiles are delivered again (repaired labels), counts must be replaced instead: ``stream_tiles`` keeps the newest
delivery of each tile. A delivery is a file, and its version the file's time and name, so that the state
is the same whatever batches the files come in. Snapshots take in the batches before them, so a
read costs the tiles, not all that ever came.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.hist import class_histogram
from ..operators.metrics import confusion


def _counts(spark: SparkSession, source: str, schema: StructType, out: str, checkpoint: str, count, keys: list[str]) -> DataFrame:
    def write(batch: DataFrame, number: int) -> None:
        count(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    # Counts of nothing, so that there is a table before the first file.
    write(spark.createDataFrame([], schema), -1)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).parquet(source)
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).groupBy(*keys).agg(F.sum("n").alias("n"))


def stream_confusion(spark: SparkSession, source: str, schema: StructType, out: str, checkpoint: str) -> DataFrame:
    """Confusion counts of all prediction files seen so far; a later call adds only new files."""
    return _counts(spark, source, schema, out, checkpoint, confusion, ["truth", "pred"])


def stream_histograms(spark: SparkSession, source: str, schema: StructType, out: str, checkpoint: str) -> DataFrame:
    """Class histograms per tile of all label files seen so far."""
    return _counts(spark, source, schema, out, checkpoint, lambda b: class_histogram(b, ["tile_key"]), ["tile_key", "cls"])


VERSION = "struct<at: timestamp, path: string>"
STATE = f"tile_key string, version {VERSION}, hist array<struct<cls: int, n: long>>"


def _newest(tiles: DataFrame) -> DataFrame:
    """The newest version of each tile: one grouped maximum, whatever the number of deliveries."""
    return tiles.groupBy("tile_key").agg(F.max("version").alias("version"), F.max_by("hist", "version").alias("hist"))


def _versions(batch: DataFrame) -> DataFrame:
    """Histogram of each tile in each file of a batch; a tile without valid pixels has an empty one."""
    rows = batch.select("tile_key", F.col("label").alias("cls"), F.struct(F.col("_metadata.file_modification_time").alias("at"), F.col("_metadata.file_path").alias("path")).cast(VERSION).alias("version"))
    n = rows.groupBy("tile_key", "version", "cls").agg(F.count("*").alias("n"))
    seen = F.collect_list(F.when(F.col("cls") != 255, F.struct(F.col("cls").cast("int").alias("cls"), F.col("n"))))
    return n.groupBy("tile_key", "version").agg(seen.alias("hist"))


def _folders(spark: SparkSession, name: str, prefix: str) -> list[int]:
    """Numbers of the finished folders ``prefix=N`` below ``name``, in order."""
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    found = [s.getPath() for s in fs.listStatus(path)]
    return sorted(int(p.getName().split("=")[1]) for p in found if p.getName().startswith(f"{prefix}=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def tile_state(spark: SparkSession, out: str) -> DataFrame:
    """``tile_key, version, hist`` of each tile's newest delivery: the last snapshot and the batches after it."""
    upto = max(_folders(spark, f"{out}/snapshots", "upto"), default=-1)
    parts = [f"{out}/batches/batch={n}" for n in _folders(spark, f"{out}/batches", "batch") if n > upto] + ([f"{out}/snapshots/upto={upto}"] if upto >= 0 else [])
    return _newest(spark.read.schema(STATE).parquet(*parts)) if parts else spark.createDataFrame([], STATE)


def compact(spark: SparkSession, out: str) -> None:
    """Writes the state as a new snapshot; until it is finished, readers take the one before."""
    numbers = _folders(spark, f"{out}/batches", "batch")
    if numbers and numbers[-1] > max(_folders(spark, f"{out}/snapshots", "upto"), default=-1):
        tile_state(spark, out).write.mode("overwrite").parquet(f"{out}/snapshots/upto={numbers[-1]}")


def stream_tiles(spark: SparkSession, source: str, schema: StructType, out: str, checkpoint: str, every: int = 16) -> DataFrame:
    """``tile_key, cls, n``: histograms of the newest delivery of each tile among all label files seen so far.

    ``source`` holds Parquet files of ``tile_key, label`` and more, each with whole tiles. A later call reads new files only;
    a tile that comes again replaces what it had, classes that it lost included. A batch that runs again overwrites its own folder. After
    ``every`` batches a snapshot is taken.
    """
    def write(batch: DataFrame, number: int) -> None:
        _versions(batch).write.mode("overwrite").parquet(f"{out}/batches/batch={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).parquet(source).select("tile_key", "label", "_metadata")
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    upto = max(_folders(spark, f"{out}/snapshots", "upto"), default=-1)
    if sum(n > upto for n in _folders(spark, f"{out}/batches", "batch")) >= every:
        compact(spark, out)
    return tile_state(spark, out).select("tile_key", F.explode("hist").alias("h")).select("tile_key", "h.cls", "h.n")
