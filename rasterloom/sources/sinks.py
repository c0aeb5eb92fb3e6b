"""Sinks: tables and documents written under the commit protocol, and what is left to do."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import opened


def write_tiles(pixels: DataFrame, path: str) -> None:
    """Pixels as one table partitioned by zone, sorted so that row groups cover few tiles."""
    pixels.repartition("zone", "tile_key").sortWithinPartitions("tile_key", "r", "c").write.partitionBy("zone").parquet(path)


def write_lines(df: DataFrame, path: str) -> None:
    """JSON lines."""
    df.write.json(path)


def write_texts(files: DataFrame, root: str) -> None:
    """A text file per row (``name``, which may lie in folders below the root, and ``text``), written by the tasks themselves: no
    file is moved at the end, and what a lost task leaves is written again."""
    spark = files.sparkSession
    store, top, _ = opened(spark, root)
    if store is None:
        raise ValueError(f"tasks cannot write files to {root}")

    def run(batches):
        made, n = set(), 0
        for b in batches:
            for name, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                folder = f"{top}/{name}".rpartition("/")[0]
                if folder not in made:
                    store.create_dir(folder)
                    made.add(folder)
                with store.open_output_stream(f"{top}/{name}") as out:
                    out.write(text.encode())
                n += 1
        yield pa.RecordBatch.from_pydict({"n": [n]})

    files.select("name", "text").repartition(4 * spark.sparkContext.defaultParallelism).mapInArrow(run, "n long").agg(F.sum("n")).collect()


def write_table(df: DataFrame, path: str, kind: str = "parquet") -> None:
    if kind == "csv":
        df.write.option("header", True).csv(path)
    else:
        df.write.format(kind).save(path)


def append_epochs(log: DataFrame, path: str) -> None:
    """Adds epochs (``epoch, loss, acc, miou, f1, lr``) to a run's CSV log, six decimals each; every part has the header."""
    six = [F.format_string("%.6f", F.col(c)).alias(c) for c in ("loss", "acc", "miou", "f1")]
    rows = log.select("epoch", *six, F.format_string("%.6e", F.col("lr")).alias("lr"))
    rows.sortWithinPartitions("epoch").write.mode("append").option("header", True).csv(path)


def write_splits(splits: DataFrame, path: str) -> None:
    """Splits in long form, one folder per split, whatever the number of tiles."""
    splits.select("tile_key", "split").write.partitionBy("split").parquet(path)


#: Tiles of which a splits document is made at most: it is one row, so one task holds them all.
DOCUMENT_TILES = 5_000_000


def splits_row(splits: DataFrame) -> DataFrame:
    """One row with a sorted list of keys per split: the document, of as many keys as tiles were selected."""
    lists = [F.array_sort(F.collect_list(F.when(F.col("split") == s, F.col("tile_key")))).alias(s) for s in ("train", "val", "test")]
    return splits.agg(*lists)


def augmented_row(splits: DataFrame, weights: DataFrame, stats: DataFrame, method: str = "median_frequency", ignore: int = 255) -> DataFrame:
    """The document with what a training run needs besides: per split the tiles of each zone,
    class counts and weights (``cls, n, weight``), band means and deviations (``band, mean, std``)."""
    doc = splits_row(splits)
    zones = splits.groupBy("split", "zone").agg(F.count("*").alias("n"))
    for s in ("train", "val", "test"):
        entries = F.array_sort(F.collect_list(F.when(F.col("split") == s, F.struct("zone", "n"))))
        doc = doc.join(F.broadcast(zones.agg(F.map_from_entries(entries).alias(f"{s}_utm_counts"))))  # one row
    per = lambda v: F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("cls").cast("string"), v))))
    classes = weights.agg(F.struct(
        F.count("*").alias("num_classes"), F.lit(ignore).alias("ignore_val"), per("n").alias("counts"), F.sum("n").alias("total_pixels"),
        F.struct(F.lit(method).alias("method"), per("weight").alias("values")).alias("weights")).alias("class_stats"))
    ordered = lambda v: F.transform(F.array_sort(F.collect_list(F.struct("band", v))), lambda x: x[v])
    bands = stats.agg(F.struct(ordered("mean").alias("mean"), ordered("std").alias("std")).alias("normalization"))
    return doc.join(F.broadcast(classes)).join(F.broadcast(bands))  # one row each


def write_splits_document(splits: DataFrame, path: str, row: DataFrame | None = None) -> None:
    """The splits as one JSON document in a new run folder, for selections up to ``DOCUMENT_TILES``;
    nothing is changed in place. ``row`` is the document, if it is not the plain one."""
    if splits.count() > DOCUMENT_TILES:
        raise ValueError(f"a document holds at most {DOCUMENT_TILES} tiles; write_splits has no bound")
    (splits_row(splits) if row is None else row).coalesce(1).write.json(path)


def left_to_do(todo: DataFrame, done: DataFrame, readable: str | None = None) -> DataFrame:
    """Keys not done yet, or done but not readable."""
    ok = done.where(readable) if readable else done
    return todo.join(ok.select("tile_key").distinct(), "tile_key", "left_anti")


def delete_candidates(files: DataFrame, keep: DataFrame) -> DataFrame:
    """Files whose key is not among those to keep: a list, nothing is deleted."""
    return files.join(keep.select("tile_key").distinct(), "tile_key", "left_anti").select("path")
