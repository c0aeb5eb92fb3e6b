"""Listings, text records and array files as DataFrames."""

from __future__ import annotations

import io

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.keys import key_generic
from .shared import opened, written


def listing(spark: SparkSession, root: str, exts: tuple[str, ...] = (), recursive: bool = True) -> DataFrame:
    """``path, length, mtime`` of all files under a root, without their content, of given extensions (any case).

    Tasks list the folders, level by level, each level as a table, so neither the driver nor one task sees all files; a
    single folder is listed by one task. As in Spark's readers, names that begin with ``_`` (without ``=``) or ``.`` do not count.
    """
    store, top, prefix = opened(spark, root)
    if store is None:
        # Only Hadoop knows how to open this kind of path; its listing goes through the driver.
        files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(root)
        files = files.select("path", "length", F.col("modificationTime").alias("mtime"))
        return of_kind(files, exts) if exts else files
    schema = pa.schema([("path", pa.string()), ("length", pa.int64()), ("mtime", pa.timestamp("us", "UTC")), ("folder", pa.bool_())])

    def run(batches):
        for b in batches:
            for folder in b.column(0).to_pylist():
                found = [x for x in store.get_file_info(fs.FileSelector(folder)) if x.type in kinds and not hidden(x.base_name)]
                for i in range(0, len(found), 10_000):
                    part = found[i:i + 10_000]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([x.path for x in part]), pa.array([x.size for x in part], pa.int64()), pa.array([x.mtime for x in part], schema.field("mtime").type),
                        pa.array([x.type == fs.FileType.Directory for x in part])], schema=schema)

    kinds = (fs.FileType.File, fs.FileType.Directory)

    def hidden(name: str) -> bool:
        return name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_")

    files, level = None, spark.createDataFrame([(top,)], "path string")
    while True:
        seen = written(level.mapInArrow(run, "path string, length long, mtime timestamp, folder boolean"), "listed")
        own = seen.where("not folder").select(F.concat(F.lit(prefix), "path").alias("path"), "length", "mtime")
        files = own if files is None else files.unionByName(own)
        level = seen.where("folder").select("path")
        if not recursive or level.isEmpty():
            return of_kind(files, exts) if exts else files
        level = level.repartition(4 * spark.sparkContext.defaultParallelism)


def of_kind(files: DataFrame, exts: tuple[str, ...]) -> DataFrame:
    """Files whose name ends with one of the extensions, in any case."""
    hit = F.lit(False)
    for e in exts:
        hit = hit | F.lower("path").endswith(e.lower())
    return files.where(hit)


def manifest(files: DataFrame, key: Column | None = None, exts: tuple[str, ...] = (".tif",)) -> DataFrame:
    """Keyed files of the given extensions (none: all); those without a key are left out."""
    key = key_generic(F.col("path")) if key is None else key
    return (of_kind(files, exts) if exts else files).withColumn("tile_key", key).where("tile_key is not null")


def index_lists(keyed: DataFrame) -> DataFrame:
    """All paths of a key, sorted."""
    return keyed.groupBy("tile_key").agg(F.array_sort(F.collect_list("path")).alias("paths"))


def index_last(keyed: DataFrame) -> DataFrame:
    """The last path of a key in path order."""
    return keyed.groupBy("tile_key").agg(F.max("path").alias("path"))


def discover(files: DataFrame) -> DataFrame:
    """Files of the first kind that is there: .tif, then .tiff, then .npy; own predictions are left out."""
    kind = F.when(F.col("path").endswith(".tif"), 1).when(F.col("path").endswith(".tiff"), 2).when(F.col("path").endswith(".npy"), 3)
    f = files.where(~F.col("path").contains("_pred.tif")).withColumn("kind", kind).where("kind is not null")
    best = f.agg(F.min("kind").alias("kind"))
    return f.join(F.broadcast(best), "kind", "left_semi").drop("kind")  # one row


def array_pairs(files: DataFrame) -> DataFrame:
    """Image and label arrays of the same base name."""
    base = F.regexp_replace("path", "_(?:img|lbl)\\.npy$", "")
    img = files.where(F.col("path").endswith("_img.npy")).select(base.alias("base"), F.col("path").alias("img"))
    lbl = files.where(F.col("path").endswith("_lbl.npy")).select(base.alias("base"), F.col("path").alias("lbl"))
    return img.join(lbl, "base")


def newest(files: DataFrame, folder: Column) -> DataFrame:
    """Folder with the latest file, the last by name of ties."""
    return files.select(folder.alias("dir"), "mtime").agg(F.max_by("dir", F.struct("mtime", "dir")).alias("dir"))


def histogram_json(docs: DataFrame, text: str = "doc") -> DataFrame:
    """Long histogram from one JSON document per row, in any of three shapes
    (``histogram``, ``hist``, or the map itself); documents that do not parse are left out."""
    v = F.try_parse_json(F.col(text))
    h = F.coalesce(F.try_variant_get(v, "$.histogram", "map<string,bigint>"), F.try_variant_get(v, "$.hist", "map<string,bigint>"), F.try_variant_get(v, "$", "map<string,bigint>"))
    e = docs.select("tile_key", h.alias("h")).where("h is not null").select("tile_key", F.explode("h").alias("k", "n"))
    return e.select("tile_key", F.col("k").try_cast("int").alias("cls"), "n").where("cls is not null")


def histogram_lines(lines: DataFrame, text: str = "line", order: str = "ord") -> DataFrame:
    """``tile_key, total, hist`` from JSON lines: those that do not parse are skipped, the last of a key wins,
    an explicit total overrides the sum."""
    rec = F.from_json(text, "tile_key string, hist map<string,bigint>, total bigint")
    r = lines.select(rec.alias("x"), order).select("x.*", order).where("tile_key is not null and hist is not null")
    w = Window.partitionBy("tile_key").orderBy(F.desc(order))
    r = r.withColumn("k", F.row_number().over(w)).where("k = 1")
    total = F.aggregate(F.map_values("hist"), F.lit(0).cast("long"), lambda a, x: a + x)
    return r.select("tile_key", F.coalesce("total", total).alias("total"), "hist")


def epoch_log(lines: DataFrame, text: str = "line") -> DataFrame:
    """``epoch, loss, acc, miou, f1`` from comma-separated lines; rows with fewer fields or without numbers are skipped."""
    p = F.split(text, ",")
    names = ("epoch", "loss", "acc", "miou", "f1")
    cols = [F.try_element_at(p, F.lit(i + 1)).try_cast("int" if i == 0 else "double").alias(n) for i, n in enumerate(names)]
    return lines.where(F.size(p) >= 5).select(*[c for c in lines.columns if c != text], *cols).where(" and ".join(f"{n} is not null" for n in names))


def splits_document(doc: DataFrame) -> DataFrame:
    """Long form of a document with one list of keys per split."""
    return doc.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, ("train", "val", "test"))), F.array("train", "val", "test"))).alias("split", "keys")).select(
        "split", F.explode("keys").alias("tile_key"))


#: Bits of what a cell without a pixel holds in array files: a NaN of its own, so pixels that are NaN stay.
HOLE = 0x7FF8_0000_484F_4C45


def decode_arrays(files: DataFrame) -> DataFrame:
    """``.npy`` contents (``tile_key, content``), height x width x bands, as pixels without the cells that
    ``encode_arrays`` had no pixel for; a file that does not decode gives one row with its error and no pixel."""
    import pandas as pd

    columns = ["tile_key", "status", "r", "c", "bands"]

    def one(key, content):
        import numpy as np

        try:
            a = np.load(io.BytesIO(content), allow_pickle=False)
            h, w, k = a.shape
        except (ValueError, EOFError, OSError) as e:
            return pd.DataFrame([(key, f"error:{type(e).__name__}", None, None, None)], columns=columns)
        a = a.reshape(h * w, k)
        at = np.arange(h * w)
        if k and a.dtype == np.float64:
            at = at[~(a.view(np.uint64) == HOLE).all(1)]
        r, c = np.divmod(at, w)
        return pd.DataFrame({"tile_key": key, "status": "ok", "r": r, "c": c, "bands": pd.Series(list(a[at].astype(float)), dtype=object)})

    def run(frames):
        for f in frames:
            for key, content in zip(f["tile_key"], f["content"]):
                yield one(key, content).astype({"r": "Int32", "c": "Int32"})

    return files.select("tile_key", "content").mapInPandas(run, "tile_key string, status string, r int, c int, bands array<double>")


def encode_arrays(pixels: DataFrame) -> DataFrame:
    """One ``.npy`` content per tile from its pixels; cells without one are marked."""
    import pandas as pd

    def run(f):
        import numpy as np

        h, w = int(f["r"].max()) + 1, int(f["c"].max()) + 1
        a = np.full((h, w, len(f["bands"].iloc[0])), HOLE, np.uint64).view(np.float64)
        a[f["r"], f["c"]] = np.array(f["bands"].tolist())
        out = io.BytesIO()
        np.save(out, a)
        return pd.DataFrame({"tile_key": [f["tile_key"].iloc[0]], "content": [out.getvalue()]})

    return pixels.select("tile_key", "r", "c", "bands").groupBy("tile_key").applyInPandas(run, "tile_key string, content binary")


def augmented_splits(doc: DataFrame) -> DataFrame:
    """Long form of an augmented splits document, ``section, key, value``: its lists of tiles (key: the
    split, value: the tile), class counts and weights, channel means and deviations, and tiles per zone."""
    part = lambda section, entries: F.transform(entries, lambda x: F.struct(F.lit(section).alias("section"), x["k"].alias("key"), x["v"].alias("value")))
    of_map = lambda m: F.transform(F.map_entries(m), lambda e: F.struct(e["key"].alias("k"), e["value"].cast("string").alias("v")))
    of_list = lambda a, key=None: F.transform(a, lambda x, i: F.struct((i.cast("string") if key is None else F.lit(key)).alias("k"), x.cast("string").alias("v")))
    splits = ("train", "val", "test")
    parts = [part("tiles", of_list(s, s)) for s in splits]
    parts += [part(f"{s}_utm_counts", of_map(f"{s}_utm_counts")) for s in splits]
    parts += [part("counts", of_map("class_stats.counts")), part("weights", of_map("class_stats.weights.values"))]
    parts += [part(n, of_list(f"normalization.{n}")) for n in ("mean", "std")]
    return doc.select(F.explode(F.concat(*parts)).alias("x")).select("x.*")
