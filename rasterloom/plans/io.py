"""Queries: listings, records, array files, sinks read back, incremental jobs, user functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.keys import key_generic
from ..operators import bands as B
from ..operators import hist as H
from ..operators import metrics as M
from ..operators import split as P
from ..operators import weights as W
from ..sources import files as R
from ..sources import fixtures as X
from ..sources import sinks as K
from ..sources.shared import shared_path
from ..streaming import jobs
from .registry import query, r6
from .splits import LEGACY, SPLIT

KEYED = r""", k AS (SELECT path, mtime, coalesce(nullif(regexp_extract(path, '(32[67][0-9]{2}_[0-9]+)[^/]*$', 1), ''),
  nullif(regexp_extract(path, '_(32[67][0-9]{2})_[^/]*$', 1), '') || '_' || nullif(regexp_extract(path, '([0-9]+)\.tif$', 1), '')) AS tile_key FROM fx_paths WHERE lower(path) LIKE '%.tif')"""


@query("s1_manifest_lists", KEYED + " SELECT tile_key, count(*) AS n, string_agg(path, '|' ORDER BY path) AS paths FROM k WHERE tile_key IS NOT NULL GROUP BY 1")
def s1a(s, d):
    m = R.index_lists(R.manifest(X.paths(s, d).select("path")))
    return m.select("tile_key", F.size("paths").cast("long").alias("n"), F.array_join("paths", "|").alias("paths"))


@query("s1_manifest_last", KEYED + " SELECT tile_key, max(path) AS path FROM k WHERE tile_key IS NOT NULL GROUP BY 1")
def s1b(s, d):
    return R.index_last(R.manifest(X.paths(s, d).select("path")))


@query("s1_listing", "SELECT tile_key, count(*) AS n FROM (SELECT tile_key, zone, c % 2 AS h FROM fx_pixels GROUP BY ALL) GROUP BY 1")
def s1_listing(s, d):
    """Files written below a root, listed with their keys: two text files per tile, and for every tenth tile two with another ending."""
    path = shared_path(s, "listing")
    p = X.pixels(s, d)
    i = F.substring_index("tile_key", "_", -1).cast("long")
    files = p.groupBy("tile_key", "zone", (F.col("c") % 2).alias("h")).agg(F.array_join(F.array_sort(F.collect_set("r")), "\n").alias("text"))
    # Folders of some hundred files each.
    name = F.concat_ws("/", "zone", F.floor(i / 1000).cast("string"), F.concat_ws("_", F.lit("band"), "tile_key", F.col("h").cast("string")))
    ends = F.explode(F.when(i % 10 == 0, F.array(F.lit(".txt"), F.lit(".json"))).otherwise(F.array(F.lit(".txt"))))
    K.write_texts(files.select(name.alias("name"), "text", ends.alias("end")).select(F.concat("name", "end").alias("name"), "text"), path)
    found = R.listing(s, path, (".TXT",)).where("length > 0")
    return R.manifest(found, key_generic(F.col("path")), ()).groupBy("tile_key").agg(F.count("*").alias("n"))


@query("s2_discover", "SELECT path FROM fx_paths WHERE path NOT LIKE '%\\_pred.tif%' ESCAPE '\\' AND path LIKE '%.tif'")
def s2(s, d):
    return R.discover(X.paths(s, d).select("path"))


@query("s3_array_pairs", "SELECT a.path AS img, b.path AS lbl FROM fx_paths a JOIN fx_paths b ON a.role = 'array' AND b.role = 'array_label' AND a.tile_id = b.tile_id")
def s3(s, d):
    return R.array_pairs(X.paths(s, d).select("path")).select("img", "lbl")


@query("s4_tile_scan", "SELECT tile_key, count(*) AS n, sum(b0) AS b0 FROM fx_pixels WHERE zone = '32633' GROUP BY 1")
def s4(s, d):
    """Pixels written partitioned by zone, scanned with partition pruning."""
    path = shared_path(s, "tiles")
    K.write_tiles(X.pixels(s, d), path)
    t = s.read.parquet(path).where("zone = 32633")
    return t.groupBy("tile_key").agg(F.count("*").alias("n"), F.sum("b0").alias("b0"))


@query("s7_array_ingest", "SELECT tile_key, CASE WHEN split_part(tile_key, '_', 2)::INT % 7 = 0 THEN 'error' ELSE 'ok' END AS status, CASE WHEN split_part(tile_key, '_', 2)::INT % 7 = 0 THEN 0 ELSE count(*) END AS n,"
       " CASE WHEN split_part(tile_key, '_', 2)::INT % 7 = 0 THEN NULL ELSE round(sum(list_sum(bands)), 5) + 0.0 END AS total FROM fx_embed GROUP BY tile_key")
def s7(s, d):
    """Tiles as array files, every seventh cut short, decoded again."""
    a = R.encode_arrays(X.embed(s, d))
    bad = F.substring_index("tile_key", "_", -1).cast("int") % 7 == 0
    p = R.decode_arrays(a.withColumn("content", F.when(bad, F.expr("substring(content, 1, 90)")).otherwise(F.col("content"))))
    one = F.aggregate("bands", F.lit(0.0), lambda x, y: x + y)
    return p.groupBy("tile_key", F.when(F.col("status") == "ok", "ok").otherwise("error").alias("status")).agg(
        F.count("r").alias("n"), (F.round(F.sum(one), 5) + 0.0).alias("total"))


@query("s8_histogram_json", "SELECT tile_key, cls, n FROM fx_hist WHERE split_part(tile_key, '_', 2)::INT % 11 <> 0")
def s8(s, d):
    """One document per tile in three shapes; every eleventh is cut short."""
    h = X.histograms(s, d).groupBy("tile_key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("cls").cast("string"), "n")))).alias("h"))
    i = F.substring_index("tile_key", "_", -1).cast("int")
    raw = F.to_json("h")
    doc = F.when(i % 3 == 0, F.concat(F.lit('{"tile_id":1,"histogram":'), raw, F.lit("}"))).when(i % 3 == 1, F.concat(F.lit('{"hist":'), raw, F.lit(',"total":5}'))).otherwise(raw)
    doc = F.when(i % 11 == 0, F.concat(F.lit('{"hist":{"0":'), F.lit("1"))).otherwise(doc)
    return R.histogram_json(h.select("tile_key", doc.alias("doc")))


@query("s9_histogram_lines", ", t AS (SELECT tile_key, sum(n)::BIGINT AS s, split_part(tile_key, '_', 2)::INT AS i FROM fx_hist GROUP BY 1) SELECT tile_key, CASE WHEN i % 4 = 0 THEN 99 ELSE s END::BIGINT AS total FROM t")
def s9(s, d):
    """An old record, a broken line and a new record per tile; some new ones carry a total."""
    h = X.histograms(s, d).groupBy("tile_key").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("cls").cast("string"), "n"))))).alias("h"))
    i = F.substring_index("tile_key", "_", -1).cast("int")
    head = F.concat(F.lit('{"tile_key":"'), "tile_key", F.lit('","hist":'))
    new = F.concat(head, "h", F.when(i % 4 == 0, F.lit(',"total":99}')).otherwise("}"))
    lines = h.select(F.posexplode(F.array(F.concat(head, F.lit('{"0":1}}')), new, F.concat(head, F.lit("{")))).alias("ord", "line"))
    return R.histogram_lines(lines).select("tile_key", "total")


@query("s10_splits_document", SPLIT + " SELECT split, tile_key FROM sp")
def s10(s, d):
    """Splits written as one document and read back in long form."""
    path = shared_path(s, "splits")
    K.write_splits_document(P.stratified(X.tiles(s, d)), path)
    lists = "train array<string>, val array<string>, test array<string>"
    return R.splits_document(s.read.option("multiLine", True).schema(lists).json(path))


@query("k6_splits_long", SPLIT + " SELECT split, tile_key FROM sp")
def k6_long(s, d):
    """Splits written in long form, a folder for each."""
    path = shared_path(s, "splits")
    K.write_splits(P.stratified(X.tiles(s, d)), path)
    return s.read.parquet(path).select("split", "tile_key")


DOC = "train array<string>, val array<string>, test array<string>, " + "".join(f"{x}_utm_counts map<string,bigint>, " for x in ("train", "val", "test")) + (
    "class_stats struct<num_classes: bigint, ignore_val: int, counts: map<string,bigint>, total_pixels: bigint, weights: struct<method: string, values: map<string,double>>>,"
    " normalization struct<mean: array<double>, std: array<double>>")


@query("k6_augmented_document", SPLIT + LEGACY + """,
 u AS (SELECT unnest([0, 1, 2, 3])::INT AS band, unnest(bands) AS x FROM fx_labels WHERE tile_key IN (SELECT tile_key FROM sp WHERE split = 'train')),
 cs AS (SELECT band, count(*) FILTER (x <> -32768) AS n_valid, coalesce(sum(x) FILTER (x <> -32768), 0) AS s, coalesce(sum(x * x) FILTER (x <> -32768), 0) AS q FROM u GROUP BY band),
 st AS (SELECT band, CASE WHEN n_valid > 0 THEN s / n_valid ELSE 0 END AS mean, CASE WHEN n_valid > 0 THEN sqrt(greatest(0, q / n_valid - s / n_valid * (s / n_valid))) ELSE 1 END AS std FROM cs)
 SELECT 'tiles' AS section, split AS key, tile_key AS value, NULL::DOUBLE AS number FROM sp
 UNION ALL SELECT split || '_utm_counts', zone, NULL, count(*)::DOUBLE FROM sp GROUP BY split, zone
 UNION ALL SELECT 'counts', cls::VARCHAR, NULL, n::DOUBLE FROM k UNION ALL SELECT 'weights', cls::VARCHAR, NULL, round(weight, 5) + 0.0 FROM lw
 UNION ALL SELECT 'mean', band::VARCHAR, NULL, round(mean, 4) + 0.0 FROM st UNION ALL SELECT 'std', band::VARCHAR, NULL, round(std, 4) + 0.0 FROM st""")
def k6_augmented(s, d):
    """The document with class statistics, weights, zone counts and the bands' statistics over the training tiles, read back in long form."""
    path = shared_path(s, "splits")
    sp = P.stratified(X.tiles(s, d))
    w = W.legacy(H.class_totals(X.tiles(s, d), X.histograms(s, d)))
    train = X.banded(s, d).join(sp.where("split = 'train'").select("tile_key"), "tile_key", "left_semi")
    K.write_splits_document(sp, path, K.augmented_row(sp, w, B.channel_stats(train, 4), "legacy"))
    long = R.augmented_splits(s.read.option("multiLine", True).schema(DOC).json(path))
    name = F.col("section") == "tiles"
    number = F.col("value").try_cast("double")
    rounded = F.when(F.col("section") == "weights", F.round(number, 5)).otherwise(F.round(number, 4)) + 0.0
    return long.select("section", "key", F.when(name, F.col("value")).alias("value"), F.when(~name, rounded).alias("number"))


@query("s11_epoch_log", "SELECT run, epoch FROM fx_epochs WHERE epoch % 10 <> 0 AND epoch % 7 <> 0")
def s11(s, d):
    """Log lines; every tenth lacks fields and every seventh a number."""
    e = X.epochs(s, d)
    line = F.when(F.col("epoch") % 10 == 0, F.concat(F.col("epoch").cast("string"), F.lit(",0.5"))).otherwise(
        F.concat_ws(",", F.col("epoch").cast("string"), F.when(F.col("epoch") % 7 == 0, "nan?").otherwise(F.col("loss").cast("string")), F.lit("0.9"), F.lit("0.5"), F.col("f1").cast("string")))
    return R.epoch_log(e.select("run", line.alias("line"))).select("run", "epoch")


@query("s12_path_list", "SELECT path FROM fx_paths WHERE role = 'image'")
def s12(s, d):
    """A list of paths written as text lines, read and trimmed (also the text sink)."""
    path = shared_path(s, "list")
    K.write_table(X.paths(s, d).where("role = 'image'").select(F.concat(F.lit("  "), "path", F.lit(" ")).alias("value")), path, "text")
    return s.read.text(path).select(F.trim("value").alias("path"))


@query("s13_zone_names", "SELECT DISTINCT zone FROM fx_paths")
def s13(s, d):
    return X.paths(s, d).select(F.regexp_extract("path", "[/_](32[67][0-9]{2})_", 1).alias("zone")).distinct()


@query("s14_newest_folder", "SELECT arg_max(dir, (mtime, dir)) AS dir FROM (SELECT mtime, regexp_replace(path, '/[^/]*$', '') AS dir FROM fx_paths)")
def s14(s, d):
    return R.newest(X.paths(s, d), F.regexp_replace("path", "/[^/]*$", ""))


def back(s, df, kind, **options):
    path = shared_path(s, kind)
    K.write_table(df, path, kind)
    r = s.read.schema(df.schema)
    for k, v in options.items():
        r = r.option(k, v)
    return r.format(kind).load(path)


@query("k1_write_tiles", "SELECT zone::INT AS zone, count(*) AS n, sum(label)::BIGINT AS labels FROM fx_labels GROUP BY 1")
def k1(s, d):
    path = shared_path(s, "tiles")
    K.write_tiles(X.labels(s, d).select("zone", "tile_key", "r", "c", "label", "b0"), path)
    return s.read.parquet(path).groupBy("zone").agg(F.count("*").alias("n"), F.sum("label").alias("labels"))


@query("k2_write_predictions", "SELECT tile_key, sum(pred)::BIGINT AS p, count(*) AS n FROM fx_pred GROUP BY 1")
def k2(s, d):
    b = back(s, X.predictions(s, d).select("tile_key", "r", "c", F.col("pred").cast("smallint")), "parquet")
    return b.groupBy("tile_key").agg(F.sum("pred").alias("p"), F.count("*").alias("n"))


@query("k3_write_probabilities", "SELECT vec_id, 13 AS n FROM fx_logits")
def k3(s, d):
    from ..operators.score import softmax

    b = back(s, X.logits(s, d).select("vec_id", softmax().cast("array<float>").alias("probs")), "parquet")
    return b.select("vec_id", F.size("probs").alias("n"))


@query("k4_histogram_lines", "SELECT tile_key, cls, n FROM fx_hist")
def k4(s, d):
    return back(s, X.histograms(s, d).select("tile_key", "cls", "n"), "json")


@query("k5_tile_json", "SELECT tile_key, count(*)::INT AS classes FROM fx_hist GROUP BY 1")
def k5(s, d):
    h = X.histograms(s, d).groupBy("tile_key").agg(F.map_from_entries(F.collect_list(F.struct(F.col("cls").cast("string"), "n"))).alias("histogram"))
    return back(s, h, "json").select("tile_key", F.size("histogram").alias("classes"))


@query("k7_metrics_csv", ", cf AS (SELECT label AS truth, pred, count(*) AS n FROM fx_pred WHERE label <> 255 GROUP BY ALL) SELECT truth, pred, n FROM cf")
def k7(s, d):
    return back(s, M.confusion(X.predictions(s, d)), "csv", header=True)


@query("k7_epoch_log", "SELECT run, epoch, round(loss, 6) + 0.0 AS loss, round(f1, 6) + 0.0 AS f1 FROM fx_epochs")
def k7_epochs(s, d):
    """Epochs appended to a CSV log in two steps and read back."""
    path = shared_path(s, "log")
    e = X.epochs(s, d).select((F.col("run") * 100000 + F.col("epoch")).alias("epoch"), "loss", F.lit(0.5).alias("acc"), F.lit(0.25).alias("miou"), "f1", F.lit(1e-4).alias("lr"))
    for part in ("epoch % 2 = 0", "epoch % 2 = 1"):
        K.append_epochs(e.where(part), path)
    log = s.read.option("header", True).schema("epoch long, loss double, acc double, miou double, f1 double, lr double").csv(path)
    return log.select(F.expr("epoch div 100000").alias("run"), (F.col("epoch") % 100000).cast("int").alias("epoch"), *[r6(c).alias(c) for c in ("loss", "f1")])


@query("k8_write_weights", LEGACY + " SELECT cls, n, round(weight, 6) + 0.0 AS weight FROM lw")
def k8(s, d):
    w = W.legacy(H.class_totals(X.tiles(s, d), X.histograms(s, d)))
    return back(s, w, "parquet").select("cls", "n", r6("weight").alias("weight"))


@query("k9_text_list", "SELECT tile_key AS value FROM fx_tiles")
def k9(s, d):
    return back(s, X.tiles(s, d).select(F.col("tile_key").alias("value")), "text")


@query("k10_resume", "SELECT tile_key FROM fx_tiles WHERE NOT (tile_id % 2 = 0 AND tile_id % 6 <> 0)")
def k10(s, d):
    done = X.tiles(s, d).where("tile_id % 2 = 0").withColumn("readable", F.col("tile_id") % 6 != 0)
    return K.left_to_do(X.tiles(s, d), done, "readable").select("tile_key")


@query("k11_delete_candidates", KEYED + " SELECT path FROM k WHERE tile_key IS NOT NULL AND tile_key NOT IN (SELECT tile_key FROM fx_paths WHERE role = 'label')")
def k11(s, d):
    p = X.paths(s, d)
    return K.delete_candidates(R.manifest(p.select("path"), key_generic(F.col("path"))), p.where("role = 'label'").select("tile_key"))


@query("r1_stream_confusion", ", cf AS (SELECT label AS truth, pred, count(*) AS n FROM fx_pred WHERE label <> 255 GROUP BY ALL) SELECT truth, pred, n FROM cf")
def r1(s, d):
    """Predictions arrive as files; counts of each batch are added up."""
    path = shared_path(s, "stream")
    p = X.predictions(s, d).select("tile_key", "r", "c", "label", "pred")
    p.repartition(6, "tile_key").write.parquet(f"{path}/in")
    return jobs.stream_confusion(s, f"{path}/in", p.schema, f"{path}/out", f"{path}/ckpt").withColumn("n", F.col("n").cast("long"))


@query("r2_stream_histograms", "SELECT tile_key, cls, n FROM fx_hist")
def r2(s, d):
    path = shared_path(s, "stream")
    p = X.labels(s, d).select("tile_key", "r", "c", "label")
    p.repartition(6, "tile_key").write.parquet(f"{path}/in")
    return jobs.stream_histograms(s, f"{path}/in", p.schema, f"{path}/out", f"{path}/ckpt").withColumn("n", F.col("n").cast("long"))


@query("r2_stream_repaired", ", m AS (SELECT tile_key, CASE WHEN split_part(tile_key, '_', 2)::INT % 4 <> 0 OR label = 255 THEN label WHEN label = 3 THEN 255 ELSE (label + 1) % 13 END AS cls FROM fx_labels)"
       " SELECT tile_key, cls::INT AS cls, count(*) AS n FROM m WHERE cls <> 255 GROUP BY ALL")
def r2_repaired(s, d):
    """Label files arrive, a snapshot is taken, and every fourth tile comes again with other labels, which replace the first."""
    path = shared_path(s, "stream")
    p = X.labels(s, d).select("tile_key", "r", "c", "label")
    p.repartition(6, "tile_key").write.parquet(f"{path}/in")
    jobs.stream_tiles(s, f"{path}/in", p.schema, f"{path}/out", f"{path}/ckpt", every=1)
    again = p.where("cast(substring_index(tile_key, '_', -1) as int) % 4 = 0")
    label = F.when(F.col("label") == 255, 255).when(F.col("label") == 3, 255).otherwise((F.col("label") + 1) % 13).cast("int")
    again.withColumn("label", label).repartition(2, "tile_key").write.mode("append").parquet(f"{path}/in")
    return jobs.stream_tiles(s, f"{path}/in", p.schema, f"{path}/out", f"{path}/ckpt", every=9)


@query("x1_tile_worker", "SELECT tile_key, CASE WHEN split_part(tile_key, '_', 2)::INT % 5 = 0 THEN 'error:ValueError' ELSE 'ok' END AS status, CASE WHEN split_part(tile_key, '_', 2)::INT % 5 = 0 THEN NULL ELSE count(*) END AS n FROM fx_embed GROUP BY 1")
def x1(s, d):
    """A user function per tile that returns one record; its errors become a status."""
    import pandas as pd

    def worker(f):
        key = f["tile_key"].iloc[0]
        try:
            if int(key.split("_")[1]) % 5 == 0:
                raise ValueError("refused")
            return pd.DataFrame({"tile_key": [key], "status": ["ok"], "n": [len(f)]})
        except ValueError as e:
            return pd.DataFrame({"tile_key": [key], "status": [f"error:{type(e).__name__}"], "n": pd.array([None], "Int64")})

    return X.embed(s, d).select("tile_key", "vec_id").groupBy("tile_key").applyInPandas(worker, "tile_key string, status string, n long")


@query("x3_transform_chain", ", x AS (SELECT tile_key, max(c) + 1 AS w FROM fx_labels GROUP BY 1) SELECT tile_key, r, (w - 1 - c)::INT AS c, label FROM fx_labels JOIN x USING (tile_key) WHERE label <> 255")
def x3(s, d):
    """User transforms chained on a DataFrame."""
    from ..operators.grid import flip

    return X.labels(s, d).transform(lambda p: flip(p, "h")).transform(lambda p: p.where("label <> 255")).select("tile_key", "r", "c", "label")
