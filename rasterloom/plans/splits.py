"""Queries: splits, weights, key joins, set operations, logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import hist as H
from ..operators import runs as R
from ..operators import split as P
from ..operators import weights as W
from ..sources import fixtures as X
from .registry import query, r6

COUNTS = ", k AS (SELECT i::INT AS cls, coalesce(sum(n), 0)::BIGINT AS n FROM range(13) g(i) LEFT JOIN fx_hist ON cls = i GROUP BY ALL)"


def counts(s, d):
    return H.class_totals(X.tiles(s, d), X.histograms(s, d))


def weighted(w):
    return w.select("cls", "n", r6("weight").alias("weight"))


@query("a9_weight_inverse", COUNTS + ", w AS (SELECT *, (sum(n) OVER ()) / (n + 1e-12) / 13 AS w FROM k) SELECT cls, n, round(w / (avg(w) OVER () + 1e-12), 6) + 0.0 AS weight FROM w")
def a9(s, d):
    return weighted(W.inverse_frequency(counts(s, d)))


@query("a10_weight_median", COUNTS + ", f AS (SELECT *, n / (sum(n) OVER () + 1e-12) AS f FROM k), w AS (SELECT *, CASE WHEN f > 0 THEN (SELECT median(f) FROM f WHERE f > 0) / (f + 1e-12) ELSE 0 END AS w FROM f)"
       " SELECT cls, n, round(w / (avg(w) OVER () + 1e-12), 6) + 0.0 AS weight FROM w")
def a10(s, d):
    return weighted(W.median_frequency(counts(s, d)))


@query("a11_weight_effective", COUNTS + ", w AS (SELECT *, 1.0::DOUBLE / ((1.0::DOUBLE - 0.9999::DOUBLE) / (1.0::DOUBLE - pow(0.9999::DOUBLE, n + 1e-12)) + 1e-12) AS w FROM k) SELECT cls, n, round(w / (avg(w) OVER () + 1e-12), 6) + 0.0 AS weight FROM w")
def a11(s, d):
    return weighted(W.effective_number(counts(s, d)))


@query("a11_weight_effective_corrected", COUNTS + ", w AS (SELECT *, (1.0::DOUBLE - 0.9999::DOUBLE) / (1.0::DOUBLE - pow(0.9999::DOUBLE, n + 1e-12)) AS w FROM k) SELECT cls, n, round(w / (avg(w) OVER () + 1e-12), 6) + 0.0 AS weight FROM w")
def a11c(s, d):
    return weighted(W.effective_number(counts(s, d), mode="corrected"))


LEGACY = COUNTS + ", w AS (SELECT *, 1.0::DOUBLE / (n + 1e-6) AS w FROM k), lw AS (SELECT cls, n, w * 13 / sum(w) OVER () AS weight FROM w)"


@query("a12_weight_legacy", LEGACY + " SELECT cls, n, round(weight, 6) + 0.0 AS weight FROM lw")
def a12(s, d):
    return weighted(W.legacy(counts(s, d)))


TILEW = LEGACY + ", tw AS (SELECT tile_key, sum(h.n * weight) / sum(h.n) AS weight FROM fx_hist h JOIN lw USING (cls) GROUP BY 1)"


@query("a13_sample_weight", TILEW + " SELECT tile_key, round(weight, 6) + 0.0 AS weight, round(pow(weight, 1.5::DOUBLE) / sum(pow(weight, 1.5::DOUBLE)) OVER (), 6) + 0.0 AS score FROM tw")
def a13(s, d):
    t = W.sample_weights(X.histograms(s, d), W.legacy(counts(s, d)).select("cls", "weight"))
    return t.select("tile_key", r6("weight").alias("weight"), r6("score").alias("score"))


@query("a14_weight_summary", TILEW + " SELECT round(min(weight), 6) + 0.0 AS lo, round(max(weight), 6) + 0.0 AS hi, round(avg(weight), 6) + 0.0 AS mean FROM tw")
def a14(s, d):
    t = W.sample_weights(X.histograms(s, d), W.legacy(counts(s, d)).select("cls", "weight"))
    return t.agg(r6(F.min("weight")).alias("lo"), r6(F.max("weight")).alias("hi"), r6(F.avg("weight")).alias("mean"))


@query("j12_pixel_weight", LEGACY + " SELECT tile_key, r, c, round(coalesce(weight, 1.0), 6) + 0.0 AS weight FROM fx_labels LEFT JOIN lw ON label = cls")
def j12(s, d):
    w = W.pixel_weights(X.labels(s, d), W.legacy(counts(s, d)).select("cls", "weight"))
    return w.select("tile_key", "r", "c", r6("weight").alias("weight"))


MASS = ", ms AS (SELECT tile_key, sum(n)::BIGINT AS mass FROM fx_hist GROUP BY 1), iv AS (SELECT tile_key, mass, sum(mass) OVER (ORDER BY md5(tile_key)) AS hi FROM ms)"


def intervals(s, d):
    return W.cumulative(X.histograms(s, d).groupBy("tile_key").agg(F.sum("n").alias("mass")))


@query("w15_cumulative_weights", MASS + " SELECT tile_key, (hi - mass)::BIGINT AS lo, hi::BIGINT AS hi FROM iv")
def w15(s, d):
    return intervals(s, d).select("tile_key", F.col("lo").cast("long"), F.col("hi").cast("long"))


@query("j9_weighted_draws", MASS + ", u AS (SELECT tile_id AS draw, tile_id * 7919 % (SELECT sum(mass) FROM ms) AS u FROM fx_tiles) SELECT draw, tile_key FROM u JOIN iv ON u >= hi - mass AND u < hi")
def j9(s, d):
    """Tiles drawn with replacement in proportion to their valid pixels."""
    i = intervals(s, d)
    total = i.agg(F.coalesce(F.max("hi"), F.lit(1))).first()[0]
    draws = X.tiles(s, d).select(F.col("tile_id").alias("draw"), (F.col("tile_id") * 7919 % int(total)).alias("u"))
    return W.draw(i, draws, int(total)).select("draw", "tile_key")


ALLOC = """, zn AS (SELECT zone, count(*) AS items FROM fx_tiles GROUP BY zone),
 a1 AS (SELECT *, items * ratio / 1.2::DOUBLE AS raw FROM zn CROSS JOIN (VALUES (0, 'train', 1.0::DOUBLE), (1, 'val', 0.1::DOUBLE), (2, 'test', 0.1::DOUBLE)) v(ord, split, ratio)),
 a2 AS (SELECT *, floor(raw)::BIGINT AS low, raw - floor(raw) AS frac FROM a1),
 a3 AS (SELECT *, items - sum(low) OVER (PARTITION BY zone) AS remain, row_number() OVER (PARTITION BY zone ORDER BY low = 0 DESC, ratio DESC, ord) AS zr FROM a2),
 a4 AS (SELECT *, (low = 0 AND items >= 3 AND zr <= remain)::INT AS give FROM a3),
 a5 AS (SELECT *, (remain - sum(give) OVER (PARTITION BY zone))::BIGINT AS rest, row_number() OVER (PARTITION BY zone ORDER BY frac DESC, ord) AS fr FROM a4),
 al AS (SELECT zone, split, ord, (low + give + rest // 3 + (fr <= rest % 3)::INT)::BIGINT AS n FROM a5)"""
SPLIT = ALLOC + """, rk AS (SELECT *, row_number() OVER (PARTITION BY zone ORDER BY md5('42:' || tile_key)) AS k FROM fx_tiles),
 sp AS (SELECT tile_key, zone, tile_id, CASE WHEN k <= (SELECT sum(n) FROM al WHERE al.zone = rk.zone AND ord = 0) THEN 'train'
  WHEN k <= (SELECT sum(n) FROM al WHERE al.zone = rk.zone AND ord <= 1) THEN 'val' ELSE 'test' END AS split FROM rk)"""


@query("w9_zone_alloc", ALLOC + " SELECT zone, split, n FROM al")
def w9(s, d):
    return P.allocate(X.tiles(s, d).groupBy("zone").agg(F.count("*").alias("items")))


@query("w10_stratified_split", SPLIT + " SELECT tile_key, zone, split FROM sp")
def w10(s, d):
    return P.stratified(X.tiles(s, d))


RR = " SELECT tile_key, zone, rank FROM (SELECT tile_key, zone, row_number() OVER (PARTITION BY zone ORDER BY md5('42:' || tile_key))::INT AS rank, min(tile_id) OVER (PARTITION BY zone) AS zo FROM sp WHERE split = '{}') ORDER BY rank, zo LIMIT {}"


@query("w11_train_cap", SPLIT + RR.format("train", 20))
def w11(s, d):
    t = P.stratified(X.tiles(s, d)).where("split = 'train'").join(X.tiles(s, d).select("tile_key", "tile_id"), "tile_key")
    return P.round_robin(t, 20, by_name=True)


@query("w12_val_downsample", SPLIT + " SELECT tile_key, zone, rank FROM (SELECT tile_key, zone, row_number() OVER (PARTITION BY zone ORDER BY md5('42:' || tile_key))::INT AS rank, min(tile_id) OVER (PARTITION BY zone) AS zo FROM sp WHERE split = 'val')"
       " ORDER BY rank, zo LIMIT 2")
def w12(s, d):
    """Validation tiles down to a tenth of 20 training tiles, zone after zone in the order of their first tile."""
    t = P.stratified(X.tiles(s, d)).where("split = 'val'").join(X.tiles(s, d).select("tile_key", "tile_id"), "tile_key")
    return P.round_robin(t, round(20 * 0.1))


@query("w13_unstratified_split", ", k AS (SELECT tile_key, row_number() OVER (ORDER BY md5('42:' || tile_key)) AS k, count(*) OVER () AS n FROM fx_tiles), b AS (SELECT *, round_even(n * 1.0::DOUBLE / (1.0::DOUBLE + 0.1::DOUBLE + 0.1::DOUBLE), 0) AS x, round_even(n * 0.1::DOUBLE / (1.0::DOUBLE + 0.1::DOUBLE + 0.1::DOUBLE), 0) AS y FROM k)"
       " SELECT tile_key, CASE WHEN k <= x THEN 'train' WHEN k <= x + y THEN 'val' ELSE 'test' END AS split FROM b")
def w13(s, d):
    return P.unstratified(X.tiles(s, d))


@query("w14_evenly_spaced", ", k AS (SELECT tile_key, row_number() OVER (ORDER BY tile_key) - 1 AS o, count(*) OVER () AS n FROM fx_tiles) SELECT tile_key, o::BIGINT AS ordinal FROM k WHERE o IN (SELECT i * (n - 1) // 6 FROM range(7) g(i))")
def w14(s, d):
    return P.evenly_spaced(X.tiles(s, d).select("tile_key"), "tile_key", 7)


@query("a20_zone_coverage", SPLIT + " SELECT zone, split FROM (SELECT DISTINCT zone FROM sp) CROSS JOIN (SELECT DISTINCT split FROM sp) WHERE (zone, split) NOT IN (SELECT zone, split FROM sp WHERE tile_id % 4 <> 0)")
def a20(s, d):
    """Zones that lack a split once every fourth tile is gone."""
    sp = P.stratified(X.tiles(s, d)).join(X.tiles(s, d).select("tile_key", "tile_id"), "tile_key")
    return P.uncovered_zones(sp, sp.where("tile_id % 4 <> 0"))


@query("m1_multilabel_split", """, tot AS (SELECT cls, sum(n) AS a FROM fx_hist GROUP BY 1), st AS (SELECT tile_key, arg_min(cls, a * 100 + cls) AS zone FROM fx_hist JOIN tot USING (cls) GROUP BY 1)
 SELECT zone AS stratum, count(*) AS n FROM st GROUP BY 1""")
def m1_strata(s, d):
    """Strata of the multilabel split: the rarest class of each tile."""
    return P.rarest_class(X.histograms(s, d)).groupBy(F.col("zone").alias("stratum")).agg(F.count("*").alias("n"))


@query("m1_multilabel_split_sizes")
def m1(s, d):
    """Split sizes within each stratum; the same proportions as a stratified split of zones."""
    return P.stratified(P.rarest_class(X.histograms(s, d))).groupBy("zone", "split").agg(F.count("*").alias("n"))


@query("m1_iterative_split")
def m1_iterative(s, d):
    """Tiles by all of their classes at once: iterative stratification, the rarest class first."""
    t = X.histograms(s, d).groupBy("tile_key").agg(F.collect_set("cls").alias("labels"))
    return P.multilabel(t, (0.7, 0.15, 0.15))


@query("m2_subsample", ", k AS (SELECT tile_key, row_number() OVER (ORDER BY md5('42:' || tile_key)) AS k, count(*) OVER () AS n FROM fx_tiles) SELECT tile_key FROM k WHERE k <= floor(n * 0.35::DOUBLE)")
def m2(s, d):
    return P.subsample(X.tiles(s, d), 0.35)


def role(s, d, name):
    return X.paths(s, d).where(F.col("role") == name).select("tile_key")


@query("j1_four_way_keys", "SELECT tile_key FROM fx_paths WHERE role IN ('image', 'label', 'group', 'array_label') GROUP BY 1 HAVING count(DISTINCT role) = 4")
def j1(s, d):
    k = role(s, d, "image")
    for other in ("label", "group", "array_label"):
        k = k.join(role(s, d, other), "tile_key", "left_semi")
    return k.distinct()


@query("j2_pairing", "SELECT tile_key, tile_id FROM fx_tiles WHERE tile_key IN (SELECT tile_key FROM fx_paths WHERE role = 'label')")
def j2(s, d):
    return X.tiles(s, d).select("tile_key", "tile_id").join(role(s, d, "label"), "tile_key", "left_semi")


@query("j3_selection_coverage", ", h AS (SELECT DISTINCT tile_key FROM fx_hist JOIN fx_tiles USING (tile_key) WHERE tile_id % 5 <> 0) SELECT count(h.tile_key) AS covered, count(*) - count(h.tile_key) AS missing FROM fx_tiles LEFT JOIN h USING (tile_key)")
def j3(s, d):
    cached = X.histograms(s, d).join(X.tiles(s, d).where("tile_id % 5 <> 0").select("tile_key"), "tile_key", "left_semi")
    return H.coverage(X.tiles(s, d).select("tile_key"), cached)


@query("j4_missing_labels", "SELECT tile_key FROM fx_tiles WHERE tile_key NOT IN (SELECT tile_key FROM fx_paths WHERE role = 'label')")
def j4(s, d):
    return X.tiles(s, d).join(role(s, d, "label"), "tile_key", "left_anti").select("tile_key")


@query("u1_union_roots", "SELECT path FROM fx_paths WHERE role = 'image' UNION ALL SELECT path FROM fx_paths WHERE role IN ('image', 'group')")
def u1(s, d):
    p = X.paths(s, d)
    return p.where("role = 'image'").select("path").unionByName(p.where("role in ('image', 'group')").select("path"))


@query("u2_intersect_keys", "SELECT tile_key FROM fx_paths WHERE role = 'label' INTERSECT SELECT tile_key FROM fx_paths WHERE role = 'array_label'")
def u2(s, d):
    return role(s, d, "label").intersect(role(s, d, "array_label"))


@query("u3_except_keys", "SELECT tile_key FROM fx_paths WHERE role = 'image' EXCEPT SELECT tile_key FROM fx_paths WHERE role = 'label'")
def u3(s, d):
    return role(s, d, "image").subtract(role(s, d, "label"))


@query("u4_append_new", SPLIT + " SELECT tile_key, 'train' AS split FROM sp WHERE split = 'train' UNION ALL SELECT tile_key, 'train' FROM fx_tiles WHERE tile_id % 4 = 0 AND tile_key NOT IN (SELECT tile_key FROM sp WHERE split = 'train')")
def u4(s, d):
    """Pseudo-labelled tiles join the training split if they are not in it."""
    train = P.stratified(X.tiles(s, d)).where("split = 'train'").select("tile_key", "split")
    return P.append_new(train, X.tiles(s, d).where("tile_id % 4 = 0").select("tile_key"), "train")


@query("a40_ordered_distinct", "SELECT raw_label, min(r * 32 + c)::INT AS ord FROM fx_pixels GROUP BY 1")
def a40(s, d):
    return X.pixels(s, d).groupBy("raw_label").agg(F.min(F.expr("r * 32 + c")).alias("ord"))


STATUS = ", st AS (SELECT tile_key, CASE WHEN max(r) + 1 < 19 THEN 'too_small' WHEN max(label) FILTER (label <> 255) IS NULL THEN 'no_class' WHEN max(label) FILTER (label <> 255) < 12 THEN 'low_classes' ELSE 'ok' END AS status FROM fx_labels GROUP BY 1)"


def statuses(s, d):
    top = F.max(F.when(F.col("label") != 255, F.col("label")))
    t = X.labels(s, d).groupBy("tile_key").agg(F.max("r").alias("rows"), top.alias("top"))
    st = F.when(F.col("rows") + 1 < 19, "too_small").when(F.col("top").isNull(), "no_class").when(F.col("top") < 12, "low_classes").otherwise("ok")
    return t.select("tile_key", st.alias("status"))


@query("p15_validate_pair", STATUS + " SELECT tile_key, status FROM st")
def p15(s, d):
    return statuses(s, d)


@query("a17_status_counts", STATUS + " SELECT status, count(*) AS n FROM st GROUP BY 1")
def a17(s, d):
    return statuses(s, d).groupBy("status").agg(F.count("*").alias("n"))


@query("a18_missing_totals", "SELECT count(*) AS images, count(*) FILTER (tile_key NOT IN (SELECT tile_key FROM fx_paths WHERE role = 'label')) AS missing FROM fx_paths WHERE role = 'image'")
def a18(s, d):
    have = role(s, d, "label").withColumn("hit", F.lit(1))
    return role(s, d, "image").join(have, "tile_key", "left").agg(F.count("*").alias("images"), F.count_if(F.col("hit").isNull()).alias("missing"))


@query("x4_skip_bad", STATUS + " SELECT tile_key FROM st WHERE status = 'ok'")
def x4(s, d):
    return statuses(s, d).where("status = 'ok'").select("tile_key")


@query("w16_best_epoch", "SELECT run, epoch FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY f1 DESC, epoch) AS k FROM fx_epochs) WHERE k = 1")
def w16(s, d):
    """Epoch of the highest f1 of each run, the earliest of ties."""
    return X.epochs(s, d).groupBy("run").agg(F.max_by("epoch", F.struct("f1", -F.col("epoch"))).alias("epoch"))


NAMES = """, a AS (SELECT run, epoch, 'run' || run || '/' || CASE WHEN run % 4 = 3 THEN 'model_' || lpad(epoch::VARCHAR, 3, '0') ELSE 'epoch-' || epoch END
  || CASE run % 4 WHEN 0 THEN '_F1=' WHEN 1 THEN '_mIoU-' ELSE '_' END || round(f1, 4)::DECIMAL(6,4) || '.pt' AS path FROM fx_epochs),
 v AS (SELECT *, coalesce(nullif(regexp_extract(path, '[fF]1=([0-9.]+[0-9])', 1), ''), nullif(regexp_extract(path, 'IoU-([0-9.]+[0-9])', 1), ''), nullif(regexp_extract(path, '/[a-z]+[-_]?[0-9]+_([0-9.]+[0-9])', 1), ''))::DOUBLE AS v FROM a)"""


def artifacts(s, d):
    """A saved file of each epoch, with its f1 in the name in one of four ways."""
    e = X.epochs(s, d)
    n = F.col("epoch").cast("string")
    head = F.when(F.col("run") % 4 == 3, F.concat(F.lit("model_"), F.lpad(n, 3, "0"))).otherwise(F.concat(F.lit("epoch-"), n))
    tag = F.when(F.col("run") % 4 == 0, "_F1=").when(F.col("run") % 4 == 1, "_mIoU-").otherwise("_")
    value = F.round("f1", 4).cast("decimal(6,4)").cast("string")
    return e.select("run", F.concat(F.lit("run"), F.col("run").cast("string"), F.lit("/"), head, tag, value, F.lit(".pt")).alias("path"))


@query("w17_best_artifact", NAMES + " SELECT run, path FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY v DESC, path) AS k FROM v) WHERE k = 1")
def w17(s, d):
    """Best checkpoint by the metric in its name: f1, else iou, else the second number."""
    return R.best_artifact(artifacts(s, d))


@query("w17_best_epoch_artifact", NAMES + ", b AS (SELECT run, epoch FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY f1 DESC, epoch) AS k FROM fx_epochs) WHERE k = 1) SELECT run, path FROM v JOIN b USING (run, epoch)")
def w17_epoch(s, d):
    """Checkpoint of the epoch that a run noted as its best, found by the number in the name."""
    best = X.epochs(s, d).groupBy("run").agg(F.max_by("epoch", F.struct("f1", -F.col("epoch"))).alias("epoch"))
    return R.best_artifact(artifacts(s, d), best)


STOP = """, m AS (SELECT *, min({v}) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM fx_epochs),
 i AS (SELECT *, coalesce({v} < best, true) AS better, coalesce(max(CASE WHEN best IS NULL OR {v} < best THEN epoch END) OVER (PARTITION BY run ORDER BY epoch), 0) AS last FROM m)
 SELECT run, min(epoch) FILTER (NOT better AND epoch % {every} <> 0 AND epoch - last >= {patience}) AS stop FROM i GROUP BY run"""


@query("w18_early_stop", STOP.format(v="loss", every=5, patience=5))
def w18(s, d):
    """First unsaved epoch five or more past the last improvement of the loss; null if there is none."""
    return R.early_stop(X.epochs(s, d), patience=5, save_every=5)


@query("w18_early_stop_f1", STOP.format(v="(-f1)", every=4, patience=8))
def w18_f1(s, d):
    """The same for the highest f1, with checkpoints at every fourth epoch."""
    return R.early_stop(X.epochs(s, d), patience=8, save_every=4, metric="f1")
