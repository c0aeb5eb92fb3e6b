"""Queries: accuracy, losses, segments, clusters, spatial joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bands as B
from ..operators import blocks as L
from ..operators import cluster as K
from ..operators import density as N
from ..operators import metrics as M
from ..operators import neighbours as NB
from ..operators import score as C
from ..operators import split as P
from ..operators import weights as W
from ..sources import fixtures as X
from .registry import query, r6
from .splits import LEGACY, counts

CONF = ", cf AS (SELECT label AS truth, pred, count(*) AS n FROM fx_pred WHERE label <> 255 GROUP BY ALL)"
PER = CONF + ", pc AS (SELECT i::INT AS cls, coalesce(sum(n) FILTER (truth = i AND pred = i), 0)::BIGINT AS tp, coalesce(sum(n) FILTER (truth <> i AND pred = i), 0)::BIGINT AS fp, coalesce(sum(n) FILTER (truth = i AND pred <> i), 0)::BIGINT AS fn, coalesce(sum(n) FILTER (truth = i), 0)::BIGINT AS support FROM range(13) g(i) CROSS JOIN cf GROUP BY i)"


def per(s, d):
    return M.per_class(M.confusion(X.predictions(s, d)), 13)


@query("j8_truth_prediction", "SELECT a.tile_key, count(*) AS n, count(*) FILTER (a.label = b.pred) AS hits FROM fx_labels a JOIN fx_pred b ON a.tile_key = b.tile_key AND a.r = b.r AND a.c = b.c GROUP BY 1")
def j8(s, d):
    p = X.predictions(s, d).select("tile_key", "r", "c", "pred")
    j = X.labels(s, d).select("tile_key", "r", "c", "label").join(p, ["tile_key", "r", "c"])
    return j.groupBy("tile_key").agg(F.count("*").alias("n"), F.count_if(F.col("label") == F.col("pred")).alias("hits"))


@query("j8_key_audit", "SELECT tile_key, a.tile_key IS NOT NULL AS truth, b.tile_key IS NOT NULL AS predicted FROM (SELECT tile_key FROM fx_tiles WHERE tile_id % 7 <> 0) a FULL JOIN (SELECT tile_key FROM fx_tiles WHERE tile_id % 5 <> 0) b USING (tile_key) WHERE a.tile_key IS NULL OR b.tile_key IS NULL")
def j8_audit(s, d):
    t = X.tiles(s, d)
    a = t.where("tile_id % 7 <> 0").select("tile_key", F.lit(True).alias("truth"))
    b = t.where("tile_id % 5 <> 0").select("tile_key", F.lit(True).alias("predicted"))
    j = a.join(b, "tile_key", "full").select("tile_key", F.col("truth").isNotNull().alias("truth"), F.col("predicted").isNotNull().alias("predicted"))
    return j.where("not truth or not predicted")


@query("a21_confusion", CONF + " SELECT truth, pred, n FROM cf")
def a21(s, d):
    return M.confusion(X.predictions(s, d))


@query("a22_row_normalised", CONF + " SELECT truth, pred, round(n / sum(n) OVER (PARTITION BY truth), 6) + 0.0 AS share FROM cf")
def a22(s, d):
    return M.row_normalised(M.confusion(X.predictions(s, d))).select("truth", "pred", r6("share").alias("share"))


@query("a23_class_scores", PER + " SELECT cls, support, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) + 0.0 AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) + 0.0 AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) + 0.0 AS f1 FROM pc")
def a23(s, d):
    return M.scores(per(s, d)).select("cls", "support", *[r6(c).alias(c) for c in ("precision", "recall", "f1")])


@query("a24_mean_scores", PER + """, e AS (SELECT *, tp / (tp + fp + fn + 1e-9) AS eiou, tp / (tp + fp + 1e-9) AS p, tp / (tp + fn + 1e-9) AS r, tp + fp + fn AS u FROM pc)
 SELECT round(avg(eiou), 6) AS miou_eps_mean, round(avg(CASE WHEN u > 0 THEN tp / u END), 6) AS miou_skip_empty, round(avg(2 * p * r / (p + r + 1e-9)), 6) AS f1_eps_mean,
  round(avg(CASE WHEN u > 0 THEN 2 * tp / (2 * tp + fp + fn) END), 6) AS f1_macro_present, round(sum(tp) / sum(support), 6) AS accuracy FROM e""")
def a24(s, d):
    m = M.mean_scores(per(s, d))
    return m.select(*[F.round(c, 6).alias(c) for c in m.columns])


@query("a24_accuracy_all", "SELECT round(count(*) FILTER (label = pred) / count(*), 6) AS accuracy FROM fx_pred")
def a24_all(s, d):
    """Ignored pixels stay in the denominator."""
    return X.predictions(s, d).agg(F.round(F.count_if(F.col("label") == F.col("pred")) / F.count("*"), 6).alias("accuracy"))


PROB = """, lg AS (SELECT vec_id, tile_key, r, c, label, unnest(range(13))::INT AS cls, unnest(logits) AS x FROM fx_logits),
 ex AS (SELECT *, exp(x - max(x) OVER (PARTITION BY vec_id)) AS e FROM lg), pr AS (SELECT *, e / sum(e) OVER (PARTITION BY vec_id) AS p FROM ex)"""


def probs(s, d):
    return X.logits(s, d).withColumn("probs", C.softmax())


@query("a36_cross_entropy", LEGACY + PROB + " SELECT round(sum(w * -ln(p)) / sum(w), 6) AS loss FROM (SELECT p, coalesce(weight, 1.0) AS w FROM pr LEFT JOIN lw ON lw.cls = label WHERE pr.cls = label)")
def a36(s, d):
    """Cross-entropy of the valid pixels, each weighted by its class's stored weight."""
    p = W.pixel_weights(probs(s, d), W.legacy(counts(s, d)).select("cls", "weight"))
    return M.cross_entropy(p.where("label between 0 and 12").withColumn("p", F.get("probs", F.col("label")))).select(F.round("loss", 6).alias("loss"))


EDGE = """, mk AS (SELECT tile_key, r, c, CASE WHEN label = 255 THEN 0 ELSE label END <> 0 AS m FROM fx_logits),
 nb AS (SELECT DISTINCT tile_key, r + a AS r, c + b AS c FROM mk CROSS JOIN (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) v(a, b) WHERE m),
 ew AS (SELECT mk.tile_key, mk.r, mk.c, CASE WHEN nb.r IS NOT NULL AND NOT m THEN 0.4::DOUBLE ELSE 1.0::DOUBLE END AS w FROM mk LEFT JOIN nb ON nb.tile_key = mk.tile_key AND nb.r = mk.r AND nb.c = mk.c),
 fo AS (SELECT sum(0.25::DOUBLE * pow(1 - p, 2) * -ln(p) * w) / greatest(sum(w), 1e-8) AS loss FROM pr JOIN ew USING (tile_key, r, c) WHERE cls = label)"""


def focal(s, d):
    """Focal loss of the valid pixels, which weigh 0.4 on edges."""
    edge = L.edge_mask(X.logits(s, d))
    p = probs(s, d).where("label <> 255").join(edge, ["tile_key", "r", "c"])
    return M.focal(p.withColumn("p", F.get("probs", F.col("label"))).withColumn("weight", F.when(F.col("edge") == 1, 0.4).otherwise(1.0)))


@query("a37_focal", PROB + EDGE + " SELECT round(loss, 6) AS loss FROM fo")
def a37(s, d):
    return focal(s, d).select(F.round("loss", 6).alias("loss"))


def long_probs(s, d):
    return probs(s, d).select("tile_key", "r", "c", "label", F.posexplode("probs").alias("cls", "p")).withColumn("hit", F.col("cls") == F.least("label", F.lit(12)))


TVERSKY = ", tv AS (SELECT 1 - avg((tp + 1e-6) / (tp + 0.7::DOUBLE * fp + 0.3::DOUBLE * fn + 1e-6)) AS loss FROM (SELECT cls, sum(p * (cls = least(label, 12))::INT) AS tp, sum(p * (cls <> least(label, 12))::INT) AS fp, sum((1 - p) * (cls = least(label, 12))::INT) AS fn FROM pr GROUP BY 1))"


@query("a38_tversky", PROB + TVERSKY + " SELECT round(loss, 6) AS loss FROM tv")
def a38(s, d):
    return M.tversky(long_probs(s, d), 13).select(F.round("loss", 6).alias("loss"))


BOUNDARY = """, mc AS (SELECT tile_key, r, c, i::INT AS cls, label = i AS m FROM fx_logits CROSS JOIN range(13) g(i)),
 ds AS (SELECT x.tile_key, x.cls, x.r, x.c, x.m, min((x.r - y.r) ** 2 + (x.c - y.c) ** 2) FILTER (y.m <> x.m) AS d2, bool_or(y.m) AS has, greatest(max(y.r), max(y.c)) + 2 AS far
  FROM mc x JOIN mc y ON x.tile_key = y.tile_key AND x.cls = y.cls GROUP BY ALL),
 sd AS (SELECT tile_key, cls, r, c, CASE WHEN NOT has THEN 0.0 WHEN m THEN -coalesce(sqrt(d2), far) ELSE sqrt(d2) END AS sd FROM ds),
 nd AS (SELECT *, (sd - min(sd) OVER w) / (max(sd) OVER w - min(sd) OVER w + 1e-8) AS d FROM sd WINDOW w AS (PARTITION BY tile_key, cls)),
 tl AS (SELECT cls, tile_key, 1 - 2 * sum(p * d) / (sum(p * p) + sum(d * d) + 1e-6) AS loss FROM pr JOIN nd USING (tile_key, cls, r, c) GROUP BY ALL),
 bd AS (SELECT avg(loss) AS loss FROM (SELECT cls, avg(loss) AS loss FROM tl GROUP BY cls))"""


def boundary(s, d):
    """Boundary Dice of all 13 classes with the signed distances in each 5 x 5 tile."""
    sd = L.signed_distances(X.logits(s, d).select("tile_key", "r", "c", "label"), list(range(13))).select("tile_key", "r", "c", F.posexplode("sd").alias("cls", "sd"))
    return M.boundary_dice(long_probs(s, d).join(sd, ["tile_key", "cls", "r", "c"]))


@query("a39_boundary_dice", PROB + BOUNDARY + " SELECT round(loss, 6) AS loss FROM bd")
def a39(s, d):
    return boundary(s, d).select(F.round("loss", 6).alias("loss"))


@query("a38_combined_loss", PROB + EDGE + TVERSKY + BOUNDARY + " SELECT round(0.5::DOUBLE * fo.loss + 0.5::DOUBLE * tv.loss + 0.4::DOUBLE * bd.loss, 6) AS loss FROM fo CROSS JOIN tv CROSS JOIN bd")
def a38_combined(s, d):
    """Half focal, half Tversky, and 0.4 times the boundary Dice."""
    total = M.combined_loss(focal(s, d), M.tversky(long_probs(s, d), 13), boundary(s, d))
    return total.select(F.round("loss", 6).alias("loss"))


@query("a25_segment_majority", ", n AS (SELECT tile_key, segment_id, label, count(*) AS n FROM fx_segments WHERE label <> 255 GROUP BY ALL), t AS (SELECT *, row_number() OVER (PARTITION BY tile_key, segment_id ORDER BY n DESC, label) AS k FROM n)"
       " SELECT m.tile_key, m.segment_id, m.cr, m.cc, t.label AS major FROM (SELECT tile_key, segment_id, floor(avg(r))::INT AS cr, floor(avg(c))::INT AS cc FROM fx_segments GROUP BY ALL) m LEFT JOIN t ON t.tile_key = m.tile_key AND t.segment_id = m.segment_id AND k = 1")
def a25(s, d):
    return K.segment_majority(X.segments(s, d))


@query("j14_last_mask", ", m AS (SELECT tile_key, r, c, segment_id, ord FROM fx_segments UNION ALL SELECT tile_key, r, c + 1, segment_id, ord FROM fx_segments) SELECT tile_key, r, c, segment_id FROM (SELECT *, row_number() OVER (PARTITION BY tile_key, r, c ORDER BY ord DESC, segment_id DESC) AS k FROM m) WHERE k = 1")
def j14(s, d):
    """Masks that overlap by one column; the later one wins."""
    m = X.segments(s, d).select("tile_key", "r", "c", "segment_id", "ord")
    return K.last_mask(m.unionByName(m.withColumn("c", F.col("c") + 1)))


@query("a26_medoid", ", v AS (SELECT tile_key, any_value(label) AS z, list_transform(range(1, 65), lambda i: 0.0) AS o FROM fx_embed GROUP BY 1), m AS (SELECT tile_key, i, avg(bands[i]) AS x FROM fx_embed CROSS JOIN range(1, 65) g(i) GROUP BY ALL),"
       " k AS (SELECT tile_key, split_part(tile_key, '_', 1)::INT - 32630 AS cluster FROM (SELECT DISTINCT tile_key FROM fx_embed)), c AS (SELECT cluster, i, avg(x) AS x FROM m JOIN k USING (tile_key) WHERE cluster <> 5 GROUP BY ALL),"
       " d AS (SELECT k.cluster, m.tile_key, round(sum((m.x - c.x) ** 2), 9) AS d FROM m JOIN k USING (tile_key) JOIN c ON c.cluster = k.cluster AND c.i = m.i GROUP BY ALL) SELECT cluster, tile_key FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY d, tile_key) AS k FROM d) WHERE k = 1")
def a26(s, d):
    """Tile nearest the mean of its zone; zone 32635 plays the noise."""
    t = B.tile_means(X.embed(s, d), 64)
    c = F.substring_index("tile_key", "_", 1).cast("int") - 32630
    return K.medoids(t.withColumn("cluster", F.when(c == 5, -1).otherwise(c)))


@query("m3_pixel_kmeans")
def m3(s, d):
    """Pseudo-labels by k-means on the bands of each pixel."""
    return K.kmeans(X.embed(s, d), 5).select("tile_key", "r", "c", "cluster")


@query("m4_reduced_kmeans")
def m4(s, d):
    """K-means after principal components."""
    return K.kmeans(K.reduce_dimensions(X.embed(s, d), 8), 5, "reduced").select("tile_key", "r", "c", "cluster")


@query("m4_nearest_tiles", """, v AS (SELECT tile_key, i, avg(bands[i]) AS x FROM fx_embed CROSS JOIN range(1, 65) g(i) GROUP BY ALL), l AS (SELECT tile_key, sqrt(sum(x * x)) AS l FROM v GROUP BY 1),
 p AS (SELECT a.tile_key, b.tile_key AS other, round(sum((a.x / la.l - b.x / lb.l) ** 2) / 2, 9) AS d FROM v a JOIN v b ON a.i = b.i AND a.tile_key <> b.tile_key JOIN l la ON la.tile_key = a.tile_key JOIN l lb ON lb.tile_key = b.tile_key GROUP BY ALL),
 k AS (SELECT tile_key, row_number() OVER (PARTITION BY tile_key ORDER BY d, md5(other))::INT AS k, other, d FROM p) SELECT tile_key, k, other, round(d, 6) + 0.0::DOUBLE AS d FROM k WHERE k <= 15""")
def m4_nearest(s, d):
    """The 15 nearest other tiles of each tile, by the cosine of tile means."""
    n = NB.nearest_tiles(B.tile_means(X.embed(s, d), 64), 15)
    return n.select("tile_key", "k", "other", r6("d").alias("d"))


@query("m4_graph_clusters")
def m4_graph(s, d):
    """Density clusters of tile means that a neighbour graph has reduced to two dimensions."""
    low = NB.reduce_by_neighbours(B.tile_means(X.embed(s, d), 64), 2, 15)
    return N.density_clusters(low.withColumnRenamed("reduced", "vec"), 5, 3)


@query("m5_tile_clusters")
def m5(s, d):
    """Clusters of tile means; those with fewer than three members are noise."""
    return K.drop_small(K.kmeans(B.tile_means(X.embed(s, d), 64), 4, "vec"), 3).select("tile_key", "cluster")


@query("m5_density_clusters")
def m5_density(s, d):
    """Density clusters of tile means: at least five tiles, noise is -1."""
    return N.density_clusters(B.tile_means(X.embed(s, d), 64), 5, 3)


def seeds(s, d):
    """Medoids of the clusters of tile means."""
    return K.medoids(K.drop_small(K.kmeans(B.tile_means(X.embed(s, d), 64), 4, "vec"), 3))


@query("m6_seed_tiles")
def m6(s, d):
    """Seed tiles: cluster, medoid, majority label of the medoid's pixels."""
    n = X.embed(s, d).join(seeds(s, d), "tile_key").groupBy("cluster", "tile_key", "label").agg(F.count("*").alias("n"))
    return n.groupBy("cluster", "tile_key").agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("label"))


@query("m6_pseudo_labels")
def m6_labels(s, d):
    """Pixels of the seed tiles with the majority label of their segment; a segment is a cluster of pixels."""
    tile = X.embed(s, d).join(seeds(s, d).select("tile_key"), "tile_key", "left_semi")
    return K.relabel(K.kmeans(tile, 3).withColumnRenamed("cluster", "segment_id"))


@query("m6_merged_split")
def m6_merged(s, d):
    """The training split with the seed tiles that are not in it yet."""
    tiles = X.embed(s, d).select("tile_key", "zone").distinct()
    train = P.stratified(tiles).where("split = 'train'").select("tile_key", "split")
    return P.append_new(train, seeds(s, d).select("tile_key"), "train")


XY = ", g AS (SELECT tile_id AS cell_id, (tile_id % 10)::DOUBLE AS xmin, (tile_id // 10)::DOUBLE AS ymin, (tile_id % 10 + 1)::DOUBLE AS xmax, (tile_id // 10 + 1)::DOUBLE AS ymax FROM fx_tiles)"


def cells(s, d):
    t = X.tiles(s, d)
    x, y = (F.col("tile_id") % 10).cast("double"), F.floor(F.col("tile_id") / 10).cast("double")
    return t.select(F.col("tile_id").alias("cell_id"), x.alias("xmin"), y.alias("ymin"), (x + 1).alias("xmax"), (y + 1).alias("ymax"))


@query("j7_box_intersect", XY + ", b AS (SELECT s_suppkey AS box_id, s_nationkey % 10 + 0.25 AS xmin, s_suppkey % 10 + 0.25 AS ymin, s_nationkey % 10 + 1.5 AS xmax, s_suppkey % 10 + 1.75 AS ymax FROM supplier) SELECT cell_id, box_id FROM g JOIN b ON g.xmin <= b.xmax AND b.xmin <= g.xmax AND g.ymin <= b.ymax AND b.ymin <= g.ymax")
def j7(s, d):
    b = X.table(s, d, "supplier").selectExpr("s_suppkey as box_id", "s_nationkey % 10 + 0.25D as xmin", "s_suppkey % 10 + 0.25D as ymin", "s_nationkey % 10 + 1.5D as xmax", "s_suppkey % 10 + 1.75D as ymax")
    return K.boxes_touching(cells(s, d), b, 2.0)


RING = [(1.2, 0.3), (8.7, 1.1), (9.4, 6.8), (5.1, 3.9), (2.2, 8.6)]


@query("j7_outline_exact", XY + ", p AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {x}::DOUBLE, {y}::DOUBLE)" for i, (x, y) in enumerate(RING)) + ") v(i, x, y)), e AS (SELECT a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM p a JOIN p b ON b.i = (a.i + 1) % 5),"
       " h AS (SELECT cell_id, count(*) AS n FROM (SELECT cell_id, (xmin + xmax) / 2 AS cx, (ymin + ymax) / 2 AS cy FROM g) JOIN e ON (y1 > cy) <> (y2 > cy) AND cx < x1 + (cy - y1) * (x2 - x1) / (y2 - y1) GROUP BY 1) SELECT cell_id, 0 AS ring_id FROM h WHERE n % 2 = 1")
def j7_exact(s, d):
    """Cells of a grid whose centre lies within an outline."""
    e = [(0, *RING[i], *RING[(i + 1) % len(RING)]) for i in range(len(RING))]
    return K.centres_inside(cells(s, d), s.createDataFrame(e, "ring_id int, x1 double, y1 double, x2 double, y2 double"))


STAR = [(1.0, 0.2), (0.1, 0.9), (-0.9, 0.4), (-0.6, -0.8), (0.7, -0.7)]
OUTLINES = XY + """, cn AS (SELECT n_nationkey AS geom_id, n_nationkey % 5 * 2 + 0.37::DOUBLE AS cx, n_nationkey * 7 % 11 + 0.21::DOUBLE AS cy, 0.4::DOUBLE + n_nationkey % 4 * 0.9::DOUBLE AS size FROM nation),
 rg AS (SELECT geom_id, cx, cy, size FROM cn UNION ALL SELECT geom_id, cx, cy, size * 0.5::DOUBLE FROM cn WHERE geom_id % 3 = 0),
 st(i, dx, dy) AS (VALUES """ + ", ".join(f"({i}, {x}::DOUBLE, {y}::DOUBLE)" for i, (x, y) in enumerate(STAR)) + """),
 e AS (SELECT geom_id, cx + size * a.dx AS x1, cy + size * a.dy AS y1, cx + size * b.dx AS x2, cy + size * b.dy AS y2 FROM rg CROSS JOIN st a JOIN st b ON b.i = (a.i + 1) % 5),
 sd AS (SELECT g.*, e.*, (xmin - x1) * (y2 - y1) - (ymin - y1) * (x2 - x1) AS s1, (xmin - x1) * (y2 - y1) - (ymax - y1) * (x2 - x1) AS s2, (xmax - x1) * (y2 - y1) - (ymin - y1) * (x2 - x1) AS s3,
   (xmax - x1) * (y2 - y1) - (ymax - y1) * (x2 - x1) AS s4, (xmin + xmax) / 2 AS mx, (ymin + ymax) / 2 AS my FROM g CROSS JOIN e)
 SELECT cell_id, geom_id FROM sd GROUP BY ALL
 HAVING bool_or(least(x1, x2) <= xmax AND greatest(x1, x2) >= xmin AND least(y1, y2) <= ymax AND greatest(y1, y2) >= ymin AND least(s1, s2, s3, s4) <= 0 AND greatest(s1, s2, s3, s4) >= 0)
   OR count(*) FILTER ((y1 > my) <> (y2 > my) AND mx < x1 + (my - y1) * (x2 - x1) / (y2 - y1)) % 2 = 1"""


@query("j7_outline_intersect", OUTLINES)
def j7_outlines(s, d):
    """Cells that outlines touch or cover: a star for each nation, every third one with a hole."""
    n = F.col("n_nationkey")
    c = X.table(s, d, "nation").select(n.alias("geom_id"), (n % 5 * 2 + 0.37).alias("cx"), (n * 7 % 11 + 0.21).alias("cy"), (0.4 + n % 4 * 0.9).alias("size"))
    rings = c.unionByName(c.where("geom_id % 3 = 0").withColumn("size", F.col("size") * 0.5))
    at = lambda i, k: F.col(("cx", "cy")[k]) + F.col("size") * STAR[i % 5][k]
    e = rings.select("geom_id", F.explode(F.array(*[F.struct(at(i, 0).alias("x1"), at(i, 1).alias("y1"), at(i + 1, 0).alias("x2"), at(i + 1, 1).alias("y2")) for i in range(5)])).alias("e")).select("geom_id", "e.*")
    return K.outlines_touching(cells(s, d), e, 2.0)
