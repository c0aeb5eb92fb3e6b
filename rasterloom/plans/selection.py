"""Queries: keys, labels, histograms, selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import keys as K
from ..functions import labels as L
from ..operators import hist as H
from ..operators import select as S
from ..sources import fixtures as X
from .registry import query, r6

KEY_SQL = r"""
, p AS (SELECT path, role, tile_id, regexp_extract(path, '([^/]*)$', 1) AS b FROM fx_paths)"""


def metrics(s, d):
    return H.tile_metrics(X.histograms(s, d))


@query("flagship", """
, m AS (SELECT *, CASE WHEN water_frac > 0.5 THEN 'water_gt_threshold' WHEN bg_frac > 0.9 THEN 'background_gt_threshold' END AS reason FROM fx_metrics),
a AS (SELECT *, row_number() OVER (PARTITION BY zone, reason IS NULL ORDER BY round(entropy, 9) DESC, tile_key) AS rank FROM m)
SELECT tile_key, zone, total, round(bg_frac, 6) AS bg_frac, round(water_frac, 6) AS water_frac, round(entropy, 6) + 0.0 AS entropy,
 coalesce(reason, 'ok') AS reason, CASE WHEN reason IS NULL THEN rank END AS rank, reason IS NULL AND rank <= 5 AS selected FROM a""")
def flagship(s, d):
    """Which tiles should train the model, and why were the others dropped?"""
    m = metrics(s, d).withColumn("reason", H.tile_reason())
    from pyspark.sql import Window

    w = Window.partitionBy("zone", F.col("reason").isNull()).orderBy(F.desc(F.round("entropy", 9)), "tile_key")
    m = m.withColumn("rank", F.row_number().over(w).cast("long"))
    ok = F.col("reason").isNull()
    return m.select("tile_key", "zone", "total", F.round("bg_frac", 6).alias("bg_frac"), F.round("water_frac", 6).alias("water_frac"), r6("entropy").alias("entropy"),
                    F.coalesce("reason", F.lit("ok")).alias("reason"), F.when(ok, F.col("rank")).alias("rank"), (ok & (F.col("rank") <= 5)).alias("selected"))


@query("p1_tile_key_generic", KEY_SQL + r"""
SELECT path, coalesce(nullif(regexp_extract(b, '(32[67][0-9]{2}_[0-9]+)', 1), ''),
  nullif(regexp_extract(b, '_(32[67][0-9]{2})_', 1), '') || '_' || nullif(regexp_extract(b, '(?i)([0-9]+)\.tif$', 1), '')) AS tile_key FROM p""")
def p1(s, d):
    return X.paths(s, d).select("path", K.key_generic(F.col("path")).alias("tile_key"))


@query("p1_tile_key_last_zone", KEY_SQL + r"""
, n AS (SELECT path, regexp_replace(b, '(.)\.[^.]*$', '\1') AS stem FROM p),
a AS (SELECT path, regexp_extract_all(stem, '([0-9]+)', 1) AS nums, regexp_extract_all(stem, '_([0-9]+)', 1) AS tails FROM n),
z AS (SELECT *, list_filter(nums, lambda x: regexp_full_match(x, '32[67][0-9]{2}'))[-1] AS zone, coalesce(tails[-1], nums[-1]) AS t FROM a),
y AS (SELECT *, CASE WHEN t = zone AND len(nums) >= 2 THEN nums[-2] ELSE t END AS tile FROM z)
SELECT path, CASE WHEN tile <> zone THEN zone || '_' || tile END AS tile_key FROM y""")
def p1_last(s, d):
    return X.paths(s, d).select("path", K.key_last_zone(F.col("path")).alias("tile_key"))


@query("p1_tile_key_north_only", KEY_SQL + r"""
SELECT path, nullif(regexp_extract(b, '_(326[0-9]{2})_', 1), '') || '_' || nullif(regexp_extract(b, '([0-9]+)\.tif$', 1), '') AS tile_key FROM p""")
def p1_north(s, d):
    return X.paths(s, d).select("path", K.key_north_only(F.col("path")).alias("tile_key"))


@query("p1_tile_key_strict", KEY_SQL + r"""
SELECT path, nullif(regexp_extract(b, '^google_embed_Europe_2018_10m_([0-9]+)_bands_(00|01_22|23_44|45_63)_([0-9]+)\.(?:tif|tiff)$', 1) || '_' ||
  regexp_extract(b, '^google_embed_Europe_2018_10m_([0-9]+)_bands_(00|01_22|23_44|45_63)_([0-9]+)\.(?:tif|tiff)$', 3), '_') AS tile_key,
  nullif(regexp_extract(b, '^google_embed_Europe_2018_10m_([0-9]+)_bands_(00|01_22|23_44|45_63)_([0-9]+)\.(?:tif|tiff)$', 2), '') AS band_group FROM p""")
def p1_strict(s, d):
    key, group = K.strict_parts(F.col("path"))
    return X.paths(s, d).select("path", key.alias("tile_key"), group.alias("band_group"))


@query("p2_zone_of_key", "SELECT tile_key, CASE WHEN instr(tile_key, '_') > 0 THEN split_part(tile_key, '_', 1) ELSE 'unknown' END AS utm FROM fx_tiles")
def p2(s, d):
    return X.tiles(s, d).select("tile_key", K.zone_of_key(F.col("tile_key")).alias("utm"))


@query("p3_zone_from_path", "SELECT path, nullif(regexp_extract(path, '(326[0-9]{2})', 1), '') AS utm FROM fx_paths")
def p3(s, d):
    return X.paths(s, d).select("path", K.zone_from_path(F.col("path")).alias("utm"))


@query("p4_run_token", "SELECT path, nullif(regexp_extract(path, '([0-9]{8}_[0-9]{6})', 1), '') AS token FROM fx_paths")
def p4(s, d):
    return X.paths(s, d).select("path", K.run_token(F.col("path")).alias("token"))


@query("p6_label_remap", "SELECT tile_key, r, c, raw_label, label FROM fx_labels")
def p6(s, d):
    return X.pixels(s, d).select("tile_key", "r", "c", "raw_label", L.remap(F.col("raw_label")).alias("label"))


@query("p7_inverse_remap", "SELECT b AS cls, max_by(a, o)::INT AS raw FROM (VALUES " + ", ".join(f"({a}, {b}, {i})" for i, (a, b) in enumerate(L.REMAP.items()))
       + ") v(a, b, o) WHERE b IN (SELECT cls FROM fx_hist) GROUP BY b")
def p7(s, d):
    """Raw code of each class that occurs; the last raw code of a class wins."""
    rows = [(a, b, i) for i, (a, b) in enumerate(L.REMAP.items())]
    inv = s.createDataFrame(rows, "raw int, cls int, ord int").groupBy("cls").agg(F.max_by("raw", "ord").alias("raw"))
    return inv.join(X.histograms(s, d).select("cls").distinct(), "cls", "left_semi")


@query("p8_nodata_to_ignore", "SELECT tile_key, r, c, (CASE WHEN raw_label = -32768 THEN 255 ELSE raw_label END)::INT AS v FROM fx_pixels")
def p8(s, d):
    return X.pixels(s, d).select("tile_key", "r", "c", L.nodata_to_ignore(F.col("raw_label")).alias("v"))


@query("p16_has_valid_class", "SELECT tile_key, bool_or(label < 13 AND label <> 255) AS valid FROM fx_labels GROUP BY tile_key")
def p16(s, d):
    return X.labels(s, d).groupBy("tile_key").agg(F.bool_or(F.expr("label < 13 and label <> 255")).alias("valid"))


@query("p17_tile_metrics", "SELECT tile_key, zone, total, round(bg_frac, 6) AS bg, round(water_frac, 6) AS water, round(wet_frac, 6) AS wet, round(entropy, 6) + 0.0 AS ent FROM fx_metrics")
def p17(s, d):
    return metrics(s, d).select("tile_key", "zone", "total", F.round("bg_frac", 6).alias("bg"), F.round("water_frac", 6).alias("water"), F.round("wet_frac", 6).alias("wet"), r6("entropy").alias("ent"))


@query("p18_reason_filtered", """SELECT tile_key, CASE WHEN water_frac > 0.5 THEN 'water_gt_threshold' WHEN bg_frac > 0.9 THEN 'background_gt_threshold'
 WHEN wet_frac < 0.2 THEN 'wetland_lt_min' WHEN wet_frac > 0.95 THEN 'wetland_gt_max' WHEN entropy < 0.5 THEN 'entropy_lt_min' END AS reason FROM fx_metrics""")
def p18(s, d):
    return metrics(s, d).select("tile_key", H.tile_reason("filtered", 0.9, 0.5, 0.2, 0.95, 0.5).alias("reason"))


@query("p18_reason_simple", """SELECT tile_key, CASE WHEN water_frac > 0.5 THEN 'water_gt_threshold'
 WHEN bg_frac >= 1 OR abs(bg_frac - 1) <= 1e-8 + 1e-5 THEN 'all_background' END AS reason FROM fx_metrics""")
def p18s(s, d):
    return metrics(s, d).select("tile_key", H.tile_reason("simple").alias("reason"))


@query("p19_legacy_keep", """, m AS (SELECT tile_key, sum(n) FILTER (cls = 0) AS n0, sum(n) FILTER (cls = 10) AS n10, sum(n) AS s FROM fx_hist GROUP BY 1),
 t AS (SELECT tile_key, count(*) AS total, count(*) FILTER (label = 255) AS ign FROM fx_labels GROUP BY 1)
 SELECT tile_key, coalesce(n0, 0) / total < 0.9 AND coalesce(n10, 0) / total <= 0.5 AS strict_full,
  CASE WHEN coalesce(s, 0) > 0 THEN coalesce(n0, 0) / s ELSE 1.0 END <= 0.95 AS incl_hist,
  NOT (coalesce(n0, 0) / (total - ign + 1e-6) > 0.7 OR coalesce(n10, 0) / (total - ign + 1e-6) > 0.9) AS valid_eps
 FROM t LEFT JOIN m USING (tile_key)""")
def p19(s, d):
    """Three older keep rules by name; the first counts against all pixels of the tile."""
    n = lambda c: F.coalesce(F.sum(F.when(F.col("label") == c, 1)), F.lit(0))
    t = X.labels(s, d).groupBy("tile_key").agg(n(0).alias("n0"), n(10).alias("n10"), F.count("*").alias("total"), n(255).alias("ign"))
    t = t.withColumn("s", F.expr("total - ign"))
    return t.selectExpr("tile_key", "n0 / total < 0.9D and n10 / total <= 0.5D as strict_full", "case when s > 0 then n0 / s else 1.0D end <= 0.95D as incl_hist",
                        "not (n0 / (s + 1e-6D) > 0.7D or n10 / (s + 1e-6D) > 0.9D) as valid_eps")


@query("p20_clean_histogram", "SELECT tile_key, cls, sum(n)::BIGINT AS n FROM fx_hist GROUP BY ALL")
def p20(s, d):
    """Histograms whose keys are text with padding and junk, cleaned again."""
    h = X.histograms(s, d)
    pair = F.map_from_entries(F.array(
        F.struct(F.concat(F.lit("0"), F.col("cls").cast("string")).alias("k"), F.col("n").cast("string").alias("v")),
        F.struct(F.lit("255").alias("k"), F.lit("7").alias("v")), F.struct(F.lit("total").alias("k"), F.lit("x").alias("v"))))
    return H.clean_histogram(h.select("tile_key", pair.alias("hist")))


@query("p21_key_of_record", KEY_SQL + r"""
SELECT path, CASE WHEN tile_id % 3 = 0 THEN 'id' || tile_id ELSE coalesce(nullif(regexp_extract(b, '(32[67][0-9]{2}_[0-9]+)', 1), ''),
  nullif(regexp_extract(b, '_(32[67][0-9]{2})_', 1), '') || '_' || nullif(regexp_extract(b, '(?i)([0-9]+)\.tif$', 1), '')) END AS tile_key FROM p""")
def p21(s, d):
    given = F.when(F.col("tile_id") % 3 == 0, F.concat(F.lit("id"), F.col("tile_id").cast("string")))
    return X.paths(s, d).select("path", K.key_of_record(given, F.lit(""), F.col("path")).alias("tile_key"))


@query("p22_one_zone", "SELECT tile_key, cls, n FROM fx_hist WHERE zone = '32632'")
def p22(s, d):
    return X.histograms(s, d).where("zone = '32632'").select("tile_key", "cls", "n")


@query("p28_class_names", "SELECT cls, coalesce(name, 'Class ' || cls) AS name FROM (SELECT DISTINCT raw_label AS cls FROM fx_pixels) LEFT JOIN (VALUES "
       + ", ".join(f"({i}, '{n}')" for i, n in enumerate(L.NAMES)) + ") v(i, name) ON i = cls")
def p28(s, d):
    return X.pixels(s, d).select(F.col("raw_label").alias("cls")).distinct().withColumn("name", L.class_name(F.col("cls")))


@query("a1_class_hist", "SELECT tile_key, cls, n FROM fx_hist")
def a1(s, d):
    return H.class_histogram(X.labels(s, d), ["tile_key"])


@query("a2_dense_hist", ", d AS (SELECT tile_key, i::INT AS cls, coalesce(n, 0)::BIGINT AS n FROM (SELECT DISTINCT tile_key FROM fx_hist) CROSS JOIN range(13) g(i) LEFT JOIN fx_hist h USING (tile_key) WHERE h.cls = i"
       " UNION ALL SELECT tile_key, i::INT, 0 FROM (SELECT DISTINCT tile_key FROM fx_hist) CROSS JOIN range(13) g(i) WHERE (tile_key, i) NOT IN (SELECT tile_key, cls FROM fx_hist))"
       " SELECT tile_key, cls, n FROM d")
def a2(s, d):
    v = H.dense_histogram(X.histograms(s, d), ["tile_key"])
    return v.select("tile_key", F.posexplode("vec").alias("cls", "n"))


@query("a3_entropy_nat_hist", "SELECT tile_key, round(entropy, 6) + 0.0 AS entropy FROM fx_metrics")
def a3(s, d):
    return H.entropy_nat(X.histograms(s, d), ["tile_key"]).select("tile_key", r6("entropy").alias("entropy"))


@query("a3_entropy_nat_hist_legacy", ", f AS (SELECT tile_key, label, count(*)::DOUBLE AS n FROM fx_labels GROUP BY ALL), t AS (SELECT *, n / sum(n) OVER (PARTITION BY tile_key) AS p FROM f)"
       " SELECT tile_key, round(-sum(p * ln(p)), 6) + 0.0 AS entropy FROM t GROUP BY 1")
def a3_legacy(s, d):
    """The ignore class counts like any other."""
    h = X.labels(s, d).groupBy("tile_key", "label").agg(F.count("*").alias("n"))
    return H.entropy_nat(h, ["tile_key"]).select("tile_key", r6("entropy").alias("entropy"))


@query("a3_entropy_bits_smooth", """, f AS (SELECT tile_key, label, count(*) AS n FROM fx_labels GROUP BY ALL),
 g AS (SELECT tile_key, sum(n) AS s, greatest(13, max(label) + 1) AS bins, count(*) AS k FROM f GROUP BY 1),
 e AS (SELECT tile_key, -sum((n + 1e-6) / (s + bins * 1e-6) * log2((n + 1e-6) / (s + bins * 1e-6))) AS a, any_value(s) AS s, any_value(bins) AS bins, any_value(k) AS k FROM f JOIN g USING (tile_key) GROUP BY 1)
 SELECT tile_key, round(a - (bins - k) * (1e-6 / (s + bins * 1e-6) * log2(1e-6 / (s + bins * 1e-6))), 6) + 0.0 AS entropy FROM e""")
def a3_smooth(s, d):
    return H.entropy_bits_smooth(X.labels(s, d), ["tile_key"]).select("tile_key", r6("entropy").alias("entropy"))


@query("a3_entropy_bits_eps", ", t AS (SELECT *, n / (sum(n) OVER (PARTITION BY tile_key) + 1e-8) AS p FROM fx_hist) SELECT tile_key, round(-sum(p * log2(p + 1e-8)), 6) + 0.0 AS entropy FROM t GROUP BY 1")
def a3_eps(s, d):
    return H.entropy_bits_eps(X.histograms(s, d), ["tile_key"]).select("tile_key", r6("entropy").alias("entropy"))


@query("a4_presence", "SELECT tile_key, i::INT AS cls, max((cls = i)::INT)::INT AS present FROM fx_hist CROSS JOIN range(13) g(i) GROUP BY ALL")
def a4(s, d):
    return H.presence(X.histograms(s, d), ["tile_key"]).select("tile_key", F.posexplode("present").alias("cls", "present"))


@query("a5_class_totals", "SELECT i::INT AS cls, coalesce(sum(n), 0)::BIGINT AS n FROM range(13) g(i) LEFT JOIN fx_hist ON cls = i GROUP BY ALL")
def a5(s, d):
    return H.class_totals(X.tiles(s, d), X.histograms(s, d))


@query("a15_zone_counts", "SELECT zone, count(*) AS n FROM fx_tiles GROUP BY ROLLUP (zone)")
def a15(s, d):
    """Tiles per zone, and their total in the row without a zone."""
    return X.tiles(s, d).rollup("zone").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "zone")


@query("a16_reason_counts", """SELECT CASE WHEN water_frac > 0.5 THEN 'water_gt_threshold' WHEN bg_frac > 0.9 THEN 'background_gt_threshold' ELSE 'ok' END AS reason, count(*) AS n
 FROM fx_metrics GROUP BY 1""")
def a16(s, d):
    r = metrics(s, d).select(F.coalesce(H.tile_reason(), F.lit("ok")).alias("reason"))
    return r.groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason")


RANKED = ", e AS (SELECT tile_key, zone, round(entropy, 9) + 0.0 AS entropy FROM fx_metrics)"


def entropies(s, d):
    return metrics(s, d).select("tile_key", "zone", (F.round("entropy", 9) + 0.0).alias("entropy"))


@query("w1_equal_share", RANKED + " SELECT tile_key, zone, rank FROM (SELECT *, row_number() OVER (PARTITION BY zone ORDER BY entropy DESC, tile_key)::INT AS rank FROM e) WHERE rank <= 40 // (SELECT count(DISTINCT zone) FROM e)")
def w1(s, d):
    return S.equal_share(entropies(s, d), 40).select("tile_key", "zone", "rank")


@query("w2_proportional_share", RANKED + " SELECT tile_key, zone, rank FROM (SELECT *, row_number() OVER (PARTITION BY zone ORDER BY entropy DESC, tile_key)::INT AS rank, count(*) OVER (PARTITION BY zone) AS nz, count(*) OVER () AS a FROM e) WHERE rank <= 40 * nz // a")
def w2(s, d):
    return S.proportional_share(entropies(s, d), 40).select("tile_key", "zone", "rank")


BINS2 = RANKED + """
, q AS (SELECT zone, quantile_cont(entropy, 0.0) AS e0, quantile_cont(entropy, 0.5) AS m, quantile_cont(entropy, 1.0) AS h FROM e GROUP BY zone),
ed AS (SELECT zone, e0, CASE WHEN m <= e0 THEN e0 + 1e-8 ELSE m END AS e1, h FROM q),
ee AS (SELECT zone, e0, e1, CASE WHEN h <= e1 THEN e1 + 1e-8 ELSE h END AS e2 FROM ed),
bn AS (SELECT tile_key, zone, entropy, least(1, (entropy >= e0)::INT + (entropy >= e1)::INT + (entropy >= e2)::INT - 1)::INT AS bin FROM e JOIN ee USING (zone)),
g AS (SELECT zone, b::INT AS bin, (SELECT count(*) FROM bn x WHERE x.zone = z.zone AND x.bin = b) AS size FROM (SELECT DISTINCT zone FROM bn) z CROSS JOIN (VALUES (0), (1)) v(b)),
gq AS (SELECT *, least(10, sum(size) OVER (PARTITION BY zone))::BIGINT AS q FROM g),
tg AS (SELECT *, (CASE WHEN bin = 0 THEN round_even(q * 0.3::DOUBLE, 0) ELSE q - round_even(q * 0.3::DOUBLE, 0) END)::BIGINT AS target FROM gq),
tk AS (SELECT *, least(target, size) AS take FROM tg)"""


def binned(s, d):
    e = entropies(s, d)
    return S.assign_bins(e, S.entropy_edges(e, 2), 2)


@query("w3_entropy_edges", BINS2 + " SELECT zone, 0 AS i, round(e0, 7) AS edge FROM ee UNION ALL SELECT zone, 1, round(e1, 7) FROM ee UNION ALL SELECT zone, 2, round(e2, 7) FROM ee")
def w3(s, d):
    return S.entropy_edges(entropies(s, d), 2).select("zone", F.posexplode("edges").alias("i", "edge")).withColumn("edge", F.round("edge", 7))


@query("w4_bin_assignment", BINS2 + " SELECT tile_key, bin FROM bn")
def w4(s, d):
    return binned(s, d).select("tile_key", "bin")


@query("w5_bin_targets", BINS2 + " SELECT zone, bin, size, q, target, take FROM tk")
def w5(s, d):
    return S.bin_targets(binned(s, d), 10, 2)


FILL = BINS2 + """
, f1 AS (SELECT *, q - sum(take) OVER (PARTITION BY zone) AS lft, size - take AS room FROM tk),
f2 AS (SELECT *, sum(room::DOUBLE) OVER (PARTITION BY zone) AS ws FROM f1),
f3 AS (SELECT *, CASE WHEN ws > 0 THEN room::DOUBLE / ws * lft ELSE 0 END AS share FROM f2),
f4 AS (SELECT *, row_number() OVER (PARTITION BY zone ORDER BY share - floor(share) DESC, bin) AS rk, CASE WHEN ws > 0 THEN lft - sum(floor(share)) OVER (PARTITION BY zone) ELSE 0 END AS rem FROM f3),
fl AS (SELECT zone, bin, size, q, target, (take + least(floor(share) + (rk <= rem)::INT, room))::BIGINT AS take FROM f4)"""


@query("w6_backfill", FILL + " SELECT * FROM fl")
def w6(s, d):
    return S.backfill(S.bin_targets(binned(s, d), 10, 2)).withColumn("take", F.col("take").cast("long"))


LIMIT = FILL + """
, l0 AS (SELECT zone, max(q) AS q, max(take) FILTER (bin = 0) AS t0, max(take) FILTER (bin = 1) AS t1, max(size) FILTER (bin = 1) AS s1 FROM fl GROUP BY zone),
l1 AS (SELECT *, CASE WHEN t0 / q < 0.35 THEN greatest(0, least(ceil(q * 0.35::DOUBLE) - t0, greatest(0, s1 - t1))) ELSE 0 END AS up FROM l0),
l2 AS (SELECT zone, q, t0 + up AS t0, t1 - up AS t1 FROM l1),
l3 AS (SELECT *, CASE WHEN t0 / q > 0.4 THEN greatest(0, least(floor(q * (t0 / q - 0.4::DOUBLE)), t0)) ELSE 0 END AS dn FROM l2)"""


@query("w7_low_share_limits", LIMIT + " SELECT zone, (t0 - dn)::BIGINT AS take0, (t1 + dn)::BIGINT AS take1 FROM l3")
def w7(s, d):
    return S.low_share_limits(S.backfill(S.bin_targets(binned(s, d), 10, 2)), 0.35, 0.4)


@query("w8_take_from_bins", FILL + " SELECT tile_key, zone, bin, rank FROM (SELECT *, row_number() OVER (PARTITION BY zone, bin ORDER BY entropy DESC, tile_key)::INT AS rank FROM bn) JOIN (SELECT zone, bin, take FROM fl) USING (zone, bin) WHERE rank <= take")
def w8(s, d):
    b = binned(s, d)
    return S.take_from_bins(b, S.backfill(S.bin_targets(b, 10, 2))).select("tile_key", "zone", "bin", "rank")


@query("a19_zone_statistics", FILL + " SELECT zone, sum(size)::BIGINT AS available, sum(take)::BIGINT AS selected, max(size) FILTER (bin = 0)::BIGINT AS low, max(size) FILTER (bin = 1)::BIGINT AS high FROM fl GROUP BY zone")
def a19(s, d):
    f = S.backfill(S.bin_targets(binned(s, d), 10, 2))
    pick = lambda b: F.max(F.when(F.col("bin") == b, F.col("size")))
    return f.groupBy("zone").agg(F.sum("size").alias("available"), F.sum("take").cast("long").alias("selected"), pick(0).alias("low"), pick(1).alias("high"))


@query("t1_top_percent", RANKED + " SELECT tile_key FROM (SELECT *, row_number() OVER (ORDER BY entropy DESC, tile_key) AS k, count(*) OVER () AS a FROM e) WHERE k <= least(a * 30 // 100, 200)")
def t1(s, d):
    return S.top_percent(entropies(s, d), 30, 200).select("tile_key")


@query("t2_first_accepted", ", m AS (SELECT tile_key FROM fx_metrics WHERE NOT (water_frac > 0.5) AND NOT (bg_frac > 0.9) ORDER BY tile_key LIMIT 20) SELECT tile_key FROM m")
def t2(s, d):
    return metrics(s, d).where(H.tile_reason().isNull()).select("tile_key").orderBy("tile_key").limit(20)


@query("t3_global_cap", RANKED + " SELECT tile_key FROM e ORDER BY entropy DESC, tile_key LIMIT 25")
def t3(s, d):
    return S.global_cap(entropies(s, d), 25).select("tile_key")


@query("t4_first_missing", "SELECT tile_key FROM fx_tiles WHERE tile_key NOT IN (SELECT tile_key FROM fx_paths WHERE role = 'label') ORDER BY tile_key LIMIT 10")
def t4(s, d):
    have = X.paths(s, d).where("role = 'label'").select("tile_key")
    return X.tiles(s, d).join(have, "tile_key", "left_anti").select("tile_key").orderBy("tile_key").limit(10)


@query("t5_seeded_sample", "SELECT tile_key FROM fx_tiles ORDER BY md5('42:' || tile_key) LIMIT 12")
def t5(s, d):
    return X.tiles(s, d).select("tile_key").orderBy(F.md5(F.concat(F.lit("42:"), "tile_key"))).limit(12)


@query("t6_first_files", "SELECT path FROM fx_paths ORDER BY path LIMIT 15")
def t6(s, d):
    return X.paths(s, d).select("path").orderBy("path").limit(15)
