"""DuckDB definitions of the fixture views, the prefix of every oracle query."""

from ..functions.labels import NAMES, REMAP

_REMAP = "CASE raw_label " + " ".join(f"WHEN {a} THEN {b}" for a, b in REMAP.items()) + " ELSE 255 END"
_PATHS = {
    "image": "'/in/img/google_embed_Europe_2018_10m_' || zone || '_bands_00_63_' || tile_id || '.tif'",
    "label": "'/in/lbl/ext_wetland_2018_Europe_2018_10m_' || zone || '_' || tile_id || '.tif'",
    "group": "'/in/raw/google_embed_Europe_2018_10m_' || zone || '_bands_01_22_' || tile_id || '.tif'",
    "json": "'/out/20250717_132657/hist/' || zone || '_' || tile_id || '.json'",
    "pred": "'/out/pred/' || zone || '_' || tile_id || '_pred.tif'",
    "array": "'/out/npy/tile_' || zone || '_' || tile_id || '_img.npy'",
    "array_label": "'/out/npy/tile_' || zone || '_' || tile_id || '_lbl.npy'",
}
NAME_ROWS = ", ".join(f"({i}, '{n}')" for i, n in enumerate(NAMES))

VIEWS = f"""
fx_o AS (
 SELECT l.*, s.s_nationkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey,
    l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate) - 1 AS px
 FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey),
fx_pixels AS (
 SELECT concat(32630 + s_nationkey % 6, '_', l_suppkey) AS tile_key, (32630 + s_nationkey % 6)::VARCHAR AS zone,
  (px // 32)::INT AS r, (px % 32)::INT AS c,
  (CASE WHEN l_orderkey % 50 = 0 THEN -32768 WHEN l_partkey % 20 < l_suppkey % 20 THEN 0
    WHEN l_suppkey % 7 = 0 AND l_linenumber <= 5 THEN 16 ELSE (l_orderkey + l_linenumber) % 23 END)::INT AS raw_label,
  (CASE WHEN l_orderkey % 97 = 0 THEN -32768 ELSE l_quantity END)::DOUBLE AS b0,
  (CASE WHEN l_orderkey % 97 = 0 OR l_linenumber = 7 THEN -32768 ELSE l_extendedprice END)::DOUBLE AS b1,
  (CASE WHEN l_orderkey % 97 = 0 THEN -32768 ELSE l_discount END)::DOUBLE AS b2,
  (CASE WHEN l_orderkey % 97 = 0 THEN -32768 ELSE l_tax END)::DOUBLE AS b3
 FROM fx_o),
fx_labels AS (SELECT *, ({_REMAP})::INT AS label, [b0, b1, b2, b3] AS bands FROM fx_pixels),
fx_pred AS (
 SELECT *, (CASE WHEN label = 255 THEN (r + c) % 13 WHEN (r * 7 + c) % 5 < 4 THEN label ELSE (label + r + 1) % 13 END)::INT AS pred FROM fx_labels),
fx_hist AS (SELECT tile_key, zone, label AS cls, count(*) AS n FROM fx_labels WHERE label <> 255 GROUP BY ALL),
fx_tiles AS (
 SELECT concat(32630 + s_nationkey % 6, '_', s_suppkey) AS tile_key, (32630 + s_nationkey % 6)::VARCHAR AS zone, s_suppkey AS tile_id FROM supplier),
fx_embed AS (
 SELECT concat(32630 + (vec_id // 25) % 6, '_', vec_id // 25) AS tile_key, (32630 + (vec_id // 25) % 6)::VARCHAR AS zone,
  (vec_id % 25 // 5)::INT AS r, (vec_id % 5)::INT AS c, label, embedding::DOUBLE[] AS bands, vec_id FROM embeddings),
fx_logits AS (SELECT * EXCLUDE (bands), bands[1:13] AS logits FROM fx_embed),
fx_epochs AS (
 SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INT AS epoch, value AS loss, 1 / (1 + abs(value)) AS f1 FROM events),
fx_segments AS (
 SELECT *, (r // 4 * 8 + c // 4)::INT AS segment_id, ((r // 4 * 8 + c // 4) * 5 % 7)::INT AS ord FROM fx_labels),
fx_paths AS (
 SELECT * FROM ({" UNION ALL ".join(f"SELECT tile_key, zone, tile_id, '{k}' AS role, {v} AS path, tile_id * 37 % 101 AS mtime FROM fx_tiles" for k, v in _PATHS.items())})
 WHERE NOT (role = 'label' AND tile_id % 9 = 0) AND NOT (role = 'array_label' AND tile_id % 8 = 0)),
fx_metrics AS (
 SELECT tile_key, zone, sum(n)::BIGINT AS total, coalesce(sum(n) FILTER (cls = 0), 0) / sum(n) AS bg_frac,
  coalesce(sum(n) FILTER (cls = 10), 0) / sum(n) AS water_frac, coalesce(sum(n) FILTER (cls BETWEEN 1 AND 12), 0) / sum(n) AS wet_frac,
  -sum(n / t * ln(n / t)) + 0.0 AS entropy
 FROM (SELECT *, (sum(n) OVER (PARTITION BY tile_key))::DOUBLE AS t FROM fx_hist) GROUP BY tile_key, zone)
"""
