"""Golden literals, properties and plans of the tile operators."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from rasterloom.functions import keys as K
from rasterloom.operators import bands as B
from rasterloom.operators import blocks as L
from rasterloom.operators import cluster as KM
from rasterloom.operators import density as N
from rasterloom.operators import grid as G
from rasterloom.operators import hist as H
from rasterloom.operators import metrics as M
from rasterloom.operators import neighbours as NB
from rasterloom.operators import projection as J
from rasterloom.operators import runs as R
from rasterloom.operators import score as C
from rasterloom.operators import select as S
from rasterloom.operators import split as P
from rasterloom.operators import weights as W
from rasterloom.plans import QUERIES
from rasterloom.plans.evaluation import long_probs
from rasterloom.sources import files, sinks
from rasterloom.sources import fixtures as X
from rasterloom.streaming import jobs


def one(spark, path, f):
    return spark.createDataFrame([(path,)], "p string").select(f(F.col("p"))).first()[0]


def test_key_literals(spark):
    image = "google_embed_Europe_2018_10m_32638_bands_00_63_99996.tif"
    assert one(spark, image, K.key_last_zone) == "32638_99996"
    assert one(spark, "ext_wetland_2018_Europe_2018_10m_32638_99996.tif", K.key_last_zone) == "32638_99996"
    assert one(spark, "32634_184075.json", K.key_generic) == "32634_184075"
    assert one(spark, "tile_32701_5.tif", K.key_north_only) is None
    assert one(spark, "data/processed/20250717_132657/google_embed_Denmark_2018_10m_32633_115", K.zone_from_path) == "32657"


def test_entropy_literal(spark):
    h = spark.createDataFrame([("t", "z", 0, 257584), ("t", "z", 3, 2947), ("t", "z", 10, 2398)], "tile_key string, zone string, cls int, n long")
    m = H.tile_metrics(h).first()
    assert m["total"] == 262929 and abs(m["bg_frac"] - 0.9796713) < 1e-6 and abs(m["entropy"] - 0.1132989) < 1e-6


def test_allocation_table(spark):
    want = {1: (1, 0, 0), 2: (2, 0, 0), 3: (2, 1, 0), 4: (3, 1, 0), 5: (4, 1, 0), 6: (5, 1, 0), 7: (5, 1, 1), 11: (9, 1, 1), 12: (10, 1, 1), 24: (20, 2, 2), 100: (84, 8, 8)}
    z = spark.createDataFrame([(str(n), n) for n in want], "zone string, items int")
    got = {}
    for r in P.allocate(z).collect():
        got.setdefault(int(r["zone"]), {})[r["split"]] = r["n"]
    assert {n: (g["train"], g["val"], g["test"]) for n, g in got.items()} == want


def test_splits_are_disjoint_and_whole(spark, sf001):
    t = X.tiles(spark, sf001)
    s = P.stratified(t)
    assert s.count() == t.count() == s.select("tile_key").distinct().count()


def test_flips_are_involutions(spark, sf001):
    p = X.labels(spark, sf001).where("r < 18").select("tile_key", "r", "c", "label")
    for how in ("h", "v", "180"):
        assert G.flip(G.flip(p, how), how).exceptAll(p).isEmpty()
    assert G.flip(G.flip(p, "90"), "270").exceptAll(p).isEmpty()


def test_averaging_a_constant(spark, sf001):
    p = G.patches(X.logits(spark, sf001).withColumn("logits", F.array_repeat(F.lit(2.5), 13)), 3, 2, "pad_edge")
    assert C.average_logits(p, 13, ["tile_key", "r", "c"]).where(F.exists("logits", lambda x: x != 2.5)).isEmpty()


def test_softmax_sums_to_one(spark, sf001):
    p = X.logits(spark, sf001).select(F.aggregate(C.softmax(), F.lit(0.0), lambda a, x: a + x).alias("s"))
    assert p.where("abs(s - 1) > 1e-9").isEmpty()


def test_signed_distance_signs(spark, sf001):
    p = X.labels(spark, sf001).where("r < 6 and c < 6")
    d = L.signed_distances(p, [0]).withColumn("sd", F.get("sd", F.lit(0))).join(p.select("tile_key", "r", "c", "label"), ["tile_key", "r", "c"])
    assert d.where("(label = 0 and sd > 0) or (label <> 0 and sd < 0)").isEmpty()


def nearest(cells, want):
    """Signed distances by brute force: ``(r, c) -> label``."""
    far = float(max(max(r, c) for r, c in cells) + 2)
    on = [k for k, v in cells.items() if v == want]
    off = [k for k, v in cells.items() if v != want]
    far_or = lambda r, c, to: min((math.dist((r, c), k) for k in to), default=far)
    return {(r, c): 0.0 if not on else -far_or(r, c, off) if v == want else far_or(r, c, on) for (r, c), v in cells.items()}


@pytest.mark.parametrize("core", [256, 7, 3])
def test_signed_distances_equal_brute_force(spark, core):
    # 5 rows of 12, the last one ragged: its nearest cells lie in columns that it has not.
    tiles = {"a": {(r, c): 1 if (r, c) in ((3, 11), (0, 0)) else 0 for r in range(5) for c in range(12) if r < 4 or c < 9},
             "b": {(r, c): 1 for r in range(3) for c in range(10)}, "c": {(r, c): (r * 5 + c * 3) % 7 for r in range(11) for c in range(4)}}
    df = spark.createDataFrame([(t, r, c, v) for t, p in tiles.items() for (r, c), v in p.items()], "tile_key string, r int, c int, label int")
    got = {(x["tile_key"], k, x["r"], x["c"]): x["sd"][k] for x in L.signed_distances(df, [0, 1, 2], core).collect() for k in range(3)}
    want = {(t, k, *at): d for t, p in tiles.items() for k in (0, 1, 2) for at, d in nearest(p, k).items()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_signed_distance_query_covers_all_pixels(spark, sf001):
    assert QUERIES["g7_signed_distance"](spark, sf001).count() == X.labels(spark, sf001).count()


def test_boundary_dice_query_averages_all_classes(spark, sf001):
    """Per tile and class 2 * sum(p * d) / (sum(p * p) + sum(d * d)), tiles averaged, then classes."""
    tiles, cells = {}, long_probs(spark, sf001).collect()
    for x in cells:
        tiles.setdefault(x["tile_key"], {})[x["r"], x["c"]] = x["label"]
    sd = {(t, k): nearest(p, k) for t, p in tiles.items() for k in range(13)}
    sums = {k: [0.0, 0.0, 0.0] for k in sd}
    for x in cells:
        of = sd[x["tile_key"], x["cls"]]
        lo, hi = min(of.values()), max(of.values())
        d, p = (of[x["r"], x["c"]] - lo) / (hi - lo + 1e-8), x["p"]
        sums[x["tile_key"], x["cls"]] = [a + b for a, b in zip(sums[x["tile_key"], x["cls"]], (p * d, p * p, d * d))]
    want = sum(1 - 2 * a / (b + c + 1e-6) for a, b, c in sums.values()) / len(sums)
    assert abs(QUERIES["a39_boundary_dice"](spark, sf001).first()["loss"] - want) < 1e-6


def test_boundary_dice_by_hand(spark):
    # d is 0 and 1 in tile a (p 0.5, 1), 0 and 0 in tile b (p 1, 0): dice 2 / (1.25 + 1) and 0.
    rows = [("a", 0, 0.5, -2.0), ("a", 0, 1.0, 3.0), ("b", 0, 1.0, 4.0), ("b", 0, 0.0, 4.0)]
    got = M.boundary_dice(spark.createDataFrame(rows, "tile_key string, cls int, p double, sd double")).first()[0]
    assert abs(got - (1 - 2 / 2.25 + 1) / 2) < 1e-6


def test_combined_loss(spark):
    one = lambda v: spark.createDataFrame([(v,)], "loss double")
    assert abs(M.combined_loss(one(2.0), one(1.0), one(0.5)).first()[0] - 1.7) < 1e-12 and M.combined_loss(one(2.0), one(1.0)).first()[0] == 1.5


def cells(spark, grid, columns="bands array<double>"):
    return spark.createDataFrame([("t", r, c, v) for r, row in enumerate(grid) for c, v in enumerate(row)], f"tile_key string, r int, c int, {columns}")


def test_stretch_of_a_band_without_spread_and_of_no_numbers(spark):
    nan, inf, no = float("nan"), float("inf"), B.NODATA
    got = {x["c"]: x["bands"] for x in B.robust_stretch(cells(spark, [[[3.0, 0.0], [3.0, 10.0], [no, 5.0], [nan, nan], [3.0, inf], [3.0, no]]]), 2, low=0.0, high=1.0).collect()}
    assert [got[c][0] for c in range(6)] == [1.0, 1.0, 0.0, 0.0, 1.0, 1.0]
    assert [got[c][1] for c in range(6)] == [0.0, 1.0, 0.5, 0.0, 0.0, 0.0]


@pytest.mark.parametrize("most", [10, 100, 10_000])
def test_stretch_sees_pixels_once_and_narrows_large_tiles_only(spark, most):
    import numpy as np

    rng = np.random.default_rng(5)
    data = {t: rng.normal(size=(n, 2)) for t, n in (("a", 60), ("b", 300), ("c", 7))}
    df = spark.createDataFrame([(t, i, 0, v.tolist()) for t, x in data.items() for i, v in enumerate(x)], "tile_key string, r int, c int, bands array<double>")
    out = B.robust_stretch(df, 2, most=most)
    assert most < 300 or "Join" not in plan(out)
    got = {(x["tile_key"], x["r"]): x["bands"] for x in out.collect()}
    assert len(got) == 367
    for t, x in data.items():
        lo, hi = np.quantile(x, [0.02, 0.98], axis=0)
        assert np.allclose([got[t, i] for i in range(len(x))], np.clip((x - lo) / (hi - lo), 0, 1), rtol=0, atol=1e-12), t


@pytest.mark.parametrize("most", [10, 300, 10_000])
def test_percentiles_by_narrowing_equal_sorting(spark, most, monkeypatch):
    import numpy as np

    monkeypatch.setattr(B, "STEPS", 8)
    rng = np.random.default_rng(3)
    data = {"a": rng.normal(size=(600, 2)) ** 5, "b": np.repeat([[1.0, 5.0], [2.0, 5.0]], [5, 400], axis=0), "c": rng.integers(0, 4, (7, 2)).astype(float)}
    df = spark.createDataFrame([(t, i, 0, v.tolist()) for t, x in data.items() for i, v in enumerate(x)], "tile_key string, r int, c int, bands array<double>")
    got = {(x["tile_key"], x["band"]): x["q"] for x in B.exact_percentiles(df, 2, [0.0, 0.02, 0.5, 0.98], lambda x: x.isNotNull(), most).collect()}
    assert len(got) == 6
    for (t, b), q in got.items():
        assert np.allclose(q, np.quantile(data[t][:, b], [0.0, 0.02, 0.5, 0.98]), rtol=1e-12, atol=1e-12), (t, b)


@pytest.mark.parametrize("core", [256, 5])
def test_blocks_equal_plain_neighbourhoods(spark, core):
    """Blur and edges of a ragged tile of 13 x 11 cells, in one block and in many."""
    import random

    r = random.Random(4)
    cells_ = {(i, j): (r.uniform(0, 9), r.choice([0, 0, 1, 255])) for i in range(13) for j in range(11) if (i, j) not in ((12, 3), (4, 4), (5, 4))}
    df = spark.createDataFrame([("t", i, j, v, k) for (i, j), (v, k) in cells_.items()], "tile_key string, r int, c int, v double, label int")
    mirror = lambda i, n: -i if i < 0 else 2 * (n - 1) - i if i >= n else i
    blurred = {(x["r"], x["c"]): x["v"] for x in L.blur3(df, "v", 0.8, core).collect()}
    edges = {(x["r"], x["c"]): x["edge"] for x in L.edge_mask(df, core=core).collect()}
    assert blurred.keys() == edges.keys() == cells_.keys()
    on = {k for k, (_, label) in cells_.items() if label not in (0, 255)}
    for (i, j), v in blurred.items():
        near = [(math.exp(-(a * a + b * b) / (2 * 0.64)), (mirror(i + a, 13), mirror(j + b, 11))) for a in (-1, 0, 1) for b in (-1, 0, 1)]
        near = [(k, cells_[at][0]) for k, at in near if at in cells_]
        assert abs(v - sum(k * x for k, x in near) / sum(k for k, _ in near)) < 1e-12
        assert edges[i, j] == int((i, j) not in on and any(at in on for at in ((i - 1, j), (i + 1, j), (i, j - 1), (i, j + 1))))


def test_envelope_of_wide_rows():
    import time

    import numpy as np

    rng = np.random.default_rng(1)
    f = np.where(rng.random((40, 60)) < 0.3, rng.integers(0, 900, (40, 60)).astype(float), np.inf)
    p = np.arange(60)
    assert np.array_equal(L.envelope(f), (f[:, None, :] + (p[:, None] - p) ** 2).min(2))
    start = time.time()
    wide = L.envelope(np.where(rng.random((100, 10_000)) < 0.01, 0.0, np.inf))
    assert np.isfinite(wide).all() and time.time() - start < 20


@pytest.mark.parametrize("core", [256, 6])
def test_model_of_windows_equals_numpy(spark, core):
    """A 3 x 3 convolution in windows of 5 at every third cell, as one loop over the whole tile."""
    import numpy as np

    rng = np.random.default_rng(6)
    x, kernel, bias = rng.normal(size=(2, 14, 11)), rng.normal(size=(4, 2, 3, 3)), [0.1, 0.0, -0.2, 0.3]

    def model(w):
        p = np.pad(w, ((0, 0), (0, 0), (1, 1), (1, 1)))
        return sum(np.einsum("kc,nchw->nkhw", kernel[:, :, i, j], p[:, :, i:i + 5, j:j + 5]) for i in range(3) for j in range(3))

    total, n = np.zeros((4, 14, 11)), np.zeros((14, 11))
    for i in range(0, 14, 3):
        for j in range(0, 11, 3):
            w = x[:, i:i + 5, j:j + 5]
            w = np.pad(w, ((0, 0), (0, 5 - w.shape[1]), (0, 5 - w.shape[2])), mode="edge")
            h, v = min(5, 14 - i), min(5, 11 - j)
            total[:, i:i + h, j:j + v] += (model(w[None])[0, :, :h, :v] - np.array(bias)[:, None, None]) / 2.0
            n[i:i + h, j:j + v] += 1
    e = np.exp(total / n - (total / n).max(0))
    want = e / e.sum(0)
    df = spark.createDataFrame([("t", i, j, x[:, i, j].tolist()) for i in range(14) for j in range(11)], "tile_key string, r int, c int, bands array<double>")
    got = L.predict_windows(df, model, 4, 5, 3, 2.0, bias, core=core).collect()
    assert len(got) == 14 * 11
    for g in got:
        assert np.allclose(g["probs"], want[:, g["r"], g["c"]], atol=1e-12) and g["pred"] == want[:, g["r"], g["c"]].argmax()


def test_a_kernel_sees_few_cells_whatever_a_batch_holds(spark):
    """40 tiles of 128 x 128 in one batch; each cell tells how many its kernel got."""
    import numpy as np

    px = spark.range(40 * 128 * 128).selectExpr("cast(id div 16384 as string) as tile_key", "cast(id % 16384 div 128 as int) as r", "cast(id % 128 as int) as c", "1 as v")

    def kernel(blocks):
        n = sum(len(b.r) for b in blocks)
        return [{"n": np.full(int(b.own.sum()), n)} for b in blocks]

    got = L.run(px.coalesce(1), ["v"], kernel, "n long").groupBy("tile_key").agg(F.count("*").alias("c"), F.count_distinct("r", "c").alias("d"), F.max("n").alias("n")).collect()
    assert len(got) == 40 and all(x["c"] == x["d"] == 16384 and x["n"] <= L.TOGETHER for x in got)


def test_pixels_are_jittered_without_a_join_by_cell(spark, sf001):
    """Two readings of the pixels, for the means and for the values, each joined to its tiles once, and one join by tile."""
    p = QUERIES["g5_brightness_contrast"](spark, sf001)._jdf.queryExecution().optimizedPlan().toString()
    assert p.count("Join Inner") == 3 and p.count("Window [") <= 1


def test_noise_of_known_bands_is_compiled(spark, sf001):
    p = QUERIES["g4_gaussian_noise"](spark, sf001)._jdf.queryExecution().optimizedPlan().toString()
    assert "md5(" in p and "transform(" not in p and "lambda" not in p


def test_newest_delivery_of_a_tile_counts(spark, tmp_path):
    """Three deliveries over three calls, a snapshot between, and a batch that is lost and comes again."""
    import shutil

    schema = spark.createDataFrame([], "tile_key string, label int").schema
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run = lambda every: {(x["tile_key"], x["cls"]): x["n"] for x in jobs.stream_tiles(spark, f"{tmp_path}/in", schema, f"{tmp_path}/out", f"{tmp_path}/ckpt", every).collect()}
    put([("a", 1), ("a", 1), ("a", 255), ("b", 2)])
    assert run(1) == {("a", 1): 2, ("b", 2): 1}
    put([("a", 3)])
    assert run(5) == {("a", 3): 1, ("b", 2): 1}
    put([("b", 255), ("c", 0)])
    assert run(5) == {("a", 3): 1, ("c", 0): 1}
    shutil.rmtree(f"{tmp_path}/out/batches/batch=0")  # held by the snapshot
    jobs.compact(spark, f"{tmp_path}/out")
    assert run(5) == {("a", 3): 1, ("c", 0): 1} and jobs.tile_state(spark, f"{tmp_path}/none").isEmpty()


def test_outlines_by_hand(spark):
    """A square with a hole: cells on its edge, inside, in the hole and outside; a sliver within one cell."""
    ring = lambda g, pts: [(g, *pts[i], *pts[(i + 1) % len(pts)]) for i in range(len(pts))]
    e = ring(1, [(0.5, 0.5), (6.5, 0.5), (6.5, 6.5), (0.5, 6.5)]) + ring(1, [(1.5, 1.5), (5.5, 1.5), (5.5, 5.5), (1.5, 5.5)]) + ring(2, [(7.1, 7.1), (7.2, 7.1), (7.15, 7.2)])
    grid = spark.createDataFrame([(i * 8 + j, float(j), float(i), j + 1.0, i + 1.0) for i in range(8) for j in range(8)], "cell_id int, xmin double, ymin double, xmax double, ymax double")
    got = {(x["cell_id"], x["geom_id"]) for x in KM.outlines_touching(grid, spark.createDataFrame(e, "geom_id int, x1 double, y1 double, x2 double, y2 double"), 3.0).collect()}
    hole = {(i, j) for i in range(2, 5) for j in range(2, 5)}
    assert got == {(i * 8 + j, 1) for i in range(7) for j in range(7) if (i, j) not in hole} | {(63, 2)}


def test_workers_get_the_package(spark, monkeypatch, tmp_path):
    from rasterloom.sources import shared

    sent = []
    context = type("C", (), {"addPyFile": lambda self, name: sent.append(name)})()
    monkeypatch.chdir(tmp_path)
    monkeypatch.delenv("PYTHONPATH", raising=False)
    session = type("S", (), {"sparkContext": context})()
    shared.ship(session)
    shared.ship(session)
    import zipfile

    assert len(sent) == 1 and {"rasterloom/operators/blocks.py", "bench.py"} <= set(zipfile.ZipFile(sent[0]).namelist())


def test_blur_reflects_at_the_edges(spark):
    got = {(x["r"], x["c"]): x["v"] for x in L.blur3(cells(spark, [[0.0, 6.0, 3.0], [9.0, 0.0, 12.0]], "v double"), "v", sigma=1.0).collect()}
    e = math.exp(-0.5)
    k = [e / (1 + 2 * e), 1 / (1 + 2 * e), e / (1 + 2 * e)]
    grid = [[0.0, 6.0, 3.0], [9.0, 0.0, 12.0]]
    mirror = lambda i, n: -i if i < 0 else 2 * (n - 1) - i if i >= n else i
    for (r, c), v in got.items():
        assert abs(v - sum(k[a + 1] * k[b + 1] * grid[mirror(r + a, 2)][mirror(c + b, 3)] for a in (-1, 0, 1) for b in (-1, 0, 1))) < 1e-12


def test_fewer_places_than_zones(spark):
    rows = [("z9_a", "z9", 1), ("z1_a", "z1", 2), ("z5_a", "z5", 3), ("z9_b", "z9", 4)]
    t = spark.createDataFrame(rows, "tile_key string, zone string, tile_id long")
    assert [x["zone"] for x in P.round_robin(t, 2).orderBy("zone").collect()] == ["z1", "z9"]  # in the order of first appearance
    assert [x["zone"] for x in P.round_robin(t, 2, by_name=True).orderBy("zone").collect()] == ["z1", "z5"]
    assert P.round_robin(t, 4).count() == 4


def test_early_stop_only_at_epochs_that_are_not_saved(spark):
    loss = [5.0, 4.0, 4.0, 4.0, 4.0, 4.0, 4.0, 3.9, 4.0, 4.0, 4.0, 4.0]
    log = spark.createDataFrame([(run, i + 1, v, -v) for run in (1, 2) for i, v in enumerate(loss[:9 if run == 2 else 12])], "run int, epoch int, loss double, f1 double")
    stops = lambda **k: {x["run"]: x["stop"] for x in R.early_stop(log, **k).collect()}
    assert stops(patience=3, save_every=5) == {1: 6, 2: 6}  # at 5 a checkpoint is saved
    assert stops(patience=4, save_every=6) == {1: 7, 2: 7} and stops(patience=6, save_every=5) == {1: None, 2: None}


def test_best_artifact(spark):
    files = {"a": ["d/model_ep003.pt", "d/best_f1=0.5.pt", "d/x_F1-0.7.pt", "d/y_miou=0.9_f1=0.6.pt"], "b": ["d/m_1_0.3.pt", "d/m_2_0.4.pt", "d/mIoU0.2.pt"],
             "c": ["d/only.pt"], "e": ["d/none.pt", "d/neither.pt"], "f": ["d/epoch=12_f1=0.1.pt", "d/epoch=1_f1=0.2.pt", "d/epoch=3.pt"], "g": ["d/007_0.9.pt", "d/model_ep003.pt"]}
    df = spark.createDataFrame([(k, p) for k, v in files.items() for p in v], "run string, path string")
    got = {x["run"]: x["path"] for x in R.best_artifact(df).collect()}
    assert got == {"a": "d/x_F1-0.7.pt", "b": "d/m_2_0.4.pt", "c": "d/only.pt", "f": "d/epoch=1_f1=0.2.pt", "g": "d/007_0.9.pt"}
    best = spark.createDataFrame([("f", 12), ("g", 3), ("a", 99)], "run string, epoch int")
    got = {x["run"]: x["path"] for x in R.best_artifact(df, best).collect()}
    assert got["f"] == "d/epoch=12_f1=0.1.pt" and got["g"] == "d/model_ep003.pt" and got["a"] == "d/x_F1-0.7.pt"


def test_ranks_do_not_depend_on_the_buckets(spark):
    rows = spark.range(500).select(F.concat(F.lit("32633_"), F.col("id").cast("string")).alias("tile_key"), (F.col("id") % 3).cast("string").alias("zone"))
    for n in (7, 100_000):
        got = {x["tile_key"]: x["rank"] for x in P.global_rank(rows, P.seeded(), "rank", per_bucket=n).collect()}
        assert sorted(got.values()) == list(range(1, 501))
        assert [k for k, _ in sorted(got.items(), key=lambda kv: kv[1])] == [x[0] for x in rows.orderBy(P.seeded()).select("tile_key").collect()]
        keys = sorted(f"32633_{i}" for i in range(500))
        assert sorted((x["ordinal"], x["tile_key"]) for x in P.evenly_spaced(rows, "tile_key", 7, per_bucket=n).collect()) == [(i * 499 // 6, keys[i * 499 // 6]) for i in range(7)]
    assert P.evenly_spaced(rows, "tile_key", 1).collect()[0]["ordinal"] == 0 and P.evenly_spaced(rows.limit(0), "tile_key", 3).collect() == []


def test_noise_is_normal_and_repeats(spark, sf001):
    p = X.banded(spark, sf001).select("tile_key", "r", "c", F.array_repeat(F.lit(0.0), 4).alias("bands"))
    n = G.gaussian_noise(p, std=2.0)
    s = n.select(F.explode("bands").alias("x")).agg(F.avg("x"), F.stddev_pop("x"), F.skewness("x"), F.kurtosis("x"), F.count_distinct("x") / F.count("*")).first()
    assert abs(s[0]) < 0.05 and abs(s[1] - 2) < 0.05 and abs(s[2]) < 0.08 and abs(s[3]) < 0.15 and s[4] > 0.99
    assert sorted(map(str, n.collect())) == sorted(map(str, G.gaussian_noise(p.repartition(3), std=2.0).collect()))


def test_dropout_takes_one_to_three_bands(spark):
    t = spark.range(400).select(F.col("id").cast("string").alias("tile_key"), F.lit(0).alias("r"), F.lit(0).alias("c"), F.array_repeat(F.lit(1.0), 16).alias("bands"))
    gone = [sum(v == 0 for v in x["bands"]) for x in G.channel_dropout(t, 16).collect()]
    assert set(gone) == {1, 2, 3} and all({sum(v == 0 for v in x["bands"]) for x in G.channel_dropout(t.withColumn("bands", F.slice("bands", 1, 4)), 4).collect()} == {1} for _ in "1")


def test_projections_there_and_back(spark):
    # Brussels and Kirkenes; the published worked example of the equal-area grid (50 N, 5 E).
    p = spark.createDataFrame([(4.35, 50.85, 31), (30.05, 69.73, 35), (5.0, 50.0, 31)], "lon double, lat double, utm int")
    x, y = J.geographic_to_laea(F.col("lon"), F.col("lat"))
    e, n = J.geographic_to_utm(F.col("lon"), F.col("lat"), F.col("utm"))
    p = p.withColumn("x", x).withColumn("y", y).withColumn("e", e).withColumn("n", n)
    lon, lat = J.laea_to_geographic(F.col("x"), F.col("y"))
    lon2, lat2 = J.utm_to_geographic(F.col("e"), F.col("n"), F.col("utm"))
    for r in p.select("*", lon.alias("lon1"), lat.alias("lat1"), lon2.alias("lon2"), lat2.alias("lat2")).collect():
        assert abs(r["lon1"] - r["lon"]) < 1e-8 and abs(r["lat1"] - r["lat"]) < 1e-8 and abs(r["lon2"] - r["lon"]) < 1e-8 and abs(r["lat2"] - r["lat"]) < 1e-8
        if r["lat"] == 50.0:
            assert abs(r["x"] - 3962799.45) < 0.01 and abs(r["y"] - 2999718.85) < 0.01


def test_reprojection_equals_brute_force(spark):
    h, w = 12, 9
    rows = [("a", r, c, (r * 5 + c) % 7, float(r * 10 + c)) for r in range(h) for c in range(w)]
    pixels = spark.createDataFrame(rows, "tile_key string, r int, c int, label int, b double")
    tiles = spark.createDataFrame([("a", 32, 512345.0, 5600000.0, 10.0, h, w)], "tile_key string, utm int, east double, north double, px double, h int, w int")
    got = {(x["gr"], x["gc"]): (x["label"], x["b"]) for x in J.reproject(pixels, tiles, 10.0, ["label"], ["b"]).collect()}
    # Place of every cell around the tile, by the projections themselves.
    near = spark.range(-40, 40).select(F.col("id").alias("i")).crossJoin(spark.range(-40, 40).select(F.col("id").alias("j")))
    mid = J.geographic_to_laea(*J.utm_to_geographic(F.lit(512390.0), F.lit(5599940.0), F.lit(32)))
    near = near.withColumn("gr", F.floor(mid[1] / 10) + F.col("i")).withColumn("gc", F.floor(mid[0] / 10) + F.col("j"))
    e, n = J.geographic_to_utm(*J.laea_to_geographic(F.col("gc") * 10.0, F.col("gr") * 10.0), F.lit(32))
    want = {}
    for x in near.select("gr", "gc", e.alias("e"), n.alias("n")).collect():
        y, z = (5600000.0 - x["n"]) / 10 - 0.5, (x["e"] - 512345.0) / 10 - 0.5
        r, c = math.floor(y + 0.5), math.floor(z + 0.5)
        if 0 <= r < h and 0 <= c < w:
            around = [(abs(1 - i - (y - math.floor(y))) * abs(1 - j - (z - math.floor(z))), math.floor(y) + i, math.floor(z) + j) for i in (0, 1) for j in (0, 1)]
            around = [(k, a * 10 + b) for k, a, b in around if 0 <= a < h and 0 <= b < w]
            want[x["gr"], x["gc"]] = ((r * 5 + c) % 7, sum(k * v for k, v in around) / sum(k for k, _ in around))
    assert len(want) > 90 and got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-6 for k in want)


def test_fingerprint_equals_a_plain_one(spark, sf001):
    tiles = {}
    for x in X.embed(spark, sf001).collect():
        tiles.setdefault(x["tile_key"], {})[x["r"], x["c"]] = x["bands"]
    got = {x["tile_key"]: x for x in QUERIES["a28_fingerprint"](spark, sf001).collect()}
    assert got.keys() == tiles.keys()
    for k, t in tiles.items():
        v = [b[0] for b in t.values()]
        mean = sum(v) / len(v)
        assert abs(got[k]["mean"] - mean) < 1e-9 and abs(got[k]["std"] - math.sqrt(sum((y - mean) ** 2 for y in v) / len(v))) < 1e-9
        assert got[k]["first"] == t[0, 0][:5]
    e = X.embed(spark, sf001)
    same = e.where("tile_key = '32630_0'")
    moved = same.withColumn("bands", F.when((F.col("r") == 1) & (F.col("c") == 1), F.transform("bands", lambda y: y + 1)).otherwise(F.col("bands")))
    sums = [B.fingerprint(df).first()["checksum"] for df in (same, same.orderBy(F.desc("r"), "c"), moved)]
    assert sums[0] == sums[1] != sums[2]


def test_a_plugged_model_equals_numpy(spark, sf001):
    import numpy as np

    bands = {x["vec_id"]: np.array(x["bands"]) for x in X.embed(spark, sf001).collect()}
    got = {}
    for x in QUERIES["x2_plugged_model"](spark, sf001).orderBy("vec_id", "cls").collect():
        got.setdefault(x["vec_id"], []).append(x["x"])
    assert got.keys() == bands.keys() and all(np.allclose(got[k], b[:13] * 2.0 - b[13:26], atol=1e-6) for k, b in bands.items())


def test_clusters_are_the_nearest_centroids(spark, sf001):
    """Lloyd's fixed point: each row is in the cluster whose mean is (nearly) the nearest."""
    import numpy as np

    r = np.random.default_rng(3)
    centres = r.normal(size=(4, 6)) * 10
    rows = [(int(i), (centres[i % 4] + r.normal(size=6)).tolist()) for i in range(200)]
    got = {x["id"]: x["cluster"] for x in KM.kmeans(spark.createDataFrame(rows, "id long, bands array<double>"), 4).collect()}
    assert len({(i % 4, k) for i, k in got.items()}) == 4 == len(set(got.values()))
    small = spark.createDataFrame([(i, 0 if i < 5 else 1) for i in range(7)], "id int, cluster int")
    assert {x["id"]: x["cluster"] for x in KM.drop_small(small, 3).collect()} == {i: 0 if i < 5 else -1 for i in range(7)}
    for name in ("m3_pixel_kmeans", "m4_reduced_kmeans"):
        assert QUERIES[name](spark, sf001).select("tile_key", "r", "c").distinct().count() == X.embed(spark, sf001).count()


def test_principal_components_keep_the_most_variance(spark):
    import numpy as np

    r = np.random.default_rng(4)
    x = r.normal(size=(150, 5)) * np.array([9.0, 5.0, 1.0, 0.1, 0.01]) @ np.linalg.qr(r.normal(size=(5, 5)))[0]
    got = KM.reduce_dimensions(spark.createDataFrame([(v.tolist(),) for v in x], "bands array<double>"), 2).select("reduced").collect()
    have = np.array([g[0] for g in got]).var(axis=0)
    want = np.sort(np.linalg.eigvalsh(np.cov(x.T, bias=True)))[::-1][:2]
    assert np.allclose(have, want, rtol=1e-6)


def test_seed_chain(spark, sf001):
    """Medoids by all pairs, their pixels with majority labels, merged into the training split."""
    import numpy as np

    seeds = {x["tile_key"]: x for x in QUERIES["m6_seed_tiles"](spark, sf001).collect()}
    members = {}
    for x in QUERIES["m5_tile_clusters"](spark, sf001).collect():
        members.setdefault(x["cluster"], []).append(x["tile_key"])
    vec, labels = {}, {}
    for x in X.embed(spark, sf001).collect():
        vec.setdefault(x["tile_key"], []).append(x["bands"])
        labels.setdefault(x["tile_key"], []).append(x["label"])
    mean = {k: np.mean(v, axis=0) for k, v in vec.items()}
    want = {}
    for k, tiles in members.items():
        if k != -1:
            cost = {t: round(sum(float(((mean[t] - mean[u]) ** 2).sum()) for u in tiles), 6) for t in tiles}
            want[k] = min(cost, key=lambda t: (cost[t], t))
    assert {x["cluster"]: t for t, x in seeds.items()} == want
    for t, x in seeds.items():
        assert x["label"] == min(set(labels[t]), key=lambda y: (-labels[t].count(y), y))
    pseudo = QUERIES["m6_pseudo_labels"](spark, sf001).collect()
    assert {x["tile_key"] for x in pseudo} == set(want.values()) and len(pseudo) == sum(len(vec[t]) for t in want.values())
    assert all(x["label"] in labels[x["tile_key"]] for x in pseudo)
    merged = QUERIES["m6_merged_split"](spark, sf001).collect()
    keys = [x["tile_key"] for x in merged]
    assert len(keys) == len(set(keys)) and set(want.values()) <= set(keys) and {x["split"] for x in merged} == {"train"}


def test_multilabel_split_sizes(spark, sf001):
    tiles = {x["stratum"]: x["n"] for x in QUERIES["m1_multilabel_split"](spark, sf001).collect()}
    sizes = {}
    for x in QUERIES["m1_multilabel_split_sizes"](spark, sf001).collect():
        sizes.setdefault(x["zone"], {})[x["split"]] = x["n"]
    for z, n in tiles.items():
        assert sum(sizes[z].values()) == n and abs(sizes[z].get("train", 0) - n / 1.2) <= 2


def one_by_one(items, share):
    """Iterative stratification of label sets, item by item."""
    labels = sorted({i for s in items for i in range(16) if s >> i & 1})
    want = {i: [sum(s >> i & 1 for s in items) * r for r in share] for i in labels}
    every, left, out = [len(items) * r for r in share], sorted(items), {}
    while left:
        count = {i: c for i in labels if (c := sum(s >> i & 1 for s in left))}
        rare = min(count, key=lambda i: (count[i], i)) if count else None
        for s in [s for s in left if rare is None or s >> rare & 1]:
            need = every if rare is None else want[rare]
            j = max(range(len(share)), key=lambda j: (need[j], every[j], -j))
            out.setdefault(s, [0] * len(share))[j] += 1
            every[j] -= 1
            for i in labels:
                if s >> i & 1:
                    want[i][j] -= 1
        left = [s for s in left if rare is not None and not s >> rare & 1]
    return out


@pytest.mark.parametrize("seed", range(8))
def test_label_sets_are_dealt_as_one_by_one(seed):
    import random

    r = random.Random(seed)
    sets = {s: r.choice([1, 2, 7, 40]) for s in (r.choice([0, r.getrandbits(5), r.getrandbits(9)]) for _ in range(r.randint(1, 30)))}
    items = [s for s, n in sets.items() for _ in range(n)]
    assert P.allocate_sets(sets, (0.625, 0.25, 0.125)) == one_by_one(items, (0.625, 0.25, 0.125))


def test_multilabel_split_shares_every_class(spark):
    import random

    r = random.Random(1)
    tiles = [(f"32632_{i}", [c for c in range(6) if r.random() < (0.9, 0.5, 0.3, 0.1, 0.05, 0.01)[c]]) for i in range(900)] + [("x", None)]
    got = {x["tile_key"]: x["split"] for x in P.multilabel(spark.createDataFrame(tiles, "tile_key string, labels array<int>"), (0.7, 0.2, 0.1)).collect()}
    assert got.keys() == {t for t, _ in tiles}
    for c in range(6):
        of = [got[t] for t, labels in tiles if labels and c in labels]
        # What a rarer class took of a commoner one is made good by the rest; whole sets leave a tile or two.
        assert all(abs(of.count(name) - len(of) * share) <= 2 for name, share in zip(P.SPLITS, (0.7, 0.2, 0.1))), (c, of.count("train"), len(of))
    assert got == {x["tile_key"]: x["split"] for x in P.multilabel(spark.createDataFrame(tiles[::-1], "tile_key string, labels array<int>"), (0.7, 0.2, 0.1)).collect()}


@pytest.mark.parametrize("per_range", [50_000, 40])
def test_top_of_zones_without_a_window_over_a_zone(spark, per_range):
    import random

    r = random.Random(2)
    tiles = [(f"t{i:04d}", r.choice("aab"), r.choice([0.0, 0.0, r.random()])) for i in range(800)]
    df = spark.createDataFrame(tiles, "tile_key string, zone string, entropy double")
    got = S.top_of(df, spark.createDataFrame([("a", 300), ("b", 7)], "zone string, limit int"), ["zone"], per_range)
    want = [(k, z, e, i + 1) for zone, n in (("a", 300), ("b", 7)) for i, (k, z, e) in enumerate(sorted((t for t in tiles if t[1] == zone), key=lambda t: (-t[2], t[0]))[:n])]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    # A table of one range has a constant in its place.
    assert per_range > 800 or all("__b" in line for line in plan.splitlines() if "row_number()" in line and "Window" in line)


def plain_density(vecs, min_size, k):
    """Clusters by recursion over the sorted full graph: sets of points."""
    n = len(vecs)
    d = [[math.dist(a, b) for b in vecs] for a in vecs]
    core = [sorted(r)[min(k, n - 1)] for r in d]
    edges = sorted((max(d[i][j], core[i], core[j]), i, j) for i in range(n) for j in range(i + 1, n))
    group = {i: (frozenset([i]), None) for i in range(n)}  # set, (height, left, right)
    at = list(range(n))
    for w, i, j in edges:
        a, b = at[i], at[j]
        if a != b:
            group[a] = (group[a][0] | group[b][0], (w, group[a], group[b]))
            at = [a if x == b else x for x in at]
    root = group[at[0]]

    def grow(tree, born):
        """Stability of the cluster that begins with ``tree``, its two successors, and the clusters chosen below it."""
        total, best, below = 0.0, 0.0, []
        while tree[1]:
            w, x, y = tree[1]
            gain = (math.inf if w == 0 else 1 / w) - born
            if len(x[0]) >= min_size and len(y[0]) >= min_size:
                total += gain * (len(x[0]) + len(y[0]))
                for t in (x, y):
                    s, chosen = grow(t, born + gain)
                    best += s
                    below += chosen
                break
            big = [t for t in (x, y) if len(t[0]) >= min_size]
            total += gain * sum(len(t[0]) for t in (x, y) if len(t[0]) < min_size)
            if not big:
                break
            tree = big[0]
        return (best, below) if best > total else (total, [None])

    def clusters(tree):
        """Sets of the chosen clusters; the root is none."""
        def mark(tree, born):
            start = tree[0]
            s, chosen = grow(tree, born)
            if chosen == [None]:
                return [start]
            while True:
                w, x, y = tree[1]
                if len(x[0]) >= min_size and len(y[0]) >= min_size:
                    return mark(x, 1 / w) + mark(y, 1 / w)
                tree = x if len(x[0]) >= min_size else y

        while tree[1]:
            w, x, y = tree[1]
            if len(x[0]) >= min_size and len(y[0]) >= min_size:
                return mark(x, 1 / w) + mark(y, 1 / w)
            big = [t for t in (x, y) if len(t[0]) >= min_size]
            if not big:
                return []
            tree = big[0]
        return []

    return clusters(root)


@pytest.mark.parametrize("n,block", [(240, 64), (60, 1024)])
def test_density_clusters_equal_plain_ones(spark, monkeypatch, n, block):
    import random

    monkeypatch.setattr(N, "BLOCK", block)
    r = random.Random(n)
    mids = [(0, 0), (4, 1), (1, 5), (5.2, 1.1)]
    vecs = [tuple(m + r.gauss(0, s) for m in mids[i % 4]) if i % 5 else (r.uniform(-3, 9), r.uniform(-3, 9)) for i in range(n) for s in [(0.3, 0.5, 0.4, 0.2)[i % 4]]]
    vecs.append(vecs[1])
    # Many edges weigh a core distance; ties go by the tiles' seeded order.
    vecs = [v for _, v in sorted((hashlib.md5(f"t{i}".encode()).hexdigest(), v) for i, v in enumerate(vecs))]
    keys = sorted((f"t{i}" for i in range(len(vecs))), key=lambda k: hashlib.md5(k.encode()).hexdigest())
    place = {k: i for i, k in enumerate(keys)}
    got = {x["tile_key"]: x["cluster"] for x in N.density_clusters(spark.createDataFrame([(k, list(v)) for k, v in zip(keys, vecs)], "tile_key string, vec array<double>"), 8, 4).collect()}
    assert got.keys() == {f"t{i}" for i in range(len(vecs))}
    sets = {c: {place[t] for t, x in got.items() if x == c} for c in set(got.values()) - {-1}}
    want = plain_density(vecs, 8, 4)
    assert len(want) > 1 and -1 in got.values()
    # Members that fell out of a chosen cluster later on still belong to it.
    assert sorted(map(sorted, sets.values())) == sorted(map(sorted, want))


def test_density_of_few_tiles(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0])], "tile_key string, vec array<double>")
    assert [tuple(x) for x in N.density_clusters(df, 2).collect()] == [("a", -1)] and N.density_clusters(df.where("false"), 2).count() == 0


def roll(n, seed=3):
    """Points of a spiral band in ten dimensions, in the order of their keys' digests, with their keys."""
    import numpy as np

    r = np.random.default_rng(seed)
    t, h = 1.5 * np.pi * (1 + 2 * r.random(n)), 12 * r.random(n)
    x = np.stack([t * np.cos(t), h, t * np.sin(t)], axis=1) @ np.linalg.qr(r.normal(size=(10, 3)))[0].T
    return sorted((f"t{i}" for i in range(n)), key=lambda k: hashlib.md5(k.encode()).hexdigest()), x, t


def vectors(spark, keys, x):
    return spark.createDataFrame([(k, None if v is None else [float(a) for a in v]) for k, v in zip(keys, x)], "tile_key string, vec array<double>")


@pytest.mark.parametrize("block", [1024, 40])
@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_nearest_equal_plain_ones(spark, monkeypatch, block, metric):
    import numpy as np

    monkeypatch.setattr(N, "BLOCK", block)
    monkeypatch.setattr(NB, "BLOCK", block)
    keys, x, _ = roll(130)
    x[5] = x[77]  # a copy
    x[9] = 0
    got = {}
    for row in NB.nearest_tiles(vectors(spark, keys + ["none"], [*x, None]), 7, metric).collect():
        got.setdefault(row["tile_key"], {})[row["k"]] = (row["other"], row["d"])
    length = np.linalg.norm(x, axis=1, keepdims=True)
    v = x / np.where(length > 0, length, 1) if metric == "cosine" else x
    d = ((v[:, None] - v) ** 2).sum(axis=2)
    d = np.round(d / 2 if metric == "cosine" else np.sqrt(d), 9)
    np.fill_diagonal(d, np.inf)
    assert got.keys() == set(keys)
    for i, key in enumerate(keys):
        want = sorted(range(130), key=lambda j: (d[i, j], j))[:7]
        assert [got[key][k + 1][0] for k in range(7)] == [keys[j] for j in want]
    assert got[keys[5]][1] == (keys[77], 0.0)
    assert got[keys[9]][1][1] == (0.5 if metric == "cosine" else round(float(np.sort(length[:, 0])[1]), 9))


def test_graph_functions_equal_dense_eigenvectors_and_keep_neighbourhoods(spark):
    import numpy as np

    keys, x, t = roll(300)
    points = NB.placed(vectors(spark, keys, x), "euclidean")
    graph = NB.neighbour_graph(NB.nearest(points, 300, 10, "euclidean"))
    f, values = NB.graph_functions(NB.written(graph, "graph"), 3, tolerance=1e-3)
    w = np.zeros((300, 300))
    for a, b, v in graph.collect():
        assert w[a, b] == 0
        w[a, b] = v
    assert np.array_equal(w, w.T) and w.diagonal().max() == 0 and ((w > 0).sum(axis=1) >= 10).all()
    g = w.sum(axis=1)
    value, vec = np.linalg.eigh(w / np.sqrt(np.outer(g, g)))
    assert values == pytest.approx(value[::-1][1:4], abs=1e-4)
    got = np.array([row[1:] for row in sorted(f.collect())])
    for i in range(3):
        want = vec[:, -2 - i] / np.sqrt(g / g.sum())
        assert abs(np.corrcoef(got[:, i], want)[0, 1]) > 0.999
        assert (got[:, i] ** 2 * g).sum() / g.sum() == pytest.approx(1, abs=1e-6)
    # The first function follows the band better than any principal component.
    rank = lambda v: np.argsort(np.argsort(v))
    follows = lambda v: abs(np.corrcoef(rank(v), rank(t))[0, 1])
    centred = x - x.mean(axis=0)
    assert follows(got[:, 0]) > max(follows(centred @ v) for v in np.linalg.svd(centred, full_matrices=False)[2][:3])

    def near(v):
        d = ((v[:, None] - v) ** 2).sum(axis=2)
        np.fill_diagonal(d, np.inf)
        return np.argsort(d, axis=1)[:, :10]

    # All pairs are compared; chance alone keeps 3 % of them.
    kept = lambda v: np.mean([len(set(a) & set(b)) / 10 for a, b in zip(near(x), near(v))])
    first = np.linalg.svd(centred, full_matrices=False)[2][0]
    assert kept(got) > 0.5 and kept(got) > kept((centred @ first)[:, None])


def test_reduction_of_parts_copies_and_few_tiles(spark):
    import numpy as np

    r = np.random.default_rng(0)
    x = np.concatenate([r.normal(size=(30, 4)) * 0.1, 50 + r.normal(size=(30, 4)) * 0.1, np.full((12, 4), 99.0)])
    keys = [f"k{i}" for i in range(len(x))]
    df = vectors(spark, keys + ["none"], [*x, None])
    low = {row["tile_key"]: row["reduced"] for row in NB.reduce_by_neighbours(df, 2, 5, "euclidean").collect()}
    assert low.keys() == {*keys, "none"} and low["none"] is None
    a, b, c = (np.array([low[k] for k in part]) for part in (keys[:30], keys[30:60], keys[60:]))
    # Three parts without a link between them: a point each, apart from one another.
    for part in (a, b, c):
        assert np.ptp(part, axis=0).max() < 0.05
    assert min(np.linalg.norm(p.mean(axis=0) - q.mean(axis=0)) for p, q in ((a, b), (a, c), (b, c))) > 0.5
    few = lambda n: [(z["tile_key"], z["reduced"]) for z in NB.reduce_by_neighbours(vectors(spark, keys[:n], x[:n]), 2, 5, "euclidean").collect()]
    assert few(0) == [] and few(1) == [("k0", [0.0, 0.0])]
    two = few(2)
    assert len(two) == 2 and all(len(v) == 2 and v[1] == 0 for _, v in two)
    with pytest.raises(ValueError):
        NB.placed(df, "manhattan")


def test_counts_of_a_stream_without_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    schema = X.predictions(spark, "/root/testdata/sf0.001").select("tile_key", "r", "c", "label", "pred").schema
    args = (spark, str(tmp_path / "in"), schema, str(tmp_path / "out"), str(tmp_path / "ckpt"))
    assert jobs.stream_confusion(*args).collect() == []
    spark.createDataFrame([("a", 0, 0, 1, 2)], schema).write.mode("append").parquet(str(tmp_path / "in"))
    assert [tuple(x) for x in jobs.stream_confusion(*args).collect()] == [(1, 2, 1)]


def test_documents_have_a_bound(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(sinks, "DOCUMENT_TILES", 1)
    with pytest.raises(ValueError):
        sinks.write_splits_document(spark.createDataFrame([("a", "train"), ("b", "val")], "tile_key string, split string"), str(tmp_path / "d"))


def test_arrays_of_any_shape_decode(spark):
    import io

    import numpy as np

    def npy(a):
        f = io.BytesIO()
        np.save(f, a)
        return f.getvalue()

    rows = [("a", npy(np.arange(24).reshape(2, 3, 4))), ("b", npy(np.zeros((3, 3)))), ("c", b"no array"), ("d", npy(np.zeros((0, 2, 2))))]
    got = files.decode_arrays(spark.createDataFrame(rows, "tile_key string, content binary")).collect()
    assert sorted((x["r"], x["c"], x["bands"]) for x in got if x["tile_key"] == "a") == [(r, c, [float(r * 12 + c * 4 + k) for k in range(4)]) for r in range(2) for c in range(3)]
    assert {x["tile_key"]: x["status"] for x in got if x["tile_key"] != "a"} == {"b": "error:ValueError", "c": "error:ValueError"}


def test_tile_with_an_empty_first_row_is_not_empty(spark, monkeypatch):
    cells = [("a", r, c, [-32768.0 if r == 0 else 1.0] * 4) for r in range(3) for c in range(2)] + [("b", 0, 0, [-32768.0] * 4), ("b", 1, 0, [-32768.0] * 4)]
    df = spark.createDataFrame(cells, "tile_key string, r int, c int, bands array<double>")
    monkeypatch.setattr(X, "banded", lambda s, d: df)
    assert {x["tile_key"]: x["empty"] for x in QUERIES["p30_all_nodata_tile"](spark, "").collect()} == {"a": False, "b": True}


def test_projection_origin(spark):
    # The grid's origin is 10 E, 52 N; zone 32632's meridian is 9 E.
    lon, lat = J.utm_to_geographic(F.lit(568649.0), F.lit(5761510.9), F.lit(32))
    x, y = J.geographic_to_laea(F.lit(10.0), F.lit(52.0))
    r = spark.range(1).select(lon, lat, x, y).first()
    assert abs(r[0] - 10) < 1e-4 and abs(r[1] - 52) < 1e-4
    assert math.isclose(r[2], 4321000.0, abs_tol=1e-3) and math.isclose(r[3], 3210000.0, abs_tol=1e-3)


def test_weights_of_absent_classes(spark):
    c = spark.createDataFrame([(0, 90), (1, 10), (2, 0)], "cls int, n long")
    med = {r["cls"]: r["weight"] for r in W.median_frequency(c).collect()}
    assert med[2] == 0 and med[1] > med[0]
    ref = {r["cls"]: r["weight"] for r in W.effective_number(c).collect()}
    cor = {r["cls"]: r["weight"] for r in W.effective_number(c, mode="corrected").collect()}
    assert ref[0] > ref[1] and cor[0] < cor[1]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark, sf001):
    labels = X.labels(spark, sf001).select("tile_key", "label")
    assert "l_extendedprice" not in plan(spark.read.parquet(f"{sf001}/lineitem.parquet").select("l_suppkey"))
    tiles = H.tile_metrics(X.histograms(spark, sf001))
    assert "WindowGroupLimit" in plan(S.top_per_zone(tiles, 3))
    draws = X.tiles(spark, sf001).select(F.col("tile_id").alias("draw"), F.col("tile_id").alias("u"))
    i = W.cumulative(X.tiles(spark, sf001).select("tile_key", F.lit(5).alias("mass")))
    for df in (W.draw(i, draws, 50), G.patches(labels.withColumn("r", F.lit(1)).withColumn("c", F.lit(1)), 8, 6, "pad_edge")):
        assert "BroadcastNestedLoopJoin" not in plan(df) and "CartesianProduct" not in plan(df)


def test_listing_is_made_by_tasks(spark, tmp_path):
    """No file index of the driver holds the files; what counts is what Spark's own reader finds."""
    root = str(tmp_path / "a b")
    texts = spark.range(60).select(F.format_string("z%d/x/band_32633_%d.%s", F.col("id") % 3, "id", F.when(F.col("id") % 4 == 0, "json").otherwise("TxT")).alias("name"),
                                   F.repeat(F.lit("é"), F.col("id").cast("int")).alias("text"))
    sinks.write_texts(texts, root)
    for extra in ("_SUCCESS", ".hidden.txt", "_z/in.txt", "k=1/_n=2.txt", "top.txt"):
        (tmp_path / "a b" / extra).parent.mkdir(exist_ok=True)
        (tmp_path / "a b" / extra).write_text("1")
    got = files.listing(spark, root)
    assert not [f for f in got.inputFiles() if "band_" in f]
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).selectExpr("path", "length", "modificationTime as mtime")
    ms = lambda df: sorted((r["path"], r["length"], int(r["mtime"].timestamp() * 1000)) for r in df.collect())
    assert ms(got.where("length > 0")) == ms(reader.where("length > 0")) and got.count() == 62
    assert files.listing(spark, root, (".txt",)).count() == 47
    assert files.listing(spark, root, recursive=False).count() == 1
    assert (tmp_path / "a b" / "z1" / "x" / "band_32633_7.TxT").read_text() == "é" * 7
