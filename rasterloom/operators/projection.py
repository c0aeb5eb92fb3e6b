"""Map projections, and tiles moved from one grid to another.

The formulas work on columns and on NumPy arrays alike (``COLUMNS``, ``ARRAYS``). Single points can be
columns; grids of cells are projected in Arrow batches, since expression trees that feed
several projections into one another grow beyond what can be compiled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import sample

#: Functions that the formulas use, on columns and on arrays.
COLUMNS = SimpleNamespace(**{n: getattr(F, n) for n in ("sin", "cos", "sinh", "cosh", "asin", "atan2", "atanh", "sqrt", "log", "degrees", "radians")}, where=lambda c, a, b: F.when(c, a).otherwise(b))
ARRAYS = SimpleNamespace(**{n: getattr(np, n) for n in ("sin", "cos", "sinh", "cosh", "sqrt", "log", "degrees", "radians", "where")}, asin=np.arcsin, atan2=np.arctan2, atanh=np.arctanh)
#: Rows of the target grid that one task projects together.
BAND = 64


def utm_to_geographic(east: Column, north: Column, zone: Column, m=COLUMNS) -> tuple:
    """Longitude and latitude in degrees of northern UTM coordinates (WGS 84), by the published series."""
    a, f, k0 = 6378137.0, 1 / 298.257223563, 0.9996
    n = f / (2 - f)
    A = a / (1 + n) * (1 + n ** 2 / 4 + n ** 4 / 64)
    beta = (n / 2 - 2 * n ** 2 / 3 + 37 * n ** 3 / 96, n ** 2 / 48 + n ** 3 / 15, 17 * n ** 3 / 480)
    delta = (2 * n - 2 * n ** 2 / 3 - 2 * n ** 3, 7 * n ** 2 / 3 - 8 * n ** 3 / 5, 56 * n ** 3 / 15)
    xi, eta = north / (k0 * A), (east - 500000.0) / (k0 * A)
    x1 = xi - sum(b * m.sin(2 * (j + 1) * xi) * m.cosh(2 * (j + 1) * eta) for j, b in enumerate(beta))
    e1 = eta - sum(b * m.cos(2 * (j + 1) * xi) * m.sinh(2 * (j + 1) * eta) for j, b in enumerate(beta))
    chi = m.asin(m.sin(x1) / m.cosh(e1))
    lat = chi + sum(dl * m.sin(2 * (j + 1) * chi) for j, dl in enumerate(delta))
    lon = m.atan2(m.sinh(e1), m.cos(x1))
    return m.degrees(lon) + (zone % 100) * 6 - 183, m.degrees(lat)


def geographic_to_laea(lon: Column, lat: Column, lon0: float = 10.0, lat0: float = 52.0, east0: float = 4321000.0, north0: float = 3210000.0, m=COLUMNS) -> tuple:
    """East and north in the Lambert azimuthal equal-area grid of Europe (GRS 80), by the published formulas."""
    a, f = 6378137.0, 1 / 298.257222101
    e2 = 2 * f - f * f
    e = math.sqrt(e2)

    def q(s, log, one=1.0):
        return (1 - e2) * (s / (one - e2 * s * s) - log((one - e * s) / (one + e * s)) / (2 * e))

    qp, q0 = q(1.0, math.log), q(math.sin(math.radians(lat0)), math.log)
    b0, rq = math.asin(q0 / qp), a * math.sqrt(qp / 2)
    d = a * math.cos(math.radians(lat0)) / math.sqrt(1 - e2 * math.sin(math.radians(lat0)) ** 2) / (rq * math.cos(b0))
    s = m.sin(m.radians(lat))
    beta = m.asin((1 - e2) * (s / (1 - e2 * s * s) - m.log((1 - e * s) / (1 + e * s)) / (2 * e)) / qp)
    dl = m.radians(lon - lon0)
    b = rq * m.sqrt(2 / (1 + math.sin(b0) * m.sin(beta) + math.cos(b0) * m.cos(beta) * m.cos(dl)))
    return (east0 + b * d * m.cos(beta) * m.sin(dl),
            north0 + b / d * (math.cos(b0) * m.sin(beta) - math.sin(b0) * m.cos(beta) * m.cos(dl)))


def geographic_to_utm(lon: Column, lat: Column, zone: Column, m=COLUMNS) -> tuple:
    """East and north of northern UTM coordinates (WGS 84), by the published series."""
    a, f, k0 = 6378137.0, 1 / 298.257223563, 0.9996
    n = f / (2 - f)
    A = a / (1 + n) * (1 + n ** 2 / 4 + n ** 4 / 64)
    alpha = (n / 2 - 2 * n ** 2 / 3 + 5 * n ** 3 / 16, 13 * n ** 2 / 48 - 3 * n ** 3 / 5, 61 * n ** 3 / 240)
    e = 2 * math.sqrt(n) / (1 + n)
    s = m.sin(m.radians(lat))
    t = m.sinh(m.atanh(s) - e * m.atanh(e * s))
    dl = m.radians(lon - ((zone % 100) * 6 - 183))
    x1, e1 = m.atan2(t, m.cos(dl)), m.atanh(m.sin(dl) / m.sqrt(1 + t * t))
    east = e1 + sum(b * m.cos(2 * (j + 1) * x1) * m.sinh(2 * (j + 1) * e1) for j, b in enumerate(alpha))
    north = x1 + sum(b * m.sin(2 * (j + 1) * x1) * m.cosh(2 * (j + 1) * e1) for j, b in enumerate(alpha))
    return 500000.0 + k0 * A * east, k0 * A * north


def laea_to_geographic(x: Column, y: Column, lon0: float = 10.0, lat0: float = 52.0, east0: float = 4321000.0, north0: float = 3210000.0, m=COLUMNS) -> tuple:
    """Longitude and latitude of the Lambert azimuthal equal-area grid of Europe (GRS 80), by the published formulas."""
    a, f = 6378137.0, 1 / 298.257222101
    e2 = 2 * f - f * f
    e = math.sqrt(e2)
    q = lambda s: (1 - e2) * (s / (1 - e2 * s * s) - math.log((1 - e * s) / (1 + e * s)) / (2 * e))
    s0 = math.sin(math.radians(lat0))
    qp = q(1.0)
    b0, rq = math.asin(q(s0) / qp), a * math.sqrt(qp / 2)
    d = a * math.cos(math.radians(lat0)) / math.sqrt(1 - e2 * s0 * s0) / (rq * math.cos(b0))
    dx, dy = (x - east0) / d, (y - north0) * d
    rho = m.sqrt(dx * dx + dy * dy)
    c = 2 * m.asin(rho / (2 * rq))
    up = m.where(rho == 0, math.sin(b0), m.cos(c) * math.sin(b0) + dy * m.sin(c) * math.cos(b0) / m.where(rho == 0, 1.0, rho))
    beta = m.asin(up)
    lon = math.radians(lon0) + m.atan2(dx * m.sin(c), rho * math.cos(b0) * m.cos(c) - dy * math.sin(b0) * m.sin(c))
    lat = (beta + (e2 / 3 + 31 * e2 ** 2 / 180 + 517 * e2 ** 3 / 5040) * m.sin(2 * beta) + (23 * e2 ** 2 / 360 + 251 * e2 ** 3 / 3780) * m.sin(4 * beta)
           + 761 * e2 ** 3 / 45360 * m.sin(6 * beta))
    return m.degrees(m.where(rho == 0, math.radians(lon0), lon)), m.degrees(lat)


def _boxes(batches: Iterator[pa.RecordBatch], res: float) -> Iterator[pa.RecordBatch]:
    """Rows and columns of the target grid that each tile's box covers: its corners and the middles of its sides, one cell wider."""
    for b in batches:
        utm, east, north, px, h, w = (b.column(b.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in ("utm", "east", "north", "px", "h", "w"))
        i, j = (x.ravel() / 2 for x in np.meshgrid(range(3), range(3), indexing="ij"))
        lon, lat = utm_to_geographic(east[:, None] + (px * w)[:, None] * j, north[:, None] - (px * h)[:, None] * i, utm[:, None], ARRAYS)
        x, y = geographic_to_laea(lon, lat, m=ARRAYS)
        ends = [np.floor(f(v / res, axis=1)).astype(np.int64) + more for v in (y, x) for f, more in ((np.min, -1), (np.max, 2))]
        yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, ends)], [*b.schema.names, "r_lo", "r_hi", "c_lo", "c_hi"])


def _looked_up(batches: Iterator[pa.RecordBatch], res: float) -> Iterator[pa.RecordBatch]:
    """Cells of a band of the target grid with the place of their centre in the tile, where it lies in it."""
    for b in batches:
        rows = b.select(["utm", "east", "north", "px", "h", "w", "r_hi", "c_lo", "c_hi", "from"]).to_pylist()
        for i, t in enumerate(rows):
            gr, gc = (x.ravel() for x in np.meshgrid(np.arange(t["from"], min(t["from"] + BAND, t["r_hi"] + 1)), np.arange(t["c_lo"], t["c_hi"] + 1), indexing="ij"))
            lon, lat = laea_to_geographic(gc * res, gr * res, m=ARRAYS)
            e, n = geographic_to_utm(lon, lat, t["utm"], ARRAYS)
            y, x = (t["north"] - n) / t["px"] - 0.5, (e - t["east"]) / t["px"] - 0.5
            ok = (y >= -0.5) & (x >= -0.5) & (y < t["h"] - 0.5) & (x < t["w"] - 0.5)
            key = b.column(b.schema.get_field_index("tile_key"))
            yield pa.RecordBatch.from_arrays([pa.array([key[i].as_py()] * int(ok.sum()), key.type), *(pa.array(v[ok]) for v in (gr, gc, y, x))], ["tile_key", "gr", "gc", "y", "x"])


def laea_places(tiles: DataFrame, res: float) -> DataFrame:
    """``tile_key, gr, gc, y, x``: cells of the equal-area grid (centres ``gr * res, gc * res``) whose centre lies in a tile, and where.

    ``tiles``: ``tile_key, utm`` (zone), ``east, north`` (outer corner of pixel (0, 0), rows
    go south), ``px`` (pixel size), ``h, w``. A tile's cells are dealt in bands of ``BAND`` rows.
    """
    kind = dict(tiles.dtypes)["tile_key"]
    t = tiles.selectExpr("tile_key", "cast(utm as int) utm", "cast(east as double) east", "cast(north as double) north", "cast(px as double) px", "cast(h as int) h", "cast(w as int) w")
    given = ", ".join(f"{n} {k}" for n, k in t.dtypes)
    boxes = t.mapInArrow(lambda b: _boxes(b, res), given + ", r_lo long, r_hi long, c_lo long, c_hi long")
    bands = boxes.withColumn("from", F.explode(F.sequence(F.col("r_lo"), F.col("r_hi"), F.lit(BAND)))).repartition("tile_key", "from")
    return bands.mapInArrow(lambda b: _looked_up(b, res), f"tile_key {kind}, gr long, gc long, y double, x double")


def reproject(pixels: DataFrame, tiles: DataFrame, res: float, nearest: list[str], bilinear: list[str]) -> DataFrame:
    """A tile table in UTM zones on the equal-area grid: ``tile_key, gr, gc`` and the columns.

    Each grid cell looks its centre up in its tile: ``nearest`` columns (labels) take the
    pixel that holds it, ``bilinear`` ones (bands) the mean of the four pixels around it
    that exist, by distance. Cells whose centre lies in no pixel are left out.
    """
    return sample(pixels, laea_places(tiles, res), nearest, bilinear)
