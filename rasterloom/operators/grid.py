"""Raster grids: crops, padding, windows, flips, neighbourhoods, mosaics, regridding."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def extents(pixels: DataFrame) -> DataFrame:
    """Height and width of each tile."""
    return pixels.groupBy("tile_key").agg((F.max("r") + 1).alias("h"), (F.max("c") + 1).alias("w"))


def center_crop(pixels: DataFrame, size: int) -> DataFrame:
    e = extents(pixels).withColumn("i0", F.expr(f"greatest(0, (h - {size}) div 2)")).withColumn("j0", F.expr(f"greatest(0, (w - {size}) div 2)"))
    return _window(pixels, e, size)


def random_crop(pixels: DataFrame, size: int, seed: int = 42) -> DataFrame:
    """Window at an offset taken from a hash of seed and key."""
    dice = lambda axis: F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:{axis}:"), "tile_key")), 1, 8), 16, 10).cast("long")
    e = extents(pixels)
    for n, axis, out in (("h", "r", "i0"), ("w", "c", "j0")):
        e = e.withColumn(out, (dice(axis) % F.greatest(F.lit(1), F.col(n) - size + 1)).cast("int"))
    return _window(pixels, e, size)


def _window(pixels: DataFrame, e: DataFrame, size: int) -> DataFrame:
    p = pixels.join(e.select("tile_key", "i0", "j0"), "tile_key").where(f"r between i0 and i0 + {size - 1} and c between j0 and j0 + {size - 1}")
    return p.withColumn("r", (F.col("r") - F.col("i0")).cast("int")).withColumn("c", (F.col("c") - F.col("j0")).cast("int")).drop("i0", "j0")


def canvas(tiles: DataFrame, h: int, w: int) -> DataFrame:
    """All cells of an h x w grid for each tile."""
    t = tiles.select("tile_key").distinct()
    return t.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(h - 1)))).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(w - 1))))


def pad_to(pixels: DataFrame, size: int, fill: dict[str, float]) -> DataFrame:
    """Pads short tiles evenly on both sides; ``fill`` gives the value of each column."""
    e = extents(pixels).withColumn("top", F.expr(f"greatest(0, {size} - h) div 2")).withColumn("lead", F.expr(f"greatest(0, {size} - w) div 2"))
    grid = (e.withColumn("r", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(size), "h") - 1))).withColumn("c", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(size), "w") - 1))))
    moved = pixels.join(e.select("tile_key", "top", "lead"), "tile_key").select(
        "tile_key", (F.col("r") + F.col("top")).cast("int").alias("r"), (F.col("c") + F.col("lead")).cast("int").alias("c"), *fill)
    out = grid.select("tile_key", "r", "c").join(moved, ["tile_key", "r", "c"], "left")
    return out.select("tile_key", "r", "c", *[F.coalesce(k, F.lit(v)).alias(k) for k, v in fill.items()])


def window_scan(pixels: DataFrame, i: int, j: int, size: int, fill: dict[str, float]) -> DataFrame:
    """Window at (i, j), with fill where the tile has no pixels."""
    part = pixels.where(F.col("r").between(i, i + size - 1) & F.col("c").between(j, j + size - 1))
    part = part.select("tile_key", (F.col("r") - i).cast("int").alias("r"), (F.col("c") - j).cast("int").alias("c"), *fill)
    out = canvas(pixels, size, size).join(part, ["tile_key", "r", "c"], "left")
    return out.select("tile_key", "r", "c", *[F.coalesce(k, F.lit(v)).alias(k) for k, v in fill.items()])


def edge_padded(pixels: DataFrame, size: int, value: str) -> DataFrame:
    """Fills a size x size grid by repeating the last row and column."""
    e = extents(pixels)
    grid = canvas(pixels, size, size).join(e, "tile_key")
    src = grid.select("tile_key", "r", "c", F.least("r", F.col("h") - 1).cast("int").alias("sr"), F.least("c", F.col("w") - 1).cast("int").alias("sc"))
    return src.join(pixels.select("tile_key", F.col("r").alias("sr"), F.col("c").alias("sc"), value), ["tile_key", "sr", "sc"], "left").drop("sr", "sc")


def starts(length: Column, size: int, stride: int, mode: str) -> Column:
    """First rows (or columns) of windows. ``pad_edge``: 0, s, 2s, ... below the length;
    ``anchor_end``: those that fit, and one at the end if they leave a rest."""
    if mode == "pad_edge":
        return F.sequence(F.lit(0), length - 1, F.lit(stride))
    fit = F.greatest(F.lit(0), length - size)
    seq = F.sequence(F.lit(0), fit, F.lit(stride))
    return F.when(fit % stride != 0, F.concat(seq, F.array(fit.cast("int")))).otherwise(seq)


def patches(pixels: DataFrame, size: int, stride: int, mode: str) -> DataFrame:
    """Each pixel with every window that covers it, by arithmetic on its place: no range join."""
    p = pixels.join(extents(pixels), "tile_key")
    cover = lambda axis, n: F.filter(starts(F.col(n), size, stride, mode), lambda s: (s <= F.col(axis)) & (F.col(axis) < s + size))
    p = p.withColumn("pi", F.explode(cover("r", "h"))).withColumn("pj", F.explode(cover("c", "w")))
    return p.drop("h", "w")


def flip(pixels: DataFrame, how: str, size: tuple[int, int] | None = None) -> DataFrame:
    """``h``: columns reversed, ``v``: rows, ``90``/``180``/``270``: turned counter-clockwise.

    Within ``size`` (height and width) where all tiles have one, whatever cells they lack; else within each tile's own extent.
    """
    p = pixels.join(extents(pixels), "tile_key") if size is None else pixels.withColumns({"h": F.lit(size[0]), "w": F.lit(size[1])})
    r, c, h, w = (F.col(x) for x in ("r", "c", "h", "w"))
    to = {"h": (r, w - 1 - c), "v": (h - 1 - r, c), "90": (w - 1 - c, r), "180": (h - 1 - r, w - 1 - c), "270": (c, h - 1 - r)}[how]
    return p.withColumns({"r": to[0].cast("int"), "c": to[1].cast("int")}).drop("h", "w")


def neighbours(pixels: DataFrame, offsets: list[tuple[int, int, float]], columns: list[str]) -> DataFrame:
    """Each pixel sent to the cells whose neighbour it is, with a weight: ``r, c, weight`` and the columns."""
    o = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(float(k)).alias("k")) for a, b, k in offsets]))
    return pixels.withColumn("o", o).select("tile_key", (F.col("r") - F.col("o.a")).cast("int").alias("r"), (F.col("c") - F.col("o.b")).cast("int").alias("c"),
                                            F.col("o.k").alias("weight"), *columns)


def channel_dropout(pixels: DataFrame, n_bands: int, seed: int = 42) -> DataFrame:
    """One to min(3, ``n_bands`` / 4) bands of each tile set to 0, number and bands chosen by hash."""
    most = max(1, min(3, n_bands // 4))
    dice = lambda *x: F.md5(F.concat(F.lit(f"{seed}:"), "tile_key", *x))
    many = (F.conv(F.substring(dice(F.lit(":n")), 1, 8), 16, 10).cast("long") % most + 1).cast("int")
    order = F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(n_bands - 1)), lambda i: F.struct(dice(F.lit(":"), i.cast("string")).alias("h"), i.alias("i"))))
    drop = F.slice(F.transform(order, lambda x: x["i"]), 1, many)
    p = pixels.withColumn("__drop", drop)
    return p.withColumn("bands", F.transform("bands", lambda x, i: F.when(F.array_contains("__drop", i), 0.0).otherwise(x))).drop("__drop")


def gaussian_noise(pixels: DataFrame, std: float = 0.01, seed: int = 42, n_bands: int | None = None) -> DataFrame:
    """Adds normal noise to every band, from two digests of seed, cell and band by the Box-Muller transform. Where all
    pixels have ``n_bands``, each band is an expression of its own, which Spark compiles; else a function goes over the array."""
    def unit(k: int, i: Column) -> Column:
        """Between 0 (excluded) and 1, in 2 ** 32 steps."""
        name = F.concat_ws(":", F.lit(f"{seed}:noise{k}"), "tile_key", F.col("r").cast("string"), F.col("c").cast("string"), i.cast("string"))
        return (F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("double") + 1.0) / 4294967296.0

    noisy = lambda x, i: x + std * F.sqrt(-2.0 * F.log(unit(1, i))) * F.cos(2 * math.pi * unit(2, i))
    if n_bands is None:
        return pixels.withColumn("bands", F.transform("bands", noisy))
    return pixels.withColumn("bands", F.array(*[noisy(F.get("bands", F.lit(i)), F.lit(i)) for i in range(n_bands)]))


def jitter_factor(seed: int, what: str, band: Column, low: float = 0.9, high: float = 1.1) -> Column:
    """Factor of a tile and band between ``low`` and ``high``, by hash."""
    h = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:{what}:"), "tile_key", F.lit(":"), band.cast("string"))), 1, 8), 16, 10).cast("double")
    return low + (high - low) * h / float(0xFFFFFFFF)


def _factors(what: str, n_bands: int, seed: int, low: float, high: float) -> Column:
    return F.array(*[jitter_factor(seed, what, F.lit(i), low, high) for i in range(n_bands)])


def brightness(pixels: DataFrame, seed: int = 42, low: float = 0.9, high: float = 1.1) -> DataFrame:
    """Each band of a tile times its factor."""
    return pixels.withColumn("bands", F.transform("bands", lambda x, i: x * jitter_factor(seed, "brightness", i, low, high)))


def contrast(pixels: DataFrame, n_bands: int, seed: int = 42, low: float = 0.9, high: float = 1.1) -> DataFrame:
    """Distance of each band from its mean in the tile times a factor."""
    return brightness_and_contrast(pixels, n_bands, seed, low, high).withColumn("bands", F.col("contrast")).drop("bright", "contrast")


def brightness_and_contrast(pixels: DataFrame, n_bands: int, seed: int = 42, low: float = 0.9, high: float = 1.1) -> DataFrame:
    """Adds ``bright``, the bands of ``brightness``, and ``contrast``, those of ``contrast``.

    Means and factors are made once a tile, and one join by tile brings them to its pixels.
    """
    m = pixels.groupBy("tile_key").agg(*[F.avg(F.get("bands", F.lit(i))).alias(f"__m{i}") for i in range(n_bands)])
    each = [x for i in range(n_bands) for x in (F.get("__b", F.lit(i)).alias(f"__b{i}"), F.get("__k", F.lit(i)).alias(f"__k{i}"))]
    m = m.withColumns({"__b": _factors("brightness", n_bands, seed, low, high), "__k": _factors("contrast", n_bands, seed, low, high)}).select("tile_key", *[f"__m{i}" for i in range(n_bands)], *each)
    x, c = lambda i: F.get("bands", F.lit(i)), F.col
    p = pixels.join(m, "tile_key")
    p = p.withColumns({"bright": F.array(*[x(i) * c(f"__b{i}") for i in range(n_bands)]),
                       "contrast": F.array(*[(x(i) - c(f"__m{i}")) * c(f"__k{i}") + c(f"__m{i}") for i in range(n_bands)])})
    return p.select(*pixels.columns, "bright", "contrast")


def mosaic(layers: DataFrame, value: str, order: str) -> DataFrame:
    """One value per global cell, of the last layer that covers it."""
    return layers.groupBy("gr", "gc").agg(F.max_by(value, order).alias(value))


def bounding_box(pixels: DataFrame, valid: Column) -> DataFrame:
    """Tight window around the valid pixels; the whole tile where none is valid."""
    box = pixels.groupBy("tile_key").agg(*[f(F.when(valid, F.col(a))).alias(f"{n}_{a}") for a in ("r", "c") for n, f in (("lo", F.min), ("hi", F.max))],
                                         *[F.max(a).alias(f"end_{a}") for a in ("r", "c")])
    return box.select("tile_key", *[F.coalesce(f"lo_{a}", F.lit(0)).alias(f"lo_{a}") for a in ("r", "c")], *[F.coalesce(f"hi_{a}", f"end_{a}").alias(f"hi_{a}") for a in ("r", "c")])


def regrid_nearest(source: DataFrame, grid: DataFrame, a: float, b: float, tx: float, ty: float, value: str) -> DataFrame:
    """Value of the nearest source cell: row = a * r + tx, column = b * c + ty, as an equi-join."""
    g = grid.withColumn("sr", F.floor(F.col("r") * a + tx + 0.5).cast("int")).withColumn("sc", F.floor(F.col("c") * b + ty + 0.5).cast("int"))
    return g.join(source.select("tile_key", F.col("r").alias("sr"), F.col("c").alias("sc"), value), ["tile_key", "sr", "sc"], "left").drop("sr", "sc")


def regrid_bilinear(source: DataFrame, grid: DataFrame, a: float, b: float, tx: float, ty: float, value: str) -> DataFrame:
    """Weighted mean of the four surrounding source cells that exist."""
    g = grid.withColumn("y", F.col("r") * a + tx).withColumn("x", F.col("c") * b + ty).withColumn("fy", F.floor("y")).withColumn("fx", F.floor("x"))
    wy, wx = F.col("y") - F.col("fy"), F.col("x") - F.col("fx")
    corner = lambda i, j, w: F.struct((F.col("fy") + i).cast("int").alias("sr"), (F.col("fx") + j).cast("int").alias("sc"), w.alias("w"))
    four = F.explode(F.array(corner(0, 0, (1 - wy) * (1 - wx)), corner(0, 1, (1 - wy) * wx), corner(1, 0, wy * (1 - wx)), corner(1, 1, wy * wx)))
    g = g.withColumn("k", four).select("tile_key", "r", "c", "k.*")
    s = g.join(source.select("tile_key", F.col("r").alias("sr"), F.col("c").alias("sc"), value), ["tile_key", "sr", "sc"])
    return s.where("w > 0").groupBy("tile_key", "r", "c").agg((F.sum(F.col("w") * F.col(value)) / F.sum("w")).alias(value))
