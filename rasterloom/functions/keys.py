"""Tile keys, zones and run tokens parsed from file names. Each naming rule is a variant of its own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "32[67][0-9]{2}"


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def _null_if_empty(x: Column) -> Column:
    return F.when(x != "", x)


def key_generic(path: Column) -> Column:
    """First ``zone_number``; else a zone between underscores and the digits before ``.tif``."""
    b = base_name(path)
    direct = _null_if_empty(F.regexp_extract(b, f"({ZONE}_[0-9]+)", 1))
    zone = _null_if_empty(F.regexp_extract(b, f"_({ZONE})_", 1))
    tile = _null_if_empty(F.regexp_extract(b, "(?i)([0-9]+)\\.tif$", 1))
    return F.coalesce(direct, F.concat(zone, F.lit("_"), tile))


def key_last_zone(path: Column) -> Column:
    """Last number that is a zone, and the last number after an underscore; if that is the
    zone itself, the number before; null if both are the same even then."""
    stem = F.regexp_replace(base_name(path), "(?<=.)\\.[^.]*$", "")
    nums = F.regexp_extract_all(stem, F.lit("([0-9]+)"), 1)
    tails = F.regexp_extract_all(stem, F.lit("_([0-9]+)"), 1)
    zone = F.try_element_at(F.filter(nums, lambda x: x.rlike(f"^{ZONE}$")), F.lit(-1))
    tile = F.coalesce(F.try_element_at(tails, F.lit(-1)), F.try_element_at(nums, F.lit(-1)))
    tile = F.when((tile == zone) & (F.size(nums) >= 2), F.try_element_at(nums, F.lit(-2))).otherwise(tile)
    return F.when(tile != zone, F.concat(zone, F.lit("_"), tile))


def key_north_only(path: Column) -> Column:
    """Northern zone between underscores and the digits before ``.tif``."""
    b = base_name(path)
    return F.concat(_null_if_empty(F.regexp_extract(b, "_(326[0-9]{2})_", 1)), F.lit("_"), _null_if_empty(F.regexp_extract(b, "([0-9]+)\\.tif$", 1)))


def strict_parts(path: Column) -> tuple[Column, Column]:
    """Key and band group of names in the full pattern of band-group files."""
    pattern = "^google_embed_Europe_2018_10m_([0-9]+)_bands_(00|01_22|23_44|45_63)_([0-9]+)\\.(?:tif|tiff)$"
    b = base_name(path)
    key = F.concat(F.regexp_extract(b, pattern, 1), F.lit("_"), F.regexp_extract(b, pattern, 3))
    return F.when(key != "_", key), _null_if_empty(F.regexp_extract(b, pattern, 2))


def zone_of_key(key: Column) -> Column:
    return F.when(F.instr(key, "_") > 0, F.substring_index(key, "_", 1)).otherwise("unknown")


def zone_from_path(path: Column) -> Column:
    """First 326dd anywhere in the path, run stamps included."""
    return _null_if_empty(F.regexp_extract(path, "(326[0-9]{2})", 1))


def run_token(path: Column) -> Column:
    return _null_if_empty(F.regexp_extract(path, "([0-9]{8}_[0-9]{6})", 1))


def key_of_record(tile_id: Column, tile_key: Column, *paths: Column) -> Column:
    """Explicit fields first, then the first path that holds a key."""
    return F.coalesce(_null_if_empty(tile_id), _null_if_empty(tile_key), *map(key_generic, paths))
