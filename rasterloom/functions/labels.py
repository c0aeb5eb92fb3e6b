"""Label columns: raw codes, final classes, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Final class of each raw code, and the names of the final classes.
REMAP = {0: 0, 1: 1, 2: 2, 4: 2, 6: 2, 8: 3, 9: 4, 10: 5, 12: 6, 11: 7, 13: 7, 14: 8, 15: 9, 16: 10, 17: 10, 20: 10, 21: 10, 22: 10, 18: 11, 19: 12}
NAMES = ["No Wetland", "Rice Fields", "Riparian, fluvial and swamp forest", "Managed or grazed meadow", "Wet grasslands", "Wet heaths",
         "Beaches", "Inland marshes", "Open mires", "Salt marshes", "Surface water", "Saltpans", "Intertidal flats"]


def remap(raw: Column, table: dict[int, int] = REMAP, ignore: int = 255) -> Column:
    """Final class of a raw code; codes outside the table become ``ignore``."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), raw), F.lit(ignore)).cast("int")


def nodata_to_ignore(raw: Column, nodata: int = -32768, ignore: int = 255) -> Column:
    return F.when(raw == nodata, ignore).otherwise(raw).cast("int")


def class_name(cls: Column, names: list[str] = NAMES) -> Column:
    """Name of a class; ``Class i`` outside the list."""
    known = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(i), F.lit(n))])
    return F.coalesce(F.element_at(known, cls), F.concat(F.lit("Class "), cls.cast("string")))
