"""Map requests of tiles as column expressions; the fetch itself is the caller's."""

from __future__ import annotations

from urllib.parse import urlencode

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _plain(c: Column) -> Column:
    """A number without an exponent."""
    return F.regexp_replace(F.regexp_replace(c.cast("decimal(32,10)").cast("string"), r"0+$", ""), r"\.$", ".0")


def map_urls(tiles: DataFrame, base: str, layers: str, srid: int = 3857, size: int = 256, form: str = "image/png", version: str = "1.3.0", extra: dict | None = None) -> DataFrame:
    """z, x, y, url of tiles with bounds (xmin, ymin, xmax, ymax)."""
    reference = "CRS" if version >= "1.3" else "SRS"
    fixed = {"SERVICE": "WMS", "VERSION": version, "REQUEST": "GetMap", "LAYERS": layers, "STYLES": "", reference: f"EPSG:{srid}", "WIDTH": size, "HEIGHT": size, "FORMAT": form} | (extra or {})
    sep = "" if base.endswith(("?", "&")) else "&" if "?" in base else "?"
    start = base + sep + urlencode(fixed, safe=":/") + "&BBOX="
    # Axes of geographic references run north first from version 1.3 on.
    sides = ["ymin", "xmin", "ymax", "xmax"] if srid == 4326 and version >= "1.3" else ["xmin", "ymin", "xmax", "ymax"]
    return tiles.select("z", "x", "y", F.concat(F.lit(start), F.concat_ws(",", *[_plain(F.col(c)) for c in sides])).alias("url"))
