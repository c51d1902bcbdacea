"""Feature collections over any table or SQL query: filters, pages, counts, items, extents.

A collection is a lazy DataFrame with a key, a geometry (x, y columns, or envelope columns beside
a WKB or GeoJSON one) and, where it has them, temporal columns.  Filters become range and
equality tests on plain columns, so they reach the scan; the page and the count are two plans,
because a filter or a limit would not pass a window.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from datetime import datetime, timezone
from urllib.parse import urlencode

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as t

from geoloom.functions.columns import boxes_meet, shifted


class FeatureError(Exception):
    """Base of the errors of this module."""


class InvalidFilter(FeatureError):
    pass


class UnknownQueryable(FeatureError):
    pass


class UnsupportedQueryable(FeatureError):
    pass


class CollectionNotFound(FeatureError):
    pass


class FeatureNotFound(FeatureError):
    pass


DEFAULT_LIMIT = 50
RESERVED = ("limit", "offset", "bbox", "datetime", "f", "crs", "bbox-crs")


def parse_bbox(text: str | None) -> tuple[float, ...] | None:
    """Four numbers of a box from ``a,b,c,d`` or from a box with heights, ``a,b,_,c,d,_``."""
    if text is None or text == "":
        return None
    parts = text.split(",")
    if len(parts) not in (4, 6) or any(not re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", p) for p in parts):
        raise InvalidFilter(f"bbox: {text!r}")
    v = [float(p) for p in parts]
    return tuple(v) if len(v) == 4 else (v[0], v[1], v[3], v[4])


def parse_instant(text: str) -> datetime:
    """An RFC 3339 instant, in UTC."""
    if not re.fullmatch(r"\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)", text):
        raise InvalidFilter(f"datetime: {text!r}")
    try:
        return datetime.fromisoformat(text.upper().replace("Z", "+00:00")).astimezone(timezone.utc)
    except ValueError as e:
        raise InvalidFilter(f"datetime: {text!r}") from e


def parse_temporal(text: str | None) -> tuple[datetime | None, datetime | None, bool] | None:
    """(from, to, is an instant)."""
    if text is None or text == "":
        return None
    parts = text.split("/")
    if len(parts) > 2:
        raise InvalidFilter(f"datetime: {text!r}")
    ends = [None if p == ".." else parse_instant(p) for p in parts]
    if all(e is None for e in ends):
        raise InvalidFilter(f"datetime: {text!r} is open on all sides")
    return (ends[0], ends[0], True) if len(ends) == 1 else (ends[0], ends[1], False)


@dataclass(frozen=True)
class FilterParams:
    limit: int | None = None
    offset: int | None = None
    bbox: str | None = None
    datetime: str | None = None
    filters: dict = field(default_factory=dict)

    @classmethod
    def from_query(cls, query: dict[str, str]) -> FilterParams:
        """From request parameters, whose names are matched without case."""
        low = {k.lower(): v for k, v in query.items()}
        number = lambda k: cls._number(k, low[k]) if low.get(k) not in (None, "") else None
        rest = {k: v for k, v in low.items() if k not in RESERVED}
        return cls(number("limit"), number("offset"), low.get("bbox"), low.get("datetime"), rest)

    @staticmethod
    def _number(key: str, text: str) -> int:
        if not text.isdigit():
            raise InvalidFilter(f"{key}: {text!r}")
        return int(text)

    @property
    def page_size(self) -> int:
        return DEFAULT_LIMIT if self.limit is None else self.limit

    def args(self) -> str:
        """As the query part of a link."""
        named = [("limit", self.limit), ("offset", self.offset), ("bbox", self.bbox), ("datetime", self.datetime), *sorted(self.filters.items())]
        given = [(k, str(v)) for k, v in named if v is not None]
        return "?" + urlencode(given, safe=",:/") if given else ""

    def previous(self) -> FilterParams | None:
        if not self.offset:
            return None
        return replace(self, offset=max(0, self.offset - self.page_size))

    def following(self, matched: int) -> FilterParams | None:
        if self.page_size == 0 or (self.offset or 0) + self.page_size >= matched:
            return None
        return replace(self, offset=(self.offset or 0) + self.page_size)


@dataclass(frozen=True)
class Collection:
    """A named source of features.

    Points have ``x`` and ``y``; other geometries an envelope (xmin, ymin, xmax, ymax) and a
    ``geometry`` column that holds GeoJSON.
    """

    name: str
    frame: DataFrame
    key: str | None = None
    x: str | None = None
    y: str | None = None
    envelope: tuple[str, str, str, str] | None = None
    geometry: str | None = None
    start: str | None = None
    end: str | None = None
    queryable: tuple[str, ...] = ()
    title: str | None = None
    description: str | None = None
    srid: int = 4326
    shift_longitude: bool = False

    @property
    def sides(self) -> tuple[str, str, str, str]:
        if self.envelope:
            return self.envelope
        if self.x and self.y:
            return (self.x, self.y, self.x, self.y)
        raise FeatureError(f"{self.name} has no geometry")

    def column(self, name: str) -> str:
        """A column's own name, found without case."""
        for c in self.frame.columns:
            if c.lower() == name.lower():
                return c
        raise UnknownQueryable(name)

    def hidden(self) -> set[str]:
        own = {self.key, self.x, self.y, self.geometry, *(self.envelope or ())}
        return {c for c in own if c}


_KINDS = {
    t.StringType: "string", t.CharType: "string", t.VarcharType: "string", t.IntegerType: "integer", t.LongType: "integer",
    t.FloatType: "number", t.DoubleType: "number", t.TimestampType: "datetime", t.TimestampNTZType: "datetime", t.BooleanType: "boolean",
}


def queryables(c: Collection) -> dict[str, str]:
    """Type of each queryable column."""
    out = {}
    for name in c.queryable:
        own = c.column(name)
        kind = _KINDS.get(type(c.frame.schema[own].dataType))
        if kind is None:
            raise UnsupportedQueryable(f"{own}: {c.frame.schema[own].dataType.simpleString()}")
        out[own] = kind
    return out


def _instant(c: Collection, name: str, at: datetime) -> Column:
    ntz = isinstance(c.frame.schema[name].dataType, (t.TimestampNTZType, t.StringType))
    return F.lit(at.replace(tzinfo=None)).cast("timestamp_ntz") if ntz else F.lit(at)


def _equals(c: Collection, name: str, kind: str, text: str) -> Column:
    col = F.col(f"`{name}`")
    if "*" in text:
        like = re.sub(r"([\\%_])", r"\\\1", text).replace("*", "%")
        return col.cast("string").like(like)
    try:
        if kind == "integer":
            return col == F.lit(int(text))
        if kind == "number":
            return col == F.lit(float(text))
        if kind == "boolean":
            return col == F.lit({"true": True, "false": False}[text])
    except (ValueError, KeyError) as e:
        raise InvalidFilter(f"{name}: {text!r}") from e
    if kind == "datetime":
        return col == _instant(c, name, parse_instant(text))
    return col == F.lit(text)


def where(c: Collection, p: FilterParams) -> DataFrame:
    """The features that pass all filters."""
    out = c.frame
    box = parse_bbox(p.bbox)
    if box:
        if c.shift_longitude:
            sides = {s: shifted(F.col(s)) for s in set(c.sides)}
            x0, y0, x1, y1 = c.sides
            out = out.where((sides[x0] <= box[2]) & (sides[x1] >= box[0]) & (F.col(y0) <= box[3]) & (F.col(y1) >= box[1]))
        else:
            out = out.where(boxes_meet(*c.sides, box))
    span = parse_temporal(p.datetime)
    if span and c.start:
        begin, finish, instant = span
        start = F.col(c.start)
        if instant:
            out = out.where(start == _instant(c, c.start, begin))
        elif begin and finish:
            # The feature's whole span lies inside.
            end = F.coalesce(F.col(c.end), start) if c.end else start
            out = out.where((start >= _instant(c, c.start, begin)) & (end <= _instant(c, c.start, finish)))
        elif begin:
            out = out.where(start >= _instant(c, c.start, begin))
        else:
            out = out.where(start <= _instant(c, c.start, finish))
    kinds = queryables(c)
    for name, text in sorted(p.filters.items()):
        own = next((k for k in kinds if k.lower() == name.lower()), None)
        if own is None:
            raise UnknownQueryable(name)
        out = out.where(_equals(c, own, kinds[own], text))
    return out


def features(c: Collection, rows: DataFrame) -> DataFrame:
    """id, geometry (GeoJSON), properties (JSON with nulls) of rows of a collection."""
    if c.geometry:
        geometry = F.col(c.geometry).cast("string")
    elif c.x and c.y:
        point = F.struct(F.lit("Point").alias("type"), F.array(F.col(c.x), F.col(c.y)).alias("coordinates"))
        geometry = F.when(F.col(c.x).isNotNull() & F.col(c.y).isNotNull(), F.to_json(point))
    else:
        geometry = F.lit(None).cast("string")
    rest = [F.col(f"`{n}`") for n in rows.columns if n not in c.hidden()]
    properties = F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}) if rest else F.lit("{}")
    key = F.col(f"`{c.key}`").cast("string") if c.key else F.lit(None).cast("string")
    return rows.select(key.alias("id"), geometry.alias("geometry"), properties.alias("properties"))


def page(c: Collection, p: FilterParams) -> DataFrame:
    """The rows of a page, ordered by key so that pages fit together."""
    out = where(c, p)
    if c.key:
        out = out.orderBy(c.key)
    if p.offset:
        out = out.offset(p.offset)
    return out.limit(p.page_size) if p.page_size else out


def matched(c: Collection, p: FilterParams) -> int:
    return where(c, p).count()


def item(c: Collection, key: str) -> DataFrame:
    """The feature of a key given as text."""
    if not c.key:
        raise FeatureError(f"{c.name} has no key")
    kind = c.frame.schema[c.key].dataType
    # Compared in the column's own type, the test reaches the scan.
    typed = F.lit(key).try_cast(kind) if not isinstance(kind, t.StringType) else F.lit(key)
    return features(c, c.frame.where((F.col(c.key) == typed) & (F.col(c.key).cast("string") == key)))


def extent(c: Collection) -> DataFrame:
    """xmin, ymin, xmax, ymax of all features: one row, nulls where there are none."""
    x0, y0, x1, y1 = c.sides
    return c.frame.agg(F.min(x0).alias("xmin"), F.min(y0).alias("ymin"), F.max(x1).alias("xmax"), F.max(y1).alias("ymax"))


#: Names by which a table's columns are taken for coordinates.
COORDINATES = (("x", "y"), ("lon", "lat"), ("longitude", "latitude"), ("lng", "lat"))
SIDES = ("xmin", "ymin", "xmax", "ymax")


def detect(name: str, df: DataFrame) -> Collection:
    """A collection of a table by its columns: the first fitting geometry, and a key called id or fid."""
    low = {c.lower(): c for c in df.columns}
    key = next((low[k] for k in ("fid", "id", f"{name.lower()}_id", "ogc_fid", "gid") if k in low), None)
    shape = next((low[g] for g in ("geometry", "geom", "wkb_geometry", "the_geom") if g in low), None)
    if shape and all(s in low for s in SIDES):
        return Collection(name, df, key, envelope=tuple(low[s] for s in SIDES), geometry=shape)
    for x, y in COORDINATES:
        if x in low and y in low:
            return Collection(name, df, key, low[x], low[y])
    raise FeatureError(f"{name} has no geometry")


def scan_catalog(inventory: Inventory, database: str | None = None) -> None:
    """Add the tables and views of a database that have a geometry; the others are kept as warnings."""
    spark = inventory.spark
    found = {t.name: t for t in spark.catalog.listTables(database)}
    inventory.scan(found, lambda n, t: detect(n, spark.table(n if t.isTemporary or not database else f"{database}.{n}")))


class Inventory:
    """Collections by name; a later one takes a name over."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.warnings: list[str] = []
        self._all: dict[str, Collection] = {}

    def add(self, c: Collection) -> None:
        queryables(c)
        self._all[c.name] = c

    def add_sql(self, name: str, sql: str, args: dict | None = None, **spec) -> Collection:
        """A collection over any Spark SQL; an error in it shows here."""
        c = Collection(name, self.spark.sql(sql, args=args or {}), **spec)
        self.add(c)
        return c

    def scan(self, found: dict, setup) -> None:
        """Add what ``setup(name, source)`` makes of each source; failures are kept as warnings."""
        for name, source in sorted(found.items()):
            try:
                self.add(setup(name, source))
            except Exception as e:
                self.warnings.append(f"{name}: {e}")

    def names(self) -> list[str]:
        return sorted(self._all)

    def get(self, name: str) -> Collection:
        if name not in self._all:
            raise CollectionNotFound(name)
        return self._all[name]

    def items(self, name: str, p: FilterParams) -> DataFrame:
        c = self.get(name)
        return features(c, page(c, p))
