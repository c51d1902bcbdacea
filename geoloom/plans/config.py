"""Configuration: TOML files, environment overrides, sources, tilesets; legacy files."""

from __future__ import annotations

import os
import re
import tomllib
from dataclasses import dataclass, field, fields

from geoloom.operators.layers import Layer, TileQuery

PREFIX = "GEOLOOM_"


class ConfigError(ValueError):
    pass


def layered(text: str, env: dict[str, str] | None = None, prefix: str = PREFIX) -> dict:
    """A TOML text under the environment: ``PREFIX_A__B`` sets b of a; values are read as TOML where they can be."""
    out = tomllib.loads(text)
    for k, v in sorted((env if env is not None else os.environ).items()):
        if not k.startswith(prefix):
            continue
        path = k[len(prefix) :].lower().split("__")
        at = out
        for p in path[:-1]:
            at = at.setdefault(p, {})
        try:
            at[path[-1]] = tomllib.loads(f"v = {v}")["v"]
        except tomllib.TOMLDecodeError:
            at[path[-1]] = v
    return out


def strict(cls, values: dict):
    """A dataclass of the values; unknown keys are errors."""
    known = {f.name for f in fields(cls)}
    if extra := set(values) - known:
        raise ConfigError(f"{cls.__name__}: unknown {', '.join(sorted(extra))}")
    return cls(**values)


#: Keys of each part of a configuration; others are errors.
KEYS = {
    "": {"datasource", "tileset", "store", "grid", "collections", "routing", "metrics"},
    "tileset": {"name", "layer", "grid", "minzoom", "maxzoom", "store", "attribution", "source", "cache", "ages", "diagnostics", "bounds"},
    "datasource": {"name", "jdbc", "gpkg", "mbtiles", "pmtiles", "parquet", "wms"},
    "store": {"path"},
    "source": {"path", "wms", "layers", "format", "version", "size"},
}


def checked(c: dict) -> dict:
    """The configuration, if all its keys are known."""

    def part(name: str, where: str, values: dict) -> None:
        if extra := set(values) - KEYS[name]:
            raise ConfigError(f"{where or 'configuration'}: unknown {', '.join(sorted(extra))}")

    part("", "", c)
    for d in c.get("datasource", []):
        part("datasource", f"datasource {d.get('name')}", d)
    for t in c.get("tileset", []):
        part("tileset", f"tileset {t.get('name')}", t)
        for l in t.get("layer", []):
            layer(l)
        for name in ("store", "source"):
            if name in t:
                part(name, f"{name} of tileset {t.get('name')}", t[name])
    if "store" in c:
        part("store", "store", c["store"])
    return c


@dataclass
class Datasources:
    """Named sources: the first is the default, a later one of a name replaces it."""

    all: dict = field(default_factory=dict)

    def add(self, name: str, source) -> None:
        self.all[name] = source

    def get(self, name: str | None = None):
        if name is None:
            return next(iter(self.all.values()), None)
        return self.all.get(name)

    @classmethod
    def of(cls, config: list[dict], env: dict[str, str] | None = None) -> Datasources:
        """From ``[[datasource]]`` tables; ``GEOLOOM_DATASOURCE_<NAME>`` overrides a url or path."""
        env = env if env is not None else dict(os.environ)
        out = cls()
        for c in config:
            kind = next((k for k in ("jdbc", "gpkg", "mbtiles", "pmtiles", "parquet", "wms") if k in c), None)
            if kind is None:
                raise ConfigError(f"datasource {c.get('name')}: no kind")
            name = c.get("name", "default")
            spec = dict(c[kind])
            if over := env.get(f"{PREFIX}DATASOURCE_{name.upper()}"):
                spec["url" if kind in ("jdbc", "wms") else "path"] = over
            out.add(name, (kind, spec))
        return out


def load(spark, source: tuple[str, dict], table: str | None = None, sql: str | None = None):
    """A frame of a configured source's table or query."""
    kind, spec = source
    if kind == "parquet":
        if sql:
            for t in os.listdir(spec["path"]) if os.path.isdir(spec["path"]) else ():
                if t.endswith(".parquet"):
                    spark.read.parquet(f"{spec['path']}/{t}").createOrReplaceTempView(t.removesuffix(".parquet"))
            return spark.sql(sql)
        return spark.read.parquet(f"{spec['path']}/{table}.parquet")
    if kind == "jdbc":
        return read_jdbc(spark, spec, table, sql)
    if kind == "gpkg":
        from geoloom.sources import gpkg

        return gpkg.read(spark, spec["path"], table, sql)
    if kind in ("mbtiles", "pmtiles"):
        from geoloom.sources import archives

        archives.register(spark)
        return spark.read.format(kind).load(spec["path"])
    raise ConfigError(f"{kind} has no tables")


def read_jdbc(spark, spec: dict, table: str | None = None, sql: str | None = None):
    """A table or query in as many parts as there are connections, if the source names a numeric ``partition`` column; its bounds are asked for once."""
    given = {k: str(spec[k]) for k in ("url", "driver", "user", "password", "fetchsize") if k in spec}
    of = f"({sql}) q" if sql else table
    read = lambda **more: spark.read.format("jdbc").options(**given, **more).load()
    column = spec.get("partition")
    if not column:
        return read(dbtable=of)
    low, high = read(query=f"SELECT min({column}) AS lo, max({column}) AS hi FROM {of}").first()
    if low is None:
        return read(dbtable=of)
    return read(dbtable=of, partitionColumn=column, lowerBound=str(int(low)), upperBound=str(int(high) + 1), numPartitions=str(spec.get("connections", 8)))


def jdbc_key(spark, spec: dict, table: str) -> str | None:
    """The key column of a database table, if the key is a single column; asked of the driver's catalogue."""
    jvm = spark._jvm
    given = jvm.java.util.Properties()
    for k in ("user", "password"):
        if k in spec:
            given.setProperty(k, spec[k])
    if "driver" in spec:
        jvm.java.lang.Class.forName(spec["driver"])
    db = jvm.java.sql.DriverManager.getConnection(spec["url"], given)
    try:
        schema, _, name = table.rpartition(".")
        rows = db.getMetaData().getPrimaryKeys(None, schema or None, name)
        found = []
        while rows.next():
            found.append(rows.getString("COLUMN_NAME"))
        return found[0] if len(found) == 1 else None
    finally:
        db.close()


def layer(values: dict) -> Layer:
    """A layer of its ``[[tileset.layer]]`` table."""
    v = dict(values)
    v["queries"] = tuple(strict(TileQuery, q) for q in v.pop("query", []))
    return strict(Layer, v)


def legacy(text: str) -> dict:
    """A configuration in the older layout of vector tile servers (datasource, grid, tileset, cache) in this one's."""
    old = tomllib.loads(text)
    out: dict = {"datasource": [], "tileset": []}
    for d in old.get("datasource", []):
        if "dbconn" in d:
            out["datasource"].append({"name": d.get("name", "default"), "jdbc": {"url": d["dbconn"]}})
        elif "path" in d:
            out["datasource"].append({"name": d.get("name", "default"), "gpkg": {"path": d["path"]}})
    grid = old.get("grid", {}).get("predefined", "web_mercator")
    for t in old.get("tileset", []):
        layers = []
        for l in t.get("layer", []):
            l = dict(l)
            queries = [{k: q[k] for k in ("minzoom", "maxzoom", "sql", "simplify", "tolerance") if k in q} for q in l.get("query", [])]
            # A table may be a query in brackets, perhaps with a name behind; it becomes the first query.
            if m := re.fullmatch(r"\((SELECT .*)\)[^)]*", l.get("table_name", ""), re.S):
                first = {"minzoom": l.get("minzoom", 0), "sql": m[1]} | {k: l[k] for k in ("simplify", "tolerance") if k in l}
                queries.insert(0, first)
                del l["table_name"]
            new = {"name": l["name"], "query": queries}
            for a, b in (("table_name", "table"), ("geometry_field", "geometry"), ("geometry_type", "geometry_type"), ("srid", "srid"), ("fid_field", "fid"), ("minzoom", "minzoom"), ("maxzoom", "maxzoom"), ("tile_size", "tile_size"), ("buffer_size", "buffer"), ("simplify", "simplify"), ("tolerance", "tolerance"), ("make_valid", "make_valid"), ("query_limit", "limit")):
                if a in l:
                    new[b] = l[a]
            layers.append(new)
        out["tileset"].append({"name": t["name"], "grid": {"web_mercator": "WebMercatorQuad", "wgs84": "WorldCRS84Quad"}.get(grid, grid), "layer": layers} | ({"attribution": t["attribution"]} if "attribution" in t else {}))
    if base := old.get("cache", {}).get("file", {}).get("base"):
        out["store"] = {"path": base}
    return out
