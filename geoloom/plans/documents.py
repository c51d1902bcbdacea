"""JSON documents of the interface: pure functions over small metadata."""

from __future__ import annotations

import json
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.operators import features as feat
from geoloom.operators.features import Collection, FilterParams, Inventory
from geoloom.operators.grids import Grid, to_json
from geoloom.operators.layers import Layer

#: Media types and identifiers of the OGC interfaces.
GEOJSON, JSON, SCHEMA = "application/geo+json", "application/json", "application/schema+json"
CRS84 = "http://www.opengis.net/def/crs/OGC/1.3/CRS84"
MATRIX_SETS = "http://www.opengis.net/def/tilematrixset/OGC/1.0"
WORLD = (-180.0, -85.0511, 180.0, 85.0511)


def link(href: str, rel: str, media: str = JSON, title: str | None = None) -> dict:
    return {"href": href, "rel": rel, "type": media} | ({"title": title} if title else {})


def collection(c: Collection, base: str, extent: tuple | None = None) -> dict:
    out = {"id": c.name, "title": c.title or c.name, "itemType": "feature", "links": [link(f"{base}/collections/{c.name}/items", "items", GEOJSON, c.title or c.name), link(f"{base}/collections/{c.name}/queryables", "queryables", SCHEMA)]}
    if c.description:
        out["description"] = c.description
    if extent and None not in extent:
        out["extent"] = {"spatial": {"bbox": [list(extent)], "crs": CRS84}}
    return out


def collections(inventory: Inventory, base: str) -> dict:
    return {"links": [link(f"{base}/collections", "self")], "collections": [collection(inventory.get(n), base) for n in inventory.names()]}


def queryables(c: Collection, base: str) -> dict:
    kinds = {"datetime": {"type": "string", "format": "date-time"}}
    return {
        "$schema": "https://json-schema.org/draft/2019-09/schema",
        "$id": f"{base}/collections/{c.name}/queryables",
        "type": "object",
        "title": c.title or c.name,
        "properties": {k: {"title": k} | kinds.get(v, {"type": v}) for k, v in feat.queryables(c).items()},
    }


def _features(rows: DataFrame) -> list[dict]:
    out = []
    for r in rows.collect():
        f = {"type": "Feature", "geometry": json.loads(r.geometry) if r.geometry else None, "properties": json.loads(r.properties)}
        out.append(f | ({"id": r.id} if r.id is not None else {}))
    return out


def items(inventory: Inventory, name: str, p: FilterParams, base: str, now: datetime | None = None) -> dict:
    """A page with its links; the rows of one page come to the driver."""
    c = inventory.get(name)
    matched = feat.matched(c, p)
    found = _features(feat.features(c, feat.page(c, p)))
    here = f"{base}/collections/{name}/items"
    links = [link(here + p.args(), "self", GEOJSON), link(f"{base}/collections/{name}", "collection")]
    if matched > len(found):
        for rel, q in (("prev", p.previous()), ("next", p.following(matched))):
            if q:
                links.append(link(here + q.args(), rel, GEOJSON))
    at = (now or datetime.now(timezone.utc)).strftime("%Y-%m-%dT%H:%M:%SZ")
    return {"type": "FeatureCollection", "links": links, "timeStamp": at, "numberMatched": matched, "numberReturned": len(found), "features": found}


def item(inventory: Inventory, name: str, key: str, base: str) -> dict:
    found = _features(feat.item(inventory.get(name), key))
    if not found:
        raise feat.FeatureNotFound(f"{name}/{key}")
    return found[0] | {"links": [link(f"{base}/collections/{name}/items/{key}", "self", GEOJSON), link(f"{base}/collections/{name}", "collection")]}


def feature_lines(c: Collection, rows: DataFrame) -> DataFrame:
    """value: each feature as GeoJSON."""
    f = feat.features(c, rows)
    text = F.concat(
        F.lit('{"type":"Feature",'),
        F.when(F.col("id").isNotNull(), F.concat(F.substring(F.to_json(F.struct("id")), F.lit(2), F.length(F.to_json(F.struct("id"))) - 2), F.lit(","))).otherwise(F.lit("")),
        F.lit('"geometry":'),
        F.coalesce("geometry", F.lit("null")),
        F.lit(',"properties":'),
        F.col("properties"),
        F.lit("}"),
    )
    return f.select(text.alias("value"))


def write_geojson(c: Collection, rows: DataFrame, path: str, collections: bool = False) -> None:
    """Newline-delimited features, any number of them; or each file a FeatureCollection of its own."""
    lines = feature_lines(c, rows)
    if collections:

        def framed(batches):
            begun = False
            for b in batches:
                values = b.column(0).to_pylist()
                if values:
                    lead = "," if begun else '{"type":"FeatureCollection","features":['
                    yield pa.RecordBatch.from_arrays([pa.array([lead + values[0], *["," + v for v in values[1:]]], pa.string())], ["value"])
                    begun = True
            yield pa.RecordBatch.from_arrays([pa.array(["]}" if begun else '{"type":"FeatureCollection","features":[]}'], pa.string())], ["value"])

        lines = lines.mapInArrow(framed, "value string")
    lines.write.mode("overwrite").text(path)


def center(bounds, z: int) -> list:
    return [(bounds[0] + bounds[2]) / 2, (bounds[1] + bounds[3]) / 2, z]


def tilejson(name: str, layers: list[Layer], fields: dict[str, dict], url: str, minzoom: int, maxzoom: int, bounds=WORLD, form: str = "pbf", attribution: str = "") -> dict:
    out = {"tilejson": "3.0.0", "name": name, "tiles": [f"{url}/{name}/{{z}}/{{x}}/{{y}}.{form}"], "scheme": "xyz", "minzoom": minzoom, "maxzoom": maxzoom, "bounds": list(bounds), "center": center(bounds, minzoom), "attribution": attribution, "format": form}
    if layers:
        lows = lambda l: min([q.minzoom for q in l.queries], default=0) if l.minzoom is None else l.minzoom
        out["vector_layers"] = [{"id": l.name, "fields": {k: v for k, v in fields.get(l.name, {}).items() if k != l.fid}, "minzoom": lows(l), "maxzoom": l.maxzoom if l.maxzoom is not None else maxzoom} for l in layers]
    return out


def style(name: str, layers: list[Layer], url: str) -> dict:
    """A plain style: a background and a layer of the fitting kind for each source layer."""

    def kind(l: Layer) -> tuple[str, dict]:
        g = l.geometry_type.upper()
        if "POINT" in g:
            return "circle", {"circle-radius": 3, "circle-color": "#4a6fa5"}
        if "LINE" in g or g == "COMPOUNDCURVE":
            return "line", {"line-color": "#4a6fa5", "line-width": 1}
        return "fill", {"fill-color": "#a5c1de", "fill-outline-color": "#4a6fa5"}

    background = {"id": "background", "type": "background", "paint": {"background-color": "#ffffff"}}
    return {"version": 8, "name": name, "sources": {name: {"type": "vector", "url": f"{url}/{name}.json"}}, "layers": [background, *[{"id": l.name, "type": k, "source": name, "source-layer": l.name, "paint": p} for l in layers for k, p in [kind(l)]]]}


def tilesets(names: list[str], base: str, form: str = "vector") -> dict:
    return {"tilesets": [{"title": n, "dataType": form, "links": [link(f"{base}/tiles/{n}", "self")]} for n in names]}


def tileset(name: str, g: Grid, base: str, minzoom: int, maxzoom: int, form: str = "vector") -> dict:
    limits = [{"tileMatrix": str(v.z), "minTileRow": 0, "maxTileRow": v.rows - 1, "minTileCol": 0, "maxTileCol": v.columns - 1} for v in g.levels if minzoom <= v.z <= maxzoom]
    links = [link(f"{base}/tiles/{name}", "self"), {"href": f"{base}/map/tiles/{g.name}/{{tileMatrix}}/{{tileRow}}/{{tileCol}}", "rel": "item", "templated": True}]
    return {"title": name, "dataType": form, "crs": to_json(g)["crs"], "tileMatrixSetURI": f"{MATRIX_SETS}/{g.name}", "tileMatrixSetLimits": limits, "links": links}


def grid_list(grids, base: str) -> dict:
    return {"tileMatrixSets": [{"id": n, "title": grids.get(n).title, "links": [link(f"{base}/tileMatrixSets/{n}", "self")]} for n in grids.names()]}


def processes(registry: dict[str, str], base: str) -> dict:
    return {"processes": [{"id": k, "title": v, "version": "1.0.0", "jobControlOptions": ["async-execute", "sync-execute"], "links": [link(f"{base}/processes/{k}", "self")]} for k, v in sorted(registry.items())]}


def landing(title: str, base: str, parts: list[str]) -> dict:
    return {"title": title, "links": [link(base + "/", "self"), *[link(f"{base}/{p}", p) for p in parts]]}


def conformance(classes: list[str]) -> dict:
    return {"conformsTo": sorted(set(classes))}


def merged_openapi(a: dict, b: dict) -> dict:
    """Union of paths and of each kind of component; b wins."""
    out = dict(a)
    out["paths"] = a.get("paths", {}) | b.get("paths", {})
    parts = {}
    for kind in [*a.get("components", {}), *b.get("components", {})]:
        parts[kind] = a.get("components", {}).get(kind, {}) | b.get("components", {}).get(kind, {})
    if parts:
        out["components"] = parts
    return out
