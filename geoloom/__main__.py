"""``python -m geoloom seed CONFIG TILESET``: seed a configured tileset."""

from __future__ import annotations

import argparse
import os

from pyspark.sql import SparkSession

from geoloom.operators.grids import Grids, from_json
from geoloom.operators.tileset import ArchiveOrigin, Tileset
from geoloom.plans import config
from geoloom.sources.stores import Store


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="geoloom")
    sub = p.add_subparsers(dest="command", required=True)
    s = sub.add_parser("seed")
    s.add_argument("config")
    s.add_argument("tileset")
    s.add_argument("--minzoom", type=int)
    s.add_argument("--maxzoom", type=int)
    s.add_argument("--extent", help="xmin,ymin,xmax,ymax in the grid's units")
    s.add_argument("--path", help="folder, archive or object store; overrides the configured one")
    s.add_argument("--no-store", action="store_true")
    s.add_argument("--overwrite", action="store_true")
    u = sub.add_parser("upload")
    u.add_argument("folder")
    u.add_argument("url")
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("geoloom").getOrCreate()
    if a.command == "upload":
        from geoloom.sources.stores import read_files, write_objects

        write_objects(read_files(spark, a.folder), a.url)
        return 0
    with open(a.config) as f:
        c = config.checked(config.layered(f.read()))
    for source in config.Datasources.of(c.get("datasource", [])).all.values():
        for table in source[1].get("tables", []):
            config.load(spark, source, table).createOrReplaceTempView(table)
    t = next(t for t in c["tileset"] if t["name"] == a.tileset)
    path = None if a.no_store else a.path or t.get("store", {}).get("path") or c.get("store", {}).get("path")
    known = Grids()
    for g in c.get("grid", []):
        known.add(from_json(g["json"]))
    tileset = Tileset(t["name"], [config.layer(l) for l in t.get("layer", [])], known.get(t.get("grid", "WebMercatorQuad")), store=Store.of(path))
    if "path" in t.get("source", {}):
        tileset.origin = ArchiveOrigin(Store.of(t["source"]["path"]))
    extent = tuple(map(float, a.extent.split(","))) if a.extent else None
    tileset.seed(spark, a.minzoom or 0, a.maxzoom if a.maxzoom is not None else 6, extent, a.overwrite or not path or not os.path.exists(path))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
