"""Polygon layers from GeoJSON and shapefiles."""

from __future__ import annotations

import logging
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shapefile

log = logging.getLogger(__name__)

_FEATURE = "geometry struct<type:string,coordinates:string>, properties map<string,string>"
_POINTS = "array<array<double>>"


def _rings(shape: str) -> Column:
    """Rings of a Polygon or MultiPolygon, whose coordinates are text; of others null."""
    flat = F.from_json(f"{shape}.coordinates", f"array<{_POINTS}>")
    many = F.flatten(F.from_json(f"{shape}.coordinates", f"array<array<{_POINTS}>>"))
    rings = F.when(F.col(f"{shape}.type") == "Polygon", flat).when(F.col(f"{shape}.type") == "MultiPolygon", many)
    return F.transform(rings, lambda r: F.transform(r, lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"))))


def read_polygons(spark: SparkSession, path: str, quiet: bool = True, bounds: tuple[float, float, float, float] | None = None) -> DataFrame:
    """poly_idx, rings and the attributes of a layer of polygons.

    A .shp is read in ranges of records (see shapefile.py), attributes in their types. A
    .geojsonl or .geojsons has a feature in each line and is split by Spark; poly_idx is then
    unique, not without gaps. Any other file is one GeoJSON collection, which one task takes
    apart; attributes of both are strings. Only the attributes' names come to the driver.
    Bounds (min x, min y, max x, max y) leave out polygons that lie wholly beyond."""
    kind = os.path.splitext(path)[1].lower()
    if kind == ".shp":
        shapefile.register(spark)
        box = {"bounds": ",".join(map(str, bounds))} if bounds else {}
        out = spark.read.format("shapefile").options(**box).load(path).drop(*shapefile.BOX)
    else:
        if kind in (".geojsonl", ".geojsons"):
            rows = spark.read.schema(_FEATURE).json(path)
            rows = rows.select(F.monotonically_increasing_id().alias("poly_idx"), F.struct("geometry", "properties").alias("f"))
        else:
            doc = spark.read.schema(f"crs struct<properties:struct<name:string>>, features array<struct<{_FEATURE}>>").option("multiLine", True).json(path)
            crs = doc.select("crs.properties.name").first()
            if crs is None or (crs[0] is not None and not any(code in crs[0] for code in ("4326", "7844", "CRS84"))):
                raise ValueError(f"{path}: no layer, or an unsupported reference system ({crs and crs[0]})")
            rows = doc.select(F.posexplode("features").alias("poly_idx", "f"))
        names = sorted(r[0] for r in rows.select(F.explode(F.map_keys("f.properties")).alias("k")).distinct().collect() if r[0] not in ("poly_idx", "rings"))
        out = rows.select("poly_idx", _rings("f.geometry").alias("rings"), *[F.col("f.properties")[n].alias(n) for n in names])
        if bounds:
            near = lambda c, low, high: (F.array_max(F.transform(F.flatten("rings"), lambda p: p[c])) >= low) & (F.array_min(F.transform(F.flatten("rings"), lambda p: p[c])) <= high)
            out = out.where(near("x", bounds[0], bounds[2]) & near("y", bounds[1], bounds[3]))
    if not quiet:
        log.info("%s: attributes %s", path, ", ".join(c for c in out.columns if c not in ("poly_idx", "rings")))
    return out
