"""Points in polygons, and densities of points, as column expressions.

A polygon is poly_idx, rings (array of arrays of x, y; holes are rings) and its
attributes. Points meet polygons on cells of grids, an equi-join: a polygon has cells of
its own size, a power of two, so that it has few whatever its extent. In cells that no
edge comes near, all points are inside or none; in the others the bounding box and an
even-odd test over the rings' edges decide. The edge counts as inside.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import projection

RINGS = "array<array<struct<x:double,y:double>>>"
#: Corners of a layer that a task of simplify_layer() takes apart, about.
CORNERS = 250_000
#: A polygon's box is at most so many cells wide and high, and one more where it lies across.
CELLS, FINEST = 8, -40


def _ends(rings: Column) -> Column:
    """All edges of all rings as x1, y1, x2, y2; rings close themselves."""
    def edges(r: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(r) - 1), lambda i: F.struct(F.get(r, i)["x"].alias("x1"), F.get(r, i)["y"].alias("y1"), F.get(r, (i + 1) % F.size(r))["x"].alias("x2"), F.get(r, (i + 1) % F.size(r))["y"].alias("y2")))

    return F.flatten(F.transform(F.filter(rings, lambda r: F.size(r) > 0), edges))


def inside(rings: Column, x: Column, y: Column) -> Column:
    edges = _ends(rings)
    cross = lambda e: (e["x2"] - e["x1"]) * (y - e["y1"]) - (e["y2"] - e["y1"]) * (x - e["x1"])
    on = F.exists(edges, lambda e: (cross(e) == 0) & x.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"])) & y.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"])))
    # An edge is passed if it spans y and the point lies left of it.
    passed = F.filter(edges, lambda e: ((e["y1"] > y) != (e["y2"] > y)) & ((cross(e) > 0) == (e["y2"] > e["y1"])))
    return on | (F.size(passed) % 2 == 1)


def with_boxes(polygons: DataFrame) -> DataFrame:
    xs, ys = F.transform(F.flatten("rings"), lambda p: p["x"]), F.transform(F.flatten("rings"), lambda p: p["y"])
    return polygons.withColumns({"min_x": F.array_min(xs), "max_x": F.array_max(xs), "min_y": F.array_min(ys), "max_y": F.array_max(ys)})


def cover(polygons: DataFrame) -> DataFrame:
    """Cells of the polygons' boxes: level (a cell's side is 2 ** level), cx, cy, and whether the whole cell is inside;
    such a cell has no rings. Cells wholly outside are left out. Polygons have their boxes."""
    side = F.greatest(F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y"))
    level = F.greatest(F.coalesce(F.ceil(F.log2(F.when(side > 0, side) / CELLS)), F.lit(FINEST)), F.lit(FINEST)).cast("int")
    out = polygons.where("min_x is not null").withColumn("level", level).withColumn("_side", F.pow(F.lit(2.0), F.col("level")))
    at = lambda c: F.floor(F.col(c) / F.col("_side"))
    out = out.withColumn("cx", F.explode(F.sequence(at("min_x"), at("max_x")))).withColumn("cy", F.explode(F.sequence(at("min_y"), at("max_y"))))
    side, x, y = F.col("_side"), F.col("cx") * F.col("_side"), F.col("cy") * F.col("_side")
    near = F.exists(_ends(F.col("rings")), lambda e: (F.least(e["x1"], e["x2"]) <= x + side) & (F.greatest(e["x1"], e["x2"]) >= x) & (F.least(e["y1"], e["y2"]) <= y + side) & (F.greatest(e["y1"], e["y2"]) >= y))
    out = out.withColumn("_near", near).withColumn("whole", ~F.col("_near") & inside(F.col("rings"), x + side / 2, y + side / 2))
    return out.where("_near or whole").withColumn("rings", F.when(~F.col("whole"), F.col("rings"))).drop("_near", "_side")


def spatial_lookup(points: DataFrame, polygons: DataFrame, lat: str = "latitude", lon: str = "longitude", return_cols: list[str] | None = None, multiple: str = "first", crs: int = 4326) -> DataFrame:
    """Each point with the attributes of the first polygon that holds it (multiple="first")
    or a row for each ("all"); nulls where none does or a coordinate is null. Points are in
    EPSG:4326, polygons in ``crs`` (see projection.py). The caller releases the points that are persisted: the result's ``held``."""
    projection.zone_of(crs)
    if multiple not in ("first", "all"):
        raise ValueError("multiple must be 'first' or 'all'")
    attrs = return_cols if return_cols is not None else [c for c in polygons.columns if c not in ("poly_idx", "rings")]
    if missing := [c for c in [lat, lon] if c not in points.columns] + [c for c in attrs if c not in polygons.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    cells = cover(with_boxes(polygons.select("poly_idx", "rings", *[F.col(c).alias(f"_attr_{c}") for c in attrs])))
    levels = sorted(r["level"] for r in cells.select("level").distinct().collect())  # one for each power of two of extent
    numbered = points.withColumn("_point", F.monotonically_increasing_id()).persist()
    x, y = F.col("_x"), F.col("_y")
    there = numbered.where(F.col(lat).isNotNull() & F.col(lon).isNotNull())
    there = there.select("_point", *[c.alias(n) for n, c in zip(("_x", "_y"), projection.to_layer(F.col(lon).cast("double"), F.col(lat).cast("double"), crs), strict=True)])
    there = there.select("*", F.explode(F.array(*[F.lit(v) for v in levels]).cast("array<int>")).alias("level"))
    there = there.withColumns({c: F.floor(v / F.pow(F.lit(2.0), F.col("level"))) for c, v in (("cx", x), ("cy", y))})
    hits = there.join(cells, ["level", "cx", "cy"])
    hits = hits.where(F.col("whole") | (x.between(F.col("min_x"), F.col("max_x")) & y.between(F.col("min_y"), F.col("max_y")) & F.coalesce(inside(F.col("rings"), x, y), F.lit(False))))
    hits = hits.select("_point", "poly_idx", *[f"_attr_{c}" for c in attrs])
    if multiple == "first":
        hits = hits.groupBy("_point").agg(F.min_by(F.struct("poly_idx", *[f"_attr_{c}" for c in attrs]), "poly_idx").alias("_hit")).select("_point", "_hit.*")
    out = numbered.join(hits, "_point", "left").select(*points.columns, *[F.col(f"_attr_{c}").alias(c) for c in attrs])
    out.held = [numbered]
    return out


def subset(polygons: DataFrame, column: str, values: list, invert: bool = False) -> DataFrame:
    """Polygons whose attribute is one of the values, or is not; null is none of them."""
    if column not in polygons.columns:
        raise ValueError(f"no column {column}")
    among = F.coalesce(F.col(column).isin([v for v in values if v is not None]), F.lit(None in values)) if values else F.lit(False)
    return polygons.where(~among if invert else among)


def density_grid(points: DataFrame, bins: int, lat: str = "latitude", lon: str = "longitude", bounds: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Count of points in each cell of a bins x bins grid: gx, gy, n. Bounds are min x,
    min y, max x, max y; points beyond them and without a coordinate are left out."""
    rows = points.where(F.col(lat).isNotNull() & F.col(lon).isNotNull())
    if bounds is None:
        bounds = tuple(rows.agg(F.min(lon), F.min(lat), F.max(lon), F.max(lat)).first())
        if bounds[0] is None:
            bounds = (0.0, 0.0, 1.0, 1.0)
    x0, y0, x1, y1 = bounds
    index = lambda c, low, high: F.least(F.floor((F.col(c) - low) / (((high - low) or 1.0) / bins)), F.lit(bins - 1))
    rows = rows.where(F.col(lon).between(x0, x1) & F.col(lat).between(y0, y1))
    return rows.groupBy(index(lon, x0, x1).alias("gx"), index(lat, y0, y1).alias("gy")).agg(F.count("*").alias("n"))


def kernel_density(points: DataFrame, bins: int, bounds: tuple[float, float, float, float], bandwidth: tuple[float, float], lat: str = "latitude", lon: str = "longitude", reach: float = 4.0) -> DataFrame:
    """Density at the centres of a bins x bins grid's cells: gx, gy, density (per unit of area).

    Counts of cells, which stand for their points, are spread by a Gaussian kernel of the
    given bandwidths (x, y), first along x and then along y, as far as ``reach`` bandwidths:
    a cell is a row for each cell that it reaches in its line. Only cells that are reached
    have a row. See normal_reference() for bandwidths."""
    x0, y0, x1, y1 = bounds
    grid = density_grid(points, bins, lat, lon, bounds).withColumn("v", F.col("n").cast("double"))
    for c, width, h in (("gx", (x1 - x0) / bins, bandwidth[0]), ("gy", (y1 - y0) / bins, bandwidth[1])):
        steps, other = int(reach * h / width), "gy" if c == "gx" else "gx"
        spread = grid.select(other, "v", F.col(c).alias("_from"), F.explode(F.sequence(F.greatest(F.col(c) - steps, F.lit(0)), F.least(F.col(c) + steps, F.lit(bins - 1)))).alias(c))
        z = (F.col(c) - F.col("_from")) * (width / h)
        grid = spread.groupBy("gx", "gy").agg(F.sum(F.col("v") * F.exp(-0.5 * z * z)).alias("v"))
    total = density_grid(points, bins, lat, lon, bounds).agg(F.sum("n")).first()[0] or 1
    return grid.select("gx", "gy", (F.col("v") / (2 * math.pi * bandwidth[0] * bandwidth[1] * total)).alias("density"))


def normal_reference(points: DataFrame, lat: str = "latitude", lon: str = "longitude") -> tuple[float, float]:
    """Bandwidths by the normal reference rule: 1.06 times the smaller of the standard deviation and the quartiles'
    distance over 1.34, times n ** -1/5."""
    out = []
    for c in (lon, lat):
        r = points.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).agg(F.count("*").alias("n"), F.stddev(c).alias("s"), F.percentile_approx(c, [0.25, 0.75], 10_000).alias("q")).first()
        spread = [v for v in (r["s"], (r["q"][1] - r["q"][0]) / 1.34 if r["q"] else None) if v]
        out.append(1.06 * min(spread) * r["n"] ** -0.2 if spread else 1.0)
    return tuple(out)


def simplified(points: list[tuple[float, float]], tolerance: float) -> list[tuple[float, float]]:
    """Douglas-Peucker: the vertices further than the tolerance from the line they would leave."""
    keep, spans = {0, len(points) - 1}, [(0, len(points) - 1)]
    while spans:
        i, j = spans.pop()
        (x1, y1), (x2, y2) = points[i], points[j]
        length = ((x2 - x1) ** 2 + (y2 - y1) ** 2) ** 0.5
        far, at = 0.0, None
        for k in range(i + 1, j):
            x, y = points[k]
            d = abs((x2 - x1) * (y1 - y) - (x1 - x) * (y2 - y1)) / length if length else ((x - x1) ** 2 + (y - y1) ** 2) ** 0.5
            if d > far:
                far, at = d, k
        if at is not None and far > tolerance:
            keep.add(at)
            spans += [(i, at), (at, j)]
    return [points[k] for k in sorted(keep)]


def thinned(points: list[tuple[float, float]], junctions: list[int], tolerance: float) -> list[tuple[float, float]] | None:
    """A ring whose chains between junctions are simplified; a ring without a junction is cut
    at its least corner. A chain is looked at in the lesser of its two directions, so that all
    rings that have it get the same. None if fewer than three corners are left."""
    n = len(points)
    if n < 3:
        return points
    cuts, out = sorted(junctions) or [points.index(min(points))], []
    for a, b in zip(cuts, [*cuts[1:], cuts[0] + n], strict=True):
        chain = [points[k % n] for k in range(a, b + 1)]
        turned = chain[::-1] < chain
        done = simplified(chain[::-1] if turned else chain, tolerance)
        out += (done[::-1] if turned else done)[:-1]
    return out if len(out) >= 3 else None


def simplify_layer(polygons: DataFrame, tolerance: float) -> DataFrame:
    """The layer with fewer corners, where neighbours keep a common border.

    Corners at which more than two different neighbours meet, over all rings of all polygons,
    stay: there borders part. What lies between two of them is the same in every ring that
    has it, and is simplified alike. Rings that shrink to fewer than three corners go, and a
    polygon may be left without rings. poly_idx is unique; rings of fewer than three corners
    and polygons with null rings stay as they are. Corners and rings are counted first, and
    dealt by polygon over as many tasks as keep to CORNERS each; then they are shuffled by
    point and by polygon. A ring is the work of one task."""
    if tolerance < 0:
        raise ValueError("tolerance must not be negative")
    corners_of = F.aggregate("rings", F.lit(0).cast("long"), lambda n, ring: n + F.coalesce(F.size(ring), F.lit(0)))
    count = polygons.agg(F.sum(corners_of)).first()[0] or 0
    polygons = polygons.repartition(max(1, -(-count // CORNERS)), "poly_idx")
    rings = polygons.select("poly_idx", F.posexplode("rings").alias("ring", "points"))
    once = F.filter("points", lambda p, i: (i == 0) | (p != F.get(F.col("points"), i - 1)))
    rings = rings.withColumn("points", once)
    closed = (F.size("points") > 1) & (F.get("points", F.lit(0)) == F.get("points", F.size("points") - 1))
    rings = rings.withColumn("points", F.when(closed, F.slice("points", 1, F.size("points") - 1)).otherwise(F.col("points")))
    corners = rings.select("poly_idx", "ring", F.size("points").alias("n"), "points", F.posexplode("points").alias("i", "p"))
    beside = F.array(*[F.get("points", (F.col("i") + F.col("n") + d) % F.col("n")) for d in (-1, 1)])
    corners = corners.select("poly_idx", "ring", "i", F.col("p.x").alias("x"), F.col("p.y").alias("y"), beside.alias("beside"))
    parting = corners.select("x", "y", F.explode("beside").alias("b")).distinct().groupBy("x", "y").agg(F.count("*").alias("n")).where("n > 2").select("x", "y")
    places = corners.join(parting, ["x", "y"], "left_semi").groupBy("poly_idx", "ring").agg(F.collect_list("i").alias("junctions"))

    def thin(points: pa.Array, junctions: pa.Array) -> pa.Array:
        out = []
        for ring, at in zip(points.to_pylist(), junctions.to_pylist(), strict=True):
            left = thinned([(p["x"], p["y"]) for p in ring], at or [], tolerance)
            out.append(None if left is None else [{"x": x, "y": y} for x, y in left])
        return pa.array(out, pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))

    thin_udf = F.arrow_udf(thin, "array<struct<x:double,y:double>>")
    done = rings.join(places, ["poly_idx", "ring"], "left").select("poly_idx", "ring", thin_udf("points", "junctions").alias("points"))
    whole = done.where("points is not null").groupBy("poly_idx").agg(F.sort_array(F.collect_list(F.struct("ring", "points"))).alias("_parts"))
    kept = F.coalesce(F.col("_parts.points"), F.array().cast(RINGS))
    return polygons.join(whole, "poly_idx", "left").withColumn("rings", F.when(F.col("rings").isNotNull(), kept)).select(*polygons.columns)
