"""Polygons of very unequal extent against a look at all, their cells, and densities."""

import math
import random

import pytest
from pyspark.sql import functions as F

from streetwise.operators import projection, spatial


def star(rng, x, y, r, n):
    """A ring around a point, of corners at different distances."""
    return [(x + r * d * math.cos(2 * math.pi * k / n), y + r * d * math.sin(2 * math.pi * k / n)) for k in range(n) for d in [rng.uniform(0.4, 1)]]


def holds(rings, x, y):
    odd = False
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
            if (y1 > y) != (y2 > y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1):
                odd = not odd
    return odd


def layer():
    rng = random.Random(3)
    shapes = [[star(rng, 0, 0, 150, 40), star(rng, 0, 0, 40, 9)]]  # a country with a hole
    shapes += [[star(rng, rng.uniform(-100, 100), rng.uniform(-100, 100), 10 ** rng.uniform(-6, 1.5), rng.randint(3, 12))] for _ in range(60)]
    shapes.append([[(120 * math.cos(k / 10), 120 * math.sin(k / 10)) for k in range(62)]])  # round: cells in its midst meet no edge
    return shapes + [[], [[]], [[(5.0, 5.0)]]]  # nothing, no corner, one


def test_unequal_polygons_equal_brute_force(spark):
    rng, shapes = random.Random(4), layer()
    points = [(i, *(rng.uniform(-170, 170) for _ in range(2))) for i in range(400)]
    points += [(1000 + i, *(c + rng.uniform(-1, 1) * 1e-6 for c in shape[0][0])) for i, shape in enumerate(shapes[:62])] + [(2000, None, 1.0), (2001, 1e9, 1e9)]
    df = spark.createDataFrame(points, "id int, longitude double, latitude double")
    polygons = spark.createDataFrame([(i, rings, f"z{i}") for i, rings in enumerate(shapes)], f"poly_idx int, rings {spatial.RINGS}, zone string")
    want = {(p[0], f"z{i}") for p in points if p[1] is not None for i, rings in enumerate(shapes) if holds([r for r in rings if r], p[1], p[2])}
    got = spatial.spatial_lookup(df, polygons, multiple="all")
    assert {(r["id"], r["zone"]) for r in got.collect() if r["zone"]} == want
    first = {r["id"]: r["zone"] for r in spatial.spatial_lookup(df, polygons).collect()}
    assert len(first) == len(points)
    for i, zone in first.items():
        mine = [int(z[1:]) for p, z in want if p == i]
        assert zone == (f"z{min(mine)}" if mine else None)
    per = spatial.cover(spatial.with_boxes(polygons)).groupBy("poly_idx").agg(F.count("*").alias("n"), F.max(F.col("whole").cast("int")).alias("whole")).collect()
    assert max(r["n"] for r in per) <= (spatial.CELLS + 1) ** 2 and {r["poly_idx"]: r["whole"] for r in per}[61] == 1
    for df in got.held:
        df.unpersist()


def test_lookup_without_polygons_or_points(spark):
    none = spark.createDataFrame([], f"poly_idx int, rings {spatial.RINGS}, zone string")
    df = spark.createDataFrame([(1, 2.0, 3.0)], "id int, longitude double, latitude double")
    assert [(r["id"], r["zone"]) for r in spatial.spatial_lookup(df, none).collect()] == [(1, None)]
    assert spatial.spatial_lookup(df.limit(0), none).count() == 0


def test_density_sums_to_one_and_is_normal(spark):
    rng = random.Random(6)
    points = spark.createDataFrame([(rng.gauss(0, 1), rng.gauss(0, 2)) for _ in range(3000)] + [(None, 1.0)], "longitude double, latitude double")
    h = spatial.normal_reference(points)
    assert 0.15 < h[0] < 0.3 and 0.3 < h[1] < 0.6
    got = spatial.kernel_density(points, 60, (-9.0, -9.0, 9.0, 9.0), h).toPandas()
    assert abs(got["density"].sum() * 0.09 - 1) < 0.01
    middle = got[(got["gx"] == 30) & (got["gy"] == 30)]["density"].iloc[0]
    assert abs(middle - 1 / (4 * math.pi)) < 0.012


def degrees(d, m, s):
    return math.copysign(abs(d) + m / 60 + s / 3600, d)


def test_published_control_points(spark):
    """Two survey marks in zone 55, and a station in both datums."""
    marks = [(degrees(144, 25, 29.52440), degrees(-37, 57, 3.72030), 273741.297, 5796489.777), (degrees(143, 55, 35.38390), degrees(-37, 39, 10.15610), 228854.052, 5828259.038)]
    df = spark.createDataFrame(marks, "lon double, lat double, east double, north double")
    x, y = projection.to_layer(F.col("lon"), F.col("lat"), 7855)
    lon, lat = projection.from_layer(x, y, 7855)
    for r in df.select("*", x.alias("x"), y.alias("y"), lon.alias("lon2"), lat.alias("lat2")).collect():
        assert abs(r["x"] - r["east"]) < 1e-3 and abs(r["y"] - r["north"]) < 1e-3
        assert abs(r["lon2"] - r["lon"]) < 1e-9 and abs(r["lat2"] - r["lat"]) < 1e-9
    old, new = (-4052051.7643, 4212836.2017, -2545106.0245), (-4052052.7379, 4212835.9897, -2545104.5898)

    def geographic(x, y, z):  # step by step, for a point that is not on the ellipsoid
        p, lat = math.hypot(x, y), math.atan2(z, math.hypot(x, y))
        for _ in range(20):
            nu = projection.AXIS / math.sqrt(1 - projection._E2 * math.sin(lat) ** 2)
            lat = math.atan2(z + projection._E2 * nu * math.sin(lat), p)
        return math.degrees(math.atan2(y, x)), math.degrees(lat)

    a, b = geographic(*old), geographic(*new)
    one = spark.createDataFrame([(*a, *b)], "lon double, lat double, lon2 double, lat2 double")
    there, back = projection.shifted(F.col("lon"), F.col("lat"), True), projection.shifted(F.col("lon2"), F.col("lat2"), False)
    got = one.select(*there, *back).first()
    metres = 1 / 111_000
    assert all(abs(g - w) < 0.002 * metres for g, w in zip(got, (*b, *a), strict=True))
    assert abs(a[1] - b[1]) > 1 * metres


def test_layer_in_a_grid(spark):
    points = spark.createDataFrame([(1, degrees(144, 25, 29.52440), degrees(-37, 57, 3.72030)), (2, 146.0, -37.0), (3, None, 1.0)], "id int, longitude double, latitude double")
    box = spark.createDataFrame([(0, [[(273740.0, 5796489.0), (273742.0, 5796489.0), (273742.0, 5796490.0), (273740.0, 5796490.0)]], "mark")], f"poly_idx int, rings {spatial.RINGS}, zone string")
    assert {r["id"]: r["zone"] for r in spatial.spatial_lookup(points, box, crs=7855).collect()} == {1: "mark", 2: None, 3: None}
    # A metre and a half off in the older datum.
    assert {r["id"]: r["zone"] for r in spatial.spatial_lookup(points, box, crs=28355).collect()} == {1: None, 2: None, 3: None}
    with pytest.raises(ValueError, match="not supported"):
        spatial.spatial_lookup(points, box, crs=3857)
