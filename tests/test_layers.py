"""Layers of polygons: shapefiles written here byte by byte, and GeoJSON."""

import datetime
import json
import random
import struct
from collections import Counter

import pytest

from streetwise.operators import spatial
from streetwise.sources import polygons, shapefile

SQUARE = lambda x, y, d: [(x, y), (x, y + d), (x + d, y + d), (x + d, y)]
SHAPES = [[SQUARE(0, 0, 10), SQUARE(2, 2, 1)], None, [SQUARE(100, 50, 1), SQUARE(110, 50, 1)], [SQUARE(-20, -20, 5)], [SQUARE(1, 1, 1)]]
ATTRIBUTES = [("Ost é", 12, 1.5, "20240131", "T"), ("none", None, None, None, None), ("two parts", -3, None, "bad date", "F"), ("deleted", 1, 1.0, None, None), ("", 7, 2.0, "19991231", "?")]


def write(base, shapes=SHAPES, attributes=ATTRIBUTES, names=("NAME", "NUM", "RINGS", "DAY", "FLAG"), deleted=(3,)):
    body, index, at = b"", b"", 100
    for i, rings in enumerate(shapes, 1):
        content = struct.pack("<i", 0)
        if rings is not None:
            closed = [[*r, r[0]] for r in rings]
            xs, ys = [p[0] for r in closed for p in r], [p[1] for r in closed for p in r]
            starts = [sum(len(r) for r in closed[:k]) for k in range(len(closed))]
            content = struct.pack("<i4dii", 5, min(xs), min(ys), max(xs), max(ys), len(closed), len(xs)) + struct.pack(f"<{len(starts)}i", *starts) + b"".join(struct.pack("<2d", *p) for r in closed for p in r)
        index += struct.pack(">ii", at // 2, len(content) // 2)
        body += struct.pack(">ii", i, len(content) // 2) + content
        at += 8 + len(content)
    head = lambda n: struct.pack(">i20xi", 9994, n // 2) + struct.pack("<ii64x", 1000, 5)
    base.with_suffix(".shp").write_bytes(head(100 + len(body)) + body)
    base.with_suffix(".shx").write_bytes(head(100 + len(index)) + index)
    sizes = list(zip(names, "CNNDL", (12, 9, 10, 8, 1), (0, 0, 2, 0, 0), strict=True))
    fields = b"".join(n.encode().ljust(11, b"\0") + k.encode() + b"\0" * 4 + bytes([s, d]) + b"\0" * 14 for n, k, s, d in sizes)
    rows = b"".join((b"*" if i in deleted else b" ") + b"".join(("" if v is None else str(v)).encode().ljust(s) for v, (_, _, s, _) in zip(row, sizes, strict=True)) for i, row in enumerate(attributes))
    base.with_suffix(".dbf").write_bytes(struct.pack("<B3xIHH20x", 3, len(attributes), 33 + len(fields), 1 + sum(s for _, _, s, _ in sizes)) + fields + b"\r" + rows)
    base.with_suffix(".cpg").write_text("UTF-8")
    return str(base.with_suffix(".shp"))


def plain(rings):
    return rings and [[(p["x"], p["y"]) for p in r] for r in rings]


@pytest.mark.parametrize("size", [1, 400, 1 << 20])
def test_shapefile_in_ranges_of_records(spark, tmp_path, size):
    shapefile.register(spark)
    df = spark.read.format("shapefile").option("partition_bytes", size).load(write(tmp_path / "a"))
    assert [f"{c} {t}" for c, t in df.dtypes[6:]] == ["NAME string", "NUM bigint", "RINGS_ double", "DAY date", "FLAG boolean"]
    rows = {r["poly_idx"]: r for r in df.collect()}
    assert {i: plain(r["rings"]) for i, r in rows.items()} == {i: SHAPES[i] for i in (0, 1, 2, 4)}
    assert (rows[2]["min_x"], rows[2]["min_y"], rows[2]["max_x"], rows[2]["max_y"]) == (100, 50, 111, 51)
    assert tuple(rows[0])[6:] == ("Ost é", 12, 1.5, datetime.date(2024, 1, 31), True)
    assert tuple(rows[1])[2:] == (None, None, None, None, "none", None, None, None, None)
    assert tuple(rows[2])[6:] == ("two parts", -3, None, None, False) and rows[4]["NAME"] is None and rows[4]["FLAG"] is None
    assert df.rdd.getNumPartitions() == {1: 5, 400: 3, 1 << 20: 1}[size]


def test_bounds_leave_out_records_before_their_points_are_read(spark, tmp_path, monkeypatch):
    path, seen = write(tmp_path / "a"), []
    whole = shapefile.rings_of
    monkeypatch.setattr(shapefile, "rings_of", lambda content: seen.append(1) or whole(content))
    reader = shapefile.ShapefileReader({"path": path, "bounds": "11,0,105,60"})
    assert [row[0] for p in reader.partitions() for row in reader.read(p)] == [2] and len(seen) == 1
    assert [r["poly_idx"] for r in polygons.read_polygons(spark, path, bounds=(2.5, 2.5, 3, 3)).collect()] == [0]


def test_other_files_are_refused(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        shapefile.ShapefileReader({"path": str(tmp_path / "none.shp")}).partitions()
    (tmp_path / "b.shp").write_bytes(b"\0" * 100)
    (tmp_path / "b.shx").write_bytes(b"\0" * 100)
    with pytest.raises(ValueError, match="polygons"):
        shapefile.ShapefileReader({"path": str(tmp_path / "b.shp")}).partitions()
    shapes = write(tmp_path / "empty", [], [])
    assert polygons.read_polygons(spark, shapes).count() == 0


def geojson():
    shape = lambda parts, **p: {"type": "Feature", "properties": p, "geometry": parts and {"type": "Polygon", "coordinates": [[list(q) for q in r] for r in parts]}}
    out = [shape(SHAPES[0], name="a", n=1), shape(None, other="x"), shape(SHAPES[3], rings="clash", n=None)]
    out[2]["geometry"] = {"type": "MultiPolygon", "coordinates": [[[list(p) for p in SQUARE(100, 50, 1)]], [[list(p) for p in SQUARE(110, 50, 1)]]]}
    return out


def test_geojson_in_one_file_and_in_lines(spark, tmp_path):
    (tmp_path / "a.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": geojson()}, indent=1))
    (tmp_path / "a.geojsonl").write_text("\n".join(json.dumps(f) for f in geojson()))
    for name in ("a.geojson", "a.geojsonl"):
        df = polygons.read_polygons(spark, str(tmp_path / name))
        assert df.columns == ["poly_idx", "rings", "n", "name", "other"]
        rows = sorted(df.collect())
        assert [(r["n"], r["name"], r["other"]) for r in rows] == [("1", "a", None), (None, None, "x"), (None, None, None)]
        assert plain(rows[2]["rings"]) == [SQUARE(100, 50, 1), SQUARE(110, 50, 1)] and rows[1]["rings"] is None
        assert polygons.read_polygons(spark, str(tmp_path / name), bounds=(90, 0, 105, 60)).count() == 1
    (tmp_path / "b.geojson").write_text(json.dumps({"features": [], "crs": {"properties": {"name": "EPSG:3857"}}}))
    with pytest.raises(ValueError, match="3857"):
        polygons.read_polygons(spark, str(tmp_path / "b.geojson"))


def test_points_in_a_layer_from_a_shapefile(spark, tmp_path):
    layer = polygons.read_polygons(spark, write(tmp_path / "a"))
    points = spark.createDataFrame([(1, 5.0, 5.0), (2, 2.5, 2.5), (3, 50.5, 110.5), (4, -18.0, -18.0)], "id int, latitude double, longitude double")
    out = spatial.spatial_lookup(points, layer, return_cols=["NAME"])
    assert {r["id"]: r["NAME"] for r in out.collect()} == {1: "Ost é", 2: None, 3: "two parts", 4: None}


def area(ring):
    return abs(sum(x1 * y2 - x2 * y1 for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True))) / 2


def wavy(a, b, seed):
    """A border between two points, the same whichever side asks."""
    if a > b:
        return wavy(b, a, seed)[::-1]
    rng = random.Random(f"{a}{b}{seed}")
    ts = sorted(rng.random() for _ in range(9))
    return [a, *[(a[0] + t * (b[0] - a[0]) + rng.uniform(-0.1, 0.1), a[1] + t * (b[1] - a[1]) + rng.uniform(-0.1, 0.1)) for t in ts], b]


@pytest.mark.parametrize("tolerance", [0.0, 0.02, 0.3])
def test_simplified_neighbours_keep_a_common_border(spark, tolerance):
    cells, n = [], 4
    for x in range(n):
        for y in range(n):
            ends = [(x, y), (x + 1, y), (x + 1, y + 1), (x, y + 1), (x, y)]
            ring = [p for a, b in zip(ends, ends[1:], strict=False) for p in wavy(tuple(map(float, a)), tuple(map(float, b)), 1)[:-1]]
            turned = ring[::-1] if (x + y) % 2 else ring[3:] + ring[:3]
            cells.append((len(cells), [turned + turned[:1]], f"c{x}{y}"))
    hole = SQUARE(20.0, 20.0, 5.0)
    others = [(100, [SQUARE(10.0, 10.0, 20.0), hole], "around"), (101, [hole[::-1]], "island"), (102, [SQUARE(50.0, 50.0, 0.1)], "small"), (103, [], "none"), (104, None, None), (105, [[(1.5, 1.0)], []], "point")]
    layer = spark.createDataFrame(cells + others, f"poly_idx int, rings {spatial.RINGS}, name string").repartition(4)
    out = {r["poly_idx"]: plain(r["rings"]) for r in spatial.simplify_layer(layer, tolerance).collect()}
    assert len(out) == len(cells) + len(others)
    sides = Counter(frozenset((a, b)) for i in range(n * n) for r in out[i] for a, b in zip(r, r[1:] + r[:1], strict=True))
    hull = [s for s, k in sides.items() if k == 1]
    assert max(sides.values()) == 2 and len(hull) < len(sides) / 2  # each inner side belongs to two cells
    inside = [p for s in sides if s not in hull for p in s]
    assert {(float(x), float(y)) for x in range(1, n) for y in range(1, n)} <= set(inside)
    if tolerance == 0:
        assert {i: set(r[0]) for i, r in out.items() if i < n * n} == {i: set(r[0]) for i, r, _ in cells}
    else:
        assert sum(len(out[i][0]) for i in range(n * n)) < sum(len(r[0]) for _, r, _ in cells)
    assert set(out[100][1]) == set(out[101][0]) == set(hole) and area(out[100][0]) == 400
    assert len(out[102]) == (tolerance < 0.2) and out[103] == [] and out[104] is None and out[105] == [[(1.5, 1.0)], []]


def test_a_layer_of_one_file_is_dealt_by_corners(spark, monkeypatch):
    """One task made the corners of all polygons of a file."""
    layer = spark.createDataFrame([(i, [SQUARE(2.0 * i, 0.0, 1.0)], "x") for i in range(20)], f"poly_idx int, rings {spatial.RINGS}, name string").coalesce(1)
    whole = {r["poly_idx"]: plain(r["rings"]) for r in spatial.simplify_layer(layer, 0.1).collect()}
    monkeypatch.setattr(spatial, "CORNERS", 16)
    out = spatial.simplify_layer(layer, 0.1)
    assert "RepartitionByExpression [poly_idx" in (plan := out._jdf.queryExecution().optimizedPlan().toString()) and any(f", {n}" in plan for n in (5, 6, 7))
    assert {r["poly_idx"]: plain(r["rings"]) for r in out.collect()} == whole and len(whole) == 20
