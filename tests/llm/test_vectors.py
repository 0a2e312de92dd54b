"""Operators over vectors (11 and 12) against brute force, with odd rows."""

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from streetwise.llm import clustering, cover_trees, whitening

SCHEMA = "vec_id long, embedding array<float>, id string, x long, cluster string, distance string, n string"


def vectors(n: int, size: int = 64, groups: int = 5, hot: int = 40) -> list[tuple]:
    """Groups with noise, one vector many times, and rows that don't count."""
    rng = np.random.default_rng(n + size)
    middle = rng.normal(size=(groups, size))
    rows = [(i, (middle[i % groups] + 0.2 * rng.normal(size=size)).astype(np.float32).tolist()) for i in range(n)]
    rows += [(1000 + i, rows[0][1]) for i in range(hot)]
    rows += [(2000, None), (2001, []), (2002, [None] + rows[1][1][1:]), (2003, [float("nan")] + rows[1][1][1:]), (2004, [float("-inf")] + rows[1][1][1:]), (2005, rows[1][1] + [1.0]), (3, rows[7][1]), (3, rows[7][1]), (None, rows[4][1])]
    return [(*r, "clash", 7, "clash", "clash", "clash") for r in rows]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def finite(v):
    return v is not None and all(c is not None and math.isfinite(c) for c in v)


def lloyd(rows, k=8, rounds=10, size=64, seed=3):
    """By plain Python integers."""
    kept = [(i, [math.floor(1024 * c) for c in v]) for i, v, *_ in rows if finite(v) and len(v) == size]
    first = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), x) for i, x in kept if i is not None)[:k]
    centroids = [x for _, x in first]
    far = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c, strict=True))
    assign = lambda: [min((far(x, c), j) for j, c in enumerate(centroids)) for _, x in kept]
    for _ in range(rounds):
        of = assign()
        for j in range(len(centroids)):
            mine = [x for (_, x), (_, to) in zip(kept, of, strict=True) if to == j]
            if mine:
                centroids[j] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    return sorted(((i is None, i or 0), j, d) for (i, _), (d, j) in zip(kept, assign(), strict=True)), centroids


@pytest.mark.parametrize(("block", "k"), [(2048, 8), (37, 3)])
def test_clusters_equal_brute_force(spark, monkeypatch, block, k):
    monkeypatch.setattr(clustering, "BLOCK", block)
    rows = vectors(150)
    found, centroids = clustering.cluster(frame(spark, rows), k=k)
    want, at = lloyd(rows, k)
    assert sorted(((r["id"] is None, r["id"] or 0), r["cluster"], r["distance"]) for r in found.collect()) == want
    assert centroids.tolist() == at


def test_clusters_of_few_or_no_vectors(spark):
    rows = vectors(9)[:2] + [(None, vectors(9)[0][1], "", 0, "", "", "")]
    found, centroids = clustering.cluster(frame(spark, rows))
    assert (found.count(), len(centroids)) == (3, 2)
    for none in (frame(spark, rows).limit(0), frame(spark, rows).where("vec_id is null")):
        found, centroids = clustering.cluster(none)
        assert (found.count(), len(centroids)) == (0, 0)
    with pytest.raises(Exception, match="too large"):
        clustering.cluster(spark.createDataFrame([(1, [1e30] * 64)], "vec_id long, embedding array<double>"))
    with pytest.raises(ValueError, match="k must"):
        clustering.cluster(frame(spark, rows), k=0)


def test_query_of_clusters_equals_sql(spark, tmp_path):
    frame(spark, vectors(200)).write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    got = clustering.op11_dual_tree(spark, str(tmp_path))
    want = con.execute(clustering.SQL)
    names = [c[0] for c in want.description]
    key = lambda r: str(tuple(r))
    assert sorted(map(tuple, got.select(*names).collect()), key=key) == sorted(want.fetchall(), key=key)


@pytest.mark.parametrize("scale", [1, 1 << 26])
def test_the_walk_finds_the_nearest_and_prunes(scale):
    rng = np.random.default_rng(5)
    middle = rng.integers(-900, 900, (12, 16))
    points = np.clip((middle[rng.integers(0, 12, 1500)] + rng.integers(-30, 30, (1500, 16))), -1000, 1000) * scale // 1024
    points[:300] = points[0]
    targets = np.concatenate([middle, middle[:3]]) * scale // 1024
    tree = cover_trees.build(points)
    at = points[tree.order]
    for node in range(len(tree.centre)):  # cover and separation
        far = np.sqrt(cover_trees.squared(at[tree.start[node] : tree.stop[node]], at[tree.centre[node]][None]).astype(float))
        assert far.max() <= tree.radius[node] * (1 + 1e-12)
        if tree.children[node]:
            kids = np.arange(tree.child[node], tree.child[node] + tree.children[node])
            assert tree.start[kids[0]] == tree.start[node] and tree.stop[kids[-1]] == tree.stop[node]
            between = np.sqrt(cover_trees.squared(at[tree.centre[kids]], at[tree.centre[kids]]).astype(float))
            assert (between[np.triu_indices(len(kids), 1)] > tree.radius[node] / cover_trees.BASE).all()
    whole, places, of, far = cover_trees.nearest(tree, at, cover_trees.build(targets, 1), targets)
    exact = cover_trees.squared(at, targets)
    found = np.full(len(at), -1)
    found[places] = of
    assert (far == exact[places, of]).all()
    for node, target in whole:
        assert (found[tree.start[node] : tree.stop[node]] == -1).all()
        found[tree.start[node] : tree.stop[node]] = target
    assert (found == exact.argmin(axis=1)).all()
    if scale > 1:
        assert len(places) < 0.5 * len(at)  # most vectors are assigned by the node


def test_squared_distances_are_exact_beyond_doubles():
    rng = random.Random(2)
    x = np.array([[rng.randrange(-(1 << 27) + 1, 1 << 27) for _ in range(64)] for _ in range(5)])
    assert cover_trees.squared(x, x[:2]).tolist() == [[sum((a - b) ** 2 for a, b in zip(p, q, strict=True)) for q in x[:2].tolist()] for p in x.tolist()]


def covariance(kept):
    """Exact, rounded at the end."""
    x = np.array(kept, dtype=object)
    d = len(x) * x - x.sum(axis=0)
    return (d.T @ d / len(x) ** 3).astype(float), d


def test_whitening_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(whitening, "ROWS", 50)
    rows = vectors(300)
    kept = [(i, [math.floor(1024 * c) + 100_000 for c in v]) for i, v, *_ in rows if finite(v) and len(v) == 64]
    v, d = covariance([x for _, x in kept])
    values, basis = np.linalg.eigh(v)
    values, basis = values[::-1][:8], basis[:, ::-1][:, :8]
    found, fitted, error = whitening.whiten(frame(spark, rows))
    assert fitted.n == len(kept) and np.allclose(fitted.values, values, rtol=1e-9) and error < 1e-9
    assert np.allclose(np.abs((fitted.vectors * basis).sum(axis=0)), 1, atol=1e-9)
    white = (d / len(kept)).astype(float) @ fitted.vectors / np.sqrt(fitted.values)
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    got = sorted(((r["id"], int(r["deviation"]), r["whitened"]) for r in found.collect()), key=key)
    want = sorted(((i, sum(c * c for c in row), w) for (i, _), row, w in zip(kept, d.tolist(), white.tolist(), strict=True)), key=key)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert np.allclose([g[2] for g in got], [w[2] for w in want], atol=1e-9)


def test_query_of_whitening(spark, tmp_path):
    frame(spark, vectors(100)).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = whitening.op12_two_pass(spark, str(tmp_path)).toPandas()
    n = 100 + 40 + 3
    assert len(got) == 8 * n and set(got["n"]) == {n} and set(got["component"]) == set(range(1, 9))
    assert got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-9
    assert got.groupby("component")["explained"].first().is_monotonic_decreasing
    for _, part in got.groupby("component"):
        assert abs((part["whitened"] ** 2).mean() - 1) < 1e-9 and abs(part["whitened"].mean()) < 1e-9


def test_whitening_without_variance_or_rows(spark):
    same = spark.createDataFrame([(i, [0.5] * 3, "c") for i in range(5)] + [(None, [1.0, 2.0], "c")], "vec_id long, embedding array<double>, n string")
    found, fitted, error = whitening.whiten(same)
    assert (len(fitted.values), error, fitted.n) == (0, 0.0, 5)
    assert [(int(r["deviation"]), r["whitened"]) for r in found.collect()] == [(0, [])] * 5
    for none in (same.limit(0), same.where("n = 'x'")):
        found, fitted, _ = whitening.whiten(none)
        assert (found.count(), fitted.n) == (0, 0)
    with pytest.raises(Exception, match="too large"):
        whitening.whiten(spark.createDataFrame([(1, [1e30, 0.0])], "vec_id long, embedding array<double>"))


def test_whitening_of_large_components(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=4) * 10**12).tolist()) for i in range(50)]
    kept = [[math.floor(1024 * c) + 100_000 for c in v] for _, v in rows]
    _, d = covariance(kept)
    found, fitted, error = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), components=9)
    assert len(fitted.values) == 4 and error < 1e-9
    assert sorted(int(r["deviation"]) for r in found.collect()) == sorted(sum(c * c for c in row) for row in d.tolist())
