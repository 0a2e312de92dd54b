"""Operator 11: centroid clustering by Lloyd's rounds over two trees.

Vectors become integers and lie in blocks, each with a cover tree, which is built
once and written beside them. In a round the centroids get a cover tree of their own;
a block's tree and the centroids' are walked down together (cover_trees.nearest), so
most vectors are assigned by the node, whose sum is known, and the rest compared
exactly. Sums and counts are exact; a round brings a row for each centroid to the
driver, and sends the centroids to all tasks.

Blocks are made where the vectors lie: nothing is dealt by a key, so copies and hot
values load no task more than others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_small_batches, removed, scratch_path, table
from .cover_trees import LARGEST, Tree, build, nearest
from .textarrays import trimmed

DIMENSIONS, SCALE = 64, 1024
CENTROIDS, ROUNDS, SEED = 8, 10, 3
#: Vectors of a block: its distances to one another are held at once while its tree is built.
BLOCK = 2048
#: Centroids at most: they go to every task, where their distances to one another are held likewise.
MOST = 4096
_TREE = ["centre", "radius", "start", "stop", "child", "children"]
_KINDS = {"ids": "<i8", "known": "?", "points": "<i4", "sums": "<i8", "centre": "<i4", "radius": "<f8", "start": "<i4", "stop": "<i4", "child": "<i4", "children": "<i4"}


def usable(vector: Column, dimensions: int) -> Column:
    """Whether a vector has so many components, none null or not finite."""
    fine = F.forall(vector, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < float("inf")))
    return F.coalesce((F.size(vector) == dimensions) & fine, F.lit(False))


def as_integers(vector: Column) -> Column:
    whole = lambda c: F.floor(F.lit(float(SCALE)) * c.cast("double"))
    return F.transform(vector, lambda c: F.when(F.abs(whole(c)) < LARGEST, whole(c).cast("int")).otherwise(F.raise_error(F.lit("a component is too large for exact distances")).cast("int")))


def _blocks(rows: DataFrame, dimensions: int) -> DataFrame:
    """Blocks of rows of id and x, each with its tree, as binary columns."""

    def made(ids: list[pa.Array], vectors: list[np.ndarray]) -> pa.RecordBatch:
        points, keys = np.concatenate(vectors), pa.concat_arrays(ids)
        tree = build(points)
        points = points[tree.order]
        keys = keys.take(pa.array(tree.order))
        totals = np.concatenate([np.zeros((1, dimensions), np.int64), np.cumsum(points, axis=0, dtype=np.int64)])
        parts = {"ids": keys.fill_null(0).to_numpy(), "known": keys.is_valid().to_numpy(zero_copy_only=False), "points": points, "sums": totals[tree.stop] - totals[tree.start]} | {c: getattr(tree, c) for c in _TREE}
        return pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(v, dtype=_KINDS[c]).tobytes()], pa.binary()) for c, v in parts.items()], names=list(parts))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors, n = [], [], 0
        for batch in batches:
            x = batch["x"].flatten().to_numpy().reshape(-1, dimensions)
            first = 0
            while first < len(x):
                taken = min(BLOCK - n, len(x) - first)
                ids.append(batch["id"].slice(first, taken))
                vectors.append(x[first : first + taken])
                first, n = first + taken, n + taken
                if n == BLOCK:
                    yield made(ids, vectors)
                    ids, vectors, n = [], [], 0
        if n:
            yield made(ids, vectors)
        trimmed()

    return rows.mapInArrow(blocks, ", ".join(f"{c} binary" for c in _KINDS))


def _read(row: dict, dimensions: int) -> tuple[dict[str, np.ndarray], Tree]:
    a = {c: np.frombuffer(row[c], dtype=kind) for c, kind in _KINDS.items() if c in row}
    for c in ("points", "sums"):
        if c in a:
            a[c] = a[c].reshape(-1, dimensions)
    return a, Tree(np.arange(len(a["points"])), *[a[c] for c in _TREE])


def _sums(blocks: DataFrame, centroids: np.ndarray) -> DataFrame:
    """c, n, s: of each centroid the count and sum of its vectors, a row for each block."""
    others, dimensions = build(centroids, 1), centroids.shape[1]

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                a, tree = _read(row, dimensions)
                whole, places, targets, _ = nearest(tree, a["points"], others, centroids)
                node, of = np.array(whole, dtype=np.int64).reshape(-1, 2).T
                count, total = np.bincount(targets, minlength=len(centroids)), np.zeros(centroids.shape, np.int64)
                np.add.at(count, of, tree.stop[node] - tree.start[node])
                np.add.at(total, of, a["sums"][node])
                np.add.at(total, targets, a["points"][places])
                held = np.flatnonzero(count)
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(count[held], pa.int64()), pa.array(list(total[held]), pa.list_(pa.int64()))], names=["c", "n", "s"])

    return blocks.select("points", "sums", *_TREE).mapInArrow(summed, "c int, n long, s array<long>")


def _assigned(blocks: DataFrame, centroids: np.ndarray) -> DataFrame:
    """id, cluster, distance of each vector."""
    others, dimensions = build(centroids, 1), centroids.shape[1]

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                a, tree = _read(row, dimensions)
                whole, places, targets, far = nearest(tree, a["points"], others, centroids)
                cluster, distance = np.zeros(len(a["points"]), np.int64), np.zeros(len(a["points"]), np.int64)
                cluster[places], distance[places] = targets, far
                for node, target in whole:
                    here = slice(tree.start[node], tree.stop[node])
                    cluster[here] = target
                    distance[here] = ((a["points"][here].astype(np.int64) - centroids[target]) ** 2).sum(axis=1)
                ids = pa.array(a["ids"], pa.int64(), mask=~a["known"])
                yield pa.RecordBatch.from_arrays([ids, pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())], names=["id", "cluster", "distance"])
        trimmed()

    return blocks.select("ids", "known", "points", *_TREE).mapInArrow(assigned, "id long, cluster int, distance long")


def _next(blocks: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each centroid's exact floor of the mean; one without vectors stays."""
    total = [F.sum(F.element_at("s", i + 1).cast("decimal(20,0)")).alias(f"s{i}") for i in range(centroids.shape[1])]
    out = centroids.copy()
    for row in _sums(blocks, centroids).groupBy("c").agg(F.sum("n").alias("n"), *total).collect():  # a row for each centroid
        out[row["c"]] = [int(row[f"s{i}"]) // row["n"] for i in range(centroids.shape[1])]
    return out


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, dimensions: int = DIMENSIONS) -> tuple[DataFrame, np.ndarray]:
    """Returns rows of id, cluster, distance (squared), one for each vector, and the
    centroids by number.

    Vectors of another count of components, null ones, and those with a component that
    is null or not finite are left out. Components are floor(1024 * x); one of 2 ** 27 or
    more raises an error, as its squared distances might not fit. Centroids begin as the
    k vectors of smallest sha256 of ``seed:id``; rows that repeat an id are vectors of
    their own, in the order of their components, and a null id begins none. Fewer vectors
    than k give fewer centroids; none, no rows. Rounds end early only if no centroid moved,
    as the others would change nothing. The centroids go to every task: there may be MOST.
    Other columns are ignored."""
    spark = vectors.sparkSession
    if not 1 <= k <= MOST:
        raise ValueError(f"k must be 1 to {MOST}")
    in_small_batches(spark)
    rows = vectors.where(usable(F.col(vector_col), dimensions)).select(F.col(id_col).cast("long").alias("id"), as_integers(F.col(vector_col)).alias("x"))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = rows.where("id is not null").orderBy(digest, "x").limit(k).collect()  # k rows
    if not first:
        return spark.createDataFrame([], "id long, cluster int, distance long"), np.zeros((0, dimensions), np.int64)
    centroids = np.array([r["x"] for r in first], dtype=np.int64)
    path = scratch_path(spark, "blocks")
    _blocks(rows, dimensions).write.parquet(path)
    blocks = spark.read.parquet(path)
    for _ in range(rounds):
        before, centroids = centroids, _next(blocks, centroids)
        if (before == centroids).all():
            break
    out = scratch_path(spark, "clusters")
    _assigned(blocks, centroids).write.parquet(out)
    removed(spark, path)
    return spark.read.parquet(out), centroids


def op11_dual_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids = cluster(table(spark, sf_dir, "embeddings"))
    inertia = {r["cluster"]: r["d"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}  # a row for each centroid
    per = [(c, inertia.get(c, 0), ",".join(map(str, x))) for c, x in enumerate(centroids.tolist())]
    known = spark.createDataFrame(per, "cluster int, cluster_inertia long, components string").select("cluster", "cluster_inertia", F.sha2("components", 256).alias("centroid_sha256"))
    out = found.join(F.broadcast(known), "cluster")  # CENTROIDS rows
    return out.select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", F.lit(sum(inertia.values())).cast("long").alias("inertia"), "centroid_sha256")


def _sql() -> str:
    """All rounds, one after another, over rows of vector, dimension and value."""
    steps = [
        f"v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda c: CAST(floor({SCALE} * CAST(c AS DOUBLE)) AS BIGINT)) AS x FROM embeddings WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda c: coalesce(isfinite(c), false))) = {DIMENSIONS})",
        f"x AS MATERIALIZED (SELECT r, unnest(range(1, {DIMENSIONS} + 1)) AS d, unnest(x) AS x FROM v)",
        f"seeds AS (SELECT x, row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), x) - 1 AS c FROM v WHERE vec_id IS NOT NULL QUALIFY c < {CENTROIDS})",
        f"c0 AS MATERIALIZED (SELECT c, unnest(range(1, {DIMENSIONS} + 1)) AS d, unnest(x) AS m FROM seeds)",
    ]
    for i in range(ROUNDS + 1):
        far = f"SELECT r, c, CAST(sum((x - m) * (x - m)) AS BIGINT) AS far FROM x JOIN c{i} USING (d) GROUP BY r, c"
        steps.append(f"a{i} AS MATERIALIZED (SELECT r, c, far FROM ({far}) QUALIFY row_number() OVER (PARTITION BY r ORDER BY far, c) = 1)")
        if i < ROUNDS:
            mean = f"SELECT c, d, sum(x) AS s, count(*) AS n FROM a{i} JOIN x USING (r) GROUP BY c, d"
            steps.append(f"c{i + 1} AS MATERIALIZED (SELECT c, d, CAST(coalesce((s - ((s % n) + n) % n) // n, m) AS BIGINT) AS m FROM c{i} LEFT JOIN ({mean}) USING (c, d))")
    steps.append(f"h AS (SELECT c, sha256(string_agg(CAST(m AS VARCHAR), ',' ORDER BY d)) AS h FROM c{ROUNDS} GROUP BY c)")
    out = f"SELECT vec_id, CAST(c AS INTEGER) AS cluster, far AS distance, CAST(sum(far) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(far) OVER () AS BIGINT) AS inertia, h AS centroid_sha256 FROM a{ROUNDS} JOIN v USING (r) JOIN h USING (c)"
    return "WITH " + ",\n".join(steps) + "\n" + out


SQL = _sql()
