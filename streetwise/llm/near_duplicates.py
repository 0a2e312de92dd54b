"""Operator 9: near-duplicate documents by HyperMinHash.

A document's set holds its distinct 2-word shingles. Each of 128 buckets is a
hash function of its own (not a slice of one hash: short texts would leave
slices empty) and stores, of the smallest hash, the count of leading zeros and
10 mantissa bits: two bytes. Registers are banded 32 x 4; a pair of similarity
0.8 misses all bands with a chance of 5e-8. Candidates pass the
collision-corrected estimate less five standard errors, then the full sets
decide.

Groups are never expanded into all pairs. Equal sets are one class. In each
band bucket all members are compared with one hub; then, in buckets whose
members are still in different components, the members of different components
are compared in blocks of bounded size, each pair in the first band it shares:
first by registers, then, those with a likely partner, by their full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, in_small_batches, small, table
from .components import components
from .textarrays import mix, shingle_sets, trimmed

BANDS, ROWS, MANTISSA = 32, 4, 10
BUCKETS = BANDS * ROWS
#: Least similarity in percent: 100 * intersection >= LEAST * union.
LEAST = 80
#: Shingles in one block of a bucket, and members in one where only registers are compared.
BLOCK, MEMBERS = 300_000, 1024
_U = np.uint64
_SEED = np.arange(1, BUCKETS + 1, dtype=_U)
_A, _B = mix(_SEED) | _U(1), mix(_SEED + _U(1 << 32))


def registers(shingles: np.ndarray) -> np.ndarray:
    """Leading zeros and mantissa bits of each bucket's smallest hash."""
    low = np.full(BUCKETS, np.iinfo(_U).max, dtype=_U)
    for i in range(0, len(shingles), 2048):
        np.minimum(low, (shingles[i : i + 2048, None] * _A + _B).min(axis=0), out=low)
    low = np.maximum(low >> _U(11), _U(1))  # 53 bits: exact as doubles
    exponent = np.frexp(low.astype(np.float64))[1].astype(np.int64)  # bit length
    zeros = 53 - exponent
    mantissa = ((low << zeros.astype(_U)) >> _U(52 - MANTISSA)) & _U((1 << MANTISSA) - 1)
    return (zeros.astype(_U) << _U(MANTISSA) | mantissa).astype("<u2")


def corrected(equal: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Similarity from the count of equal registers, less the collisions that two
    disjoint sets of these sizes are expected to have (HyperMinHash, Yu and Weber)."""
    ratio = np.maximum(n, m) / np.maximum(np.minimum(n, m), 1)
    by_chance = BUCKETS * 0.16991949 * 2.0**-MANTISSA * 4 * ratio / (1 + ratio) ** 2
    return np.clip((equal - by_chance) / (BUCKETS - by_chance), 0, 1)


def least_estimate(least: int) -> float:
    t = least / 100
    return t - 5 * (t * (1 - t) / BUCKETS) ** 0.5


_SIGNATURE = pa.struct([("n", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("regs", pa.binary())])


def _signatures(text: pa.Array) -> pa.Array:
    n, h1, h2, regs = [], [], [], []
    for s in shingle_sets(text):
        n.append(len(s))
        h1.append(int(np.add.reduce(mix(s + _U(1))).view(np.int64)) if len(s) else 0)
        h2.append(int(np.add.reduce(mix(s ^ _U(0x5851F42D4C957F2D))).view(np.int64)) if len(s) else 0)
        regs.append(registers(s).tobytes() if len(s) else None)
    trimmed()
    return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(regs, pa.binary())], fields=list(_SIGNATURE))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<u2").reshape(len(column), BUCKETS)


def _estimates(a: pa.Array, b: pa.Array, n: pa.Array, m: pa.Array) -> pa.Array:
    equal = (_matrix(a) == _matrix(b)).sum(axis=1) if len(a) else np.zeros(0)
    return pa.array(corrected(equal, n.to_numpy(), m.to_numpy()), pa.float64())


def linked(x: np.ndarray, y: np.ndarray, least: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both > 0 and 100 * both >= least * (len(x) + len(y) - both)


def _verdicts(least: int):
    def verdicts(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([linked(x, y, least) for x, y in zip(shingle_sets(a), shingle_sets(b), strict=True)], pa.bool_())

    return verdicts


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Rows with equal keys, from batches that are sorted by them."""
    rest: list[pa.Table] = []
    for batch in batches:
        t = pa.Table.from_batches([batch])
        if not len(t):
            continue
        k = np.stack([t[c].to_numpy() for c in keys])
        at = [0, *(np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1).tolist(), len(t)]
        if rest and any(rest[-1][c][-1].as_py() != t[c][0].as_py() for c in keys):
            yield pa.concat_tables(rest)
            rest = []
        for i, j in zip(at, at[1:], strict=False):
            rest.append(t.slice(i, j - i))
            if j < len(t):
                yield pa.concat_tables(rest)
                rest = []
    if rest:
        yield pa.concat_tables(rest)


def _block_links(run: pa.Table, least: int) -> list[tuple[int, int]]:
    """Links between members of different components of one pair of blocks, as
    many as join them; each pair only in the first band that it shares."""
    ids, comp, side = (run[c].to_numpy() for c in ("rep", "comp", "side"))
    one = run["bi"][0].as_py() == run["bj"][0].as_py()
    band = run["band"][0].as_py()
    regs = _matrix(run["regs"].combine_chunks())
    bands = regs.view("<u8")
    sets = list(shingle_sets(run["text"]))
    size = np.array([len(s) for s in sets])
    # Dense numbers for the shingles; marks then give exact intersections at once.
    _, dense = np.unique(np.concatenate(sets), return_inverse=True)
    at = np.concatenate(([0], np.cumsum(size)))
    mark = np.zeros(int(dense.max()) + 1 if len(dense) else 1, dtype=np.int32)
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (y := root.get(x, x)) != x:
            root[x] = root.get(y, y)
            x = y
        return x

    out, floor = [], least_estimate(least)
    for i in range(len(ids)):
        later = np.arange(i + 1, len(ids))
        if not one:
            later = later[side[later] != side[i]]
        later = later[comp[later] != comp[i]]
        later = later[(size[later] * 100 >= least * size[i]) & (size[i] * 100 >= least * size[later])]
        if len(later):
            later = later[np.argmax(bands[later] == bands[i], axis=1) == band]
        if len(later):
            equal = (regs[later] == regs[i]).sum(axis=1)
            later = later[corrected(equal, size[later], size[i]) >= floor]
        if not len(later):
            continue
        mark[dense[at[i] : at[i + 1]]] = 1
        for j in later:
            if find(int(comp[i])) != find(int(comp[j])):
                both = int(mark[dense[at[j] : at[j + 1]]].sum())
                if 100 * both >= least * (size[i] + size[j] - both):
                    root[find(int(comp[i]))] = find(int(comp[j]))
                    out.append((int(ids[i]), int(ids[j])))
        mark[dense[at[i] : at[i + 1]]] = 0
    return out


def _likely(run: pa.Table, least: int) -> np.ndarray:
    """Which members of a pair of blocks have a likely partner in another component."""
    comp, side, size = (run[c].to_numpy() for c in ("comp", "side", "n"))
    one = run["bi"][0].as_py() == run["bj"][0].as_py()
    band, regs = run["band"][0].as_py(), _matrix(run["regs"].combine_chunks())
    bands, out, floor = regs.view("<u8"), np.zeros(len(run), dtype=bool), least_estimate(least)
    for i in range(len(run) - 1):
        later = np.arange(i + 1, len(run))
        later = later[(comp[later] != comp[i]) & (one | (side[later] != side[i])) & (size[later] * 100 >= least * size[i]) & (size[i] * 100 >= least * size[later])]
        if len(later):
            later = later[np.argmax(bands[later] == bands[i], axis=1) == band]
        if len(later):
            later = later[corrected((regs[later] == regs[i]).sum(axis=1), size[later], size[i]) >= floor]
            out[later] = True
            out[i] |= len(later) > 0
    return out


def _blocked(members: DataFrame, blocks: Column) -> DataFrame:
    """Each member once for every pair of blocks of its bucket that holds its own."""
    out = members.withColumn("blocks", F.greatest(blocks, F.lit(1)).cast("long")).withColumn("side", F.pmod(F.xxhash64("rep", "th"), "blocks"))
    out = out.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return out.withColumn("bi", F.least("side", "other")).withColumn("bj", F.greatest("side", "other")).drop("other", "blocks")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """Returns doc_id, n_shingles, component_id, kept; one row for each row of ``docs``.

    Null or empty texts, and texts of white space, have an empty set and are linked
    with nothing. A single word is a set of one. Rows that repeat a doc_id are the
    same document, linked with whatever one of its texts is linked with. A row without
    doc_id is linked with nothing; its component_id is null and it is kept. An empty
    table gives no rows. Other columns are ignored."""
    in_small_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("th", F.xxhash64("text"))
    signature = F.arrow_udf(_signatures, "struct<n:bigint,h1:bigint,h2:bigint,regs:binary>")
    sig = cut(base.select("doc_id", "th", signature("text").alias("s")).select("doc_id", "th", "s.*"))
    first_doc = F.min(F.struct("doc_id", "th"))
    reps = sig.where("n > 0 and doc_id is not null").groupBy("h1", "h2").agg(first_doc.alias("d"), F.first("n").alias("n"), F.first("regs").alias("regs"))
    reps = cut(reps.select("h1", "h2", F.col("d.doc_id").alias("rep"), F.col("d.th").alias("th"), "n", "regs"))

    keys = F.array(*[F.xxhash64(F.lit(i), F.substring("regs", 8 * i + 1, 8)) for i in range(BANDS)])
    bands = reps.select("rep", "th", "n", F.posexplode(keys).alias("band", "key"))
    hubs = bands.groupBy("key").agg(F.count("*").alias("members"), F.min(F.struct(F.xxhash64("rep").alias("h"), "rep")).alias("hub"), F.sum("n").alias("size"))
    # Written first: a join of two exchanges, not of an aggregate, is split where a key is hot.
    hubs = cut(hubs.where("members > 1").select("key", "members", "size", F.col("hub.rep").alias("hub")))
    members = cut(bands.join(small(hubs), "key").where("rep <> hub"))
    pairs = members.select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b")).distinct()
    side = lambda c: reps.select(F.col("rep").alias(c), F.col("n").alias(f"n_{c}"), F.col("regs").alias(f"regs_{c}"))
    estimate = F.arrow_udf(_estimates, "double")("regs_a", "regs_b", "n_a", "n_b")
    likely = cut(pairs.join(side("a"), "a").join(side("b"), "b").where(f"100 * n_a >= {least} * n_b and 100 * n_b >= {least} * n_a").where(estimate >= least_estimate(least)).select("a", "b").distinct())

    def texts_of(ids: DataFrame) -> DataFrame:
        ids = cut(ids.distinct())
        return base.join(small(ids), base["doc_id"] == ids["id"], "left_semi").distinct()

    texts = texts_of(likely.select(F.explode(F.array("a", "b")).alias("id")))
    paired = likely.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")
    links = paired.where(F.arrow_udf(_verdicts(least), "boolean")("ta", "tb")).select("a", "b")
    # A document of several texts stands in several classes: it links their first documents.
    several = sig.where("n > 0 and doc_id is not null").select("doc_id", "h1", "h2").distinct()
    several = several.join(small(cut(several.groupBy("doc_id").agg(F.count("*").alias("m")).where("m > 1").select("doc_id"))), "doc_id", "left_semi")
    links = cut(links.union(several.join(reps, ["h1", "h2"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))))

    first = cut(components(links))
    there = members.select("key", "band", "rep", "th", "n", "size").join(small(first.withColumnRenamed("node", "rep")), "rep", "left").withColumn("comp", F.coalesce("component", "rep"))
    open_keys = cut(there.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("here")).where("x <> y").select("key", "here"))
    left = cut(there.join(small(open_keys), "key").select("key", "band", "rep", "th", "n", "comp", "here"))

    def each_run(find, batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
        for run in _runs(batches, ["key", "bi", "bj"]):
            if found := find(run):
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in range(len(names))], names=names)

    # Registers alone go to all pairs of blocks; texts only of members that may have a partner.
    regs = reps.select("rep", "th", "regs")
    thin = _blocked(left, F.ceil(F.col("here") / MEMBERS)).join(regs, ["rep", "th"])
    thin = thin.select("key", "band", "rep", "th", "n", "comp", "side", "bi", "bj", "regs").repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj", "rep", "th")

    def flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = lambda run: list(zip(*(run.filter(pa.array(_likely(run, least)))[c].to_pylist() for c in ("key", "rep", "th")), strict=True))
        return each_run(mine, batches, ["key", "rep", "th"])

    flagged = cut(thin.mapInArrow(flag, "key bigint, rep bigint, th bigint").distinct())
    sized = cut(flagged.join(left.select("key", "rep", "th", "band", "n", "comp"), ["key", "rep", "th"]))
    total = cut(sized.groupBy("key").agg(F.sum("n").alias("shingles")))
    some = texts_of(sized.select(F.col("rep").alias("id"))).select(F.col("doc_id").alias("rep"), "th", "text")
    full = _blocked(sized.join(small(total), "key"), F.ceil(F.col("shingles") / BLOCK)).join(some, ["rep", "th"]).join(regs, ["rep", "th"])
    full = full.select("key", "band", "rep", "comp", "side", "bi", "bj", "text", "regs").repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj", "rep")
    added = full.mapInArrow(lambda batches: each_run(lambda run: _block_links(run, least), batches, ["a", "b"]), "a bigint, b bigint")
    found = cut(components(added.union(first.select(F.col("node").alias("a"), F.col("component").alias("b")))))
    of_class = cut(reps.select("h1", "h2", "rep").join(small(found.withColumnRenamed("node", "rep")), "rep", "left").select("h1", "h2", F.coalesce("component", "rep").alias("c")))
    out = sig.join(small(of_class), ["h1", "h2"], "left")
    mine = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("c")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), mine.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op9_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
