"""The name most like each of some names, without a row for each pair that is compared.

Names of a block meet in bounded groups as arrays. Bounds from their letters tell which
of a name's pairs might be its best one; only those are compared.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import Names
from ..scratch import held

#: Names of a block that meet in one group, at most, of the asked and of the others.
ASKED, OFFERED = 1024, 8192
#: Pairs that are looked at together.
CHUNK = 1 << 19
#: Digits that count, and by how much two similarities may differ that agree in these.
DIGITS, NEAR = 6, 1.001e-6
#: A name of up to so many characters is more like itself than like any other, by far more than NEAR.
OWN = 1000


def _nearest(asked: pa.Table, offered: pa.Table) -> pa.Table:
    """Each asked name with those that may be its nearest: the best, and any other by less than NEAR; of equal ones the first."""
    a, b = sorted(asked["a"].to_pylist()), sorted(offered["b"].to_pylist())
    names, found = Names(a + b), []
    step = max(1, CHUNK // max(len(b), 1))
    for start in range(0, len(a) if b else 0, step):
        i = np.arange(start, min(start + step, len(a)))
        row, of = np.repeat(i, len(b)), np.tile(np.arange(len(b)), len(i))
        upper = names.at_most(row, of + len(a))
        first = upper.reshape(len(i), len(b)).argmax(axis=1)
        least = names.alike(i, first + len(a))
        able = np.flatnonzero(upper >= np.repeat(least, len(b)) - NEAR)
        row, of = row[able], of[able]
        like = names.alike(row, of + len(a))
        np.maximum.at(least, row - start, like)
        fine = np.flatnonzero(like >= least[row - start] - NEAR)
        row, of, like = row[fine], of[fine], like[fine]
        at = np.lexsort((of, like, row))
        new = (np.diff(row[at], prepend=-1) != 0) | (np.diff(like[at], prepend=-1.0) != 0)
        found.append((row[at[new]], of[at[new]], like[at[new]]))
    row, of, like = (np.concatenate([x[j] for x in found]) if found else np.zeros(0, dtype=t) for j, t in ((0, int), (1, int), (2, float)))
    return pa.table({"a": pa.array([a[i] for i in row], pa.string()), "b": pa.array([b[i] for i in of], pa.string()), "jw": pa.array(like, pa.float64())})


def nearest_names(asked: DataFrame, offered: DataFrame) -> DataFrame:
    """a, b, jw: of the names ``b`` of ``offered`` (block, b) that share a block with a name ``a`` of ``asked`` (block, a), the
    one with the highest Jaro-Winkler similarity in DIGITS digits, the first of several. Where all are null, b and jw are."""
    asked, offered = held(asked.where("block is not null and a is not null").distinct(), None), held(offered.where("block is not null").distinct(), None)
    there = offered.where("b is not null")
    itself = asked.where(F.length("a").between(1, OWN)).join(there.withColumnRenamed("b", "a"), ["block", "a"], "left_semi").select("a").distinct()
    rest = asked.join(itself, "a", "left_anti")
    parts = lambda df, n, name: df.groupBy("block").agg(F.ceil(F.count("*") / n).cast("int").alias(name))
    sizes = parts(rest, ASKED, "_pa").join(parts(there, OFFERED, "_pb"), "block")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    x = rest.join(sizes, "block").withColumn("_ca", F.pmod(F.xxhash64("a"), "_pa").cast("int")).withColumn("_cb", every("_pb"))
    y = there.join(sizes, "block").withColumn("_cb", F.pmod(F.xxhash64("b"), "_pb").cast("int")).withColumn("_ca", every("_pa"))
    group = ["block", "_ca", "_cb"]
    near = x.select(*group, "a").groupBy(*group).cogroup(y.select(*group, "b").groupBy(*group)).applyInArrow(_nearest, "a string, b string, jw double")
    none = F.lit(None)
    alone = rest.join(offered.where("b is null"), "block", "left_semi").select("a", none.cast("string").alias("b"), none.cast("double").alias("jw"))
    found = near.withColumn("jw", F.round("jw", DIGITS)).union(alone).groupBy("a").agg(F.max("jw").alias("jw"), F.min_by("b", F.when(F.col("jw").isNotNull(), F.struct(-F.col("jw"), F.col("b")))).alias("b"))
    return found.select("a", "b", "jw").union(itself.select("a", F.col("a").alias("b"), F.lit(1.0).alias("jw")))
