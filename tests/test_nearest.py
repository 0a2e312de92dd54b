"""Nearest names, against a comparison of all pairs."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from streetwise.functions.similarity import Names, jaro_winkler_many
from streetwise.operators import nearest
from streetwise.operators.nearest import nearest_names


def tables(spark, asked, offered):
    return spark.createDataFrame(asked, "block int, a string"), spark.createDataFrame(offered, "block int, b string")


def by_pairs(asked, offered):
    """As row_number() OVER (PARTITION BY a ORDER BY jw DESC NULLS LAST, b NULLS LAST) = 1."""
    best = {}
    for a, b in {(a, b) for c, a in asked for d, b in offered if a is not None and c is not None and c == d}:
        jw = None if b is None else round(jaro_winkler_many([a], [b])[0], 6)
        best.setdefault(a, []).append(((jw is None, -(jw or 0), b or ""), b, jw))
    return sorted((a, *min(x)[1:]) for a, x in best.items())


@pytest.mark.parametrize("sizes", [(1024, 8192, 1 << 19), (3, 4, 7)])
def test_nearest_is_that_of_all_pairs(spark, monkeypatch, sizes):
    for name, value in zip(("ASKED", "OFFERED", "CHUNK"), sizes, strict=True):
        monkeypatch.setattr(nearest, name, value)
    rng = random.Random(3)
    name = lambda: "".join(rng.choice("ABÉ 😀") for _ in range(rng.choice([0, 1, 2, 3, 6, 66])))
    offered = [(rng.randrange(3), name()) for _ in range(120)] + [(1, None), (7, None)]
    asked = [(rng.randrange(4), rng.choice([name(), offered[i][1]])) for i in range(90)] + [(7, "ALONE"), (1, "ZZZ"), (None, "A"), (2, None)]
    got = sorted(map(tuple, nearest_names(*tables(spark, asked, offered)).collect()))
    want = by_pairs(asked, offered)
    assert got == want and ("ALONE", None, None) in got and len(got) > 20


def test_no_row_of_a_pair_is_made(spark):
    """As a row for each pair of different names, these grew with the square of the names."""
    names = [f"{x}{y} {z}" for x in "ABCDEFGH" for y in "IJKLMNOP" for z in ("HILL", "BANK")]
    out = nearest_names(*tables(spark, [(1, n[:-1]) for n in names], [(1, n) for n in names]))
    assert "FlatMapCoGroupsInArrow" in out._jdf.queryExecution().optimizedPlan().toString()
    assert {r["a"]: r["b"] for r in out.collect()} == {n[:-1]: n for n in names}
    assert out.where(F.col("jw") < 0.9).count() == 0


def test_only_pairs_that_may_be_best_are_compared(monkeypatch):
    compared, plain = [], Names.alike
    monkeypatch.setattr(Names, "alike", lambda self, a, b, *boost: compared.append(len(a)) or plain(self, a, b, *boost))
    names = [f"{x}{y} {z}" for x in "ABCDEFGH" for y in "IJKLMNOP" for z in ("HILL", "BANK")]
    out = nearest._nearest(pa.table({"a": [n[:-1] for n in names]}), pa.table({"b": names}))
    assert sorted(out["b"].to_pylist()) == sorted(names)
    assert sum(compared) < len(names) ** 2 / 10
