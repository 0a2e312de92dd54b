"""Similarity against DuckDB, text functions, weights."""

import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from streetwise.functions import lexicon as lex
from streetwise.functions import text as tx
from streetwise.functions.similarity import bigram_jaccard, jaro_winkler, jaro_winkler_many, jw
from streetwise.operators.scoring import WEIGHTS, check_weights


def test_jaro_winkler_equals_duckdb_bit_for_bit():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("ABCDE ") for _ in range(rng.randint(0, 14)))
    a = [word() for _ in range(5000)]
    b = [word() if rng.random() < 0.5 else "".join(c for c in x if rng.random() < 0.8) for x in a]
    pairs = pd.DataFrame({"a": a, "b": b})  # noqa: F841
    want = duckdb.sql("SELECT jaro_winkler_similarity(a, b) AS s FROM pairs").df().s.to_numpy()
    assert (jaro_winkler_many(a, b) == want).all()


def test_jaro_winkler_variants():
    assert jaro_winkler("MAIN", "MAPLE") == pytest.approx(0.6333, abs=1e-4)
    assert jaro_winkler("MUSGRAVE", "MUSGRADE") == pytest.approx(0.95)
    assert jaro_winkler("", "") == 0.0
    assert jaro_winkler("RODE", "ROAD", None) == pytest.approx(0.8667, abs=1e-4)


def test_columns(spark):
    df = spark.createDataFrame([("MAIN", "MAIN"), (None, "X"), ("A", "B")], "a string, b string")
    got = [tuple(r) for r in df.select(jw(F.col("a"), F.col("b")), bigram_jaccard(F.col("a"), F.col("b"))).collect()]
    assert got == [(1.0, 1.0), (None, None), (0.0, None)]


def test_lexicon():
    assert (len(lex.STREET_TYPES), len(set(lex.STREET_TYPES.values())), len(lex.FLAT_TYPES)) == (134, 77, 20)
    assert lex.STREET_TYPES["CDS"] == "CUL-DE-SAC" and "CUL-DE-SAC" not in lex.STREET_TYPES
    assert lex.shortest_spelling()["STREET"] == "ST"


def test_geo_suffix(spark):
    rows = spark.createDataFrame([("X QLD 4000",), ("X 4000 QLD",), ("X QLD",), ("X 4000",), ("X",)], "t string")
    got = [tuple(r[0]) for r in rows.select(tx.geo_suffix(F.col("t"))).collect()]
    assert got == [("QLD", 4000, "X"), ("QLD", 4000, "X"), ("QLD", None, "X"), (None, 4000, "X"), (None, None, "X")]


@pytest.mark.parametrize("bad", [{"postcode": 100}, WEIGHTS | {"flat": -5, "type": 20}, WEIGHTS | {"flat": 6}, WEIGHTS | {"flat": "5"}, [1, 2]])
def test_weights_are_checked(bad):
    with pytest.raises(ValueError):
        check_weights(bad)
