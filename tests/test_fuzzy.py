"""Bounds of Jaro-Winkler, the index of names, and paths that compare few pairs, against a look at all."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from streetwise.functions.bounds import jw_at_most, signature
from streetwise.functions.similarity import jaro_winkler_many, jw
from streetwise.operators import matching as m
from streetwise.operators.fuzzy import near_names

LETTERS = "ABCDEÉ 1-x"


def names(rng, n):
    return {"".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 14))) for _ in range(n)}


def typo(rng, s):
    s = list(s)
    for _ in range(rng.randint(0, 3)):
        k = rng.randrange(len(s) + 1)
        s[k : k + rng.randint(0, 1)] = rng.choice([[], [rng.choice(LETTERS)]])
    return "".join(s)


@pytest.fixture(scope="module")
def two(spark):
    rng = random.Random(1)
    a = names(rng, 100)
    b = names(rng, 60) | {typo(rng, rng.choice(sorted(a))) for _ in range(150)} | {"A" * 14, "AAAAAB"}
    return sorted(a), sorted(b)


def test_no_similarity_is_over_its_bound(spark, two):
    pairs = spark.createDataFrame([*itertools.product(*two), (None, "A"), ("A", None)], "a string, b string").withColumn("sa", signature("a")).withColumn("sb", signature("b"))
    got = pairs.select(jw(F.col("a"), F.col("b")).alias("j"), jw_at_most("a", "b", "sa", "sb").alias("u")).toPandas()
    known = got.dropna()
    assert len(got) - len(known) == 2 and (known["u"] >= known["j"]).all()
    assert known["u"].mean() < 0.75  # and it says something


@pytest.mark.parametrize("least", [0.85, 0.75, 0.95])
def test_near_names_are_all_near_names(spark, two, least):
    a, b = two
    asked = spark.createDataFrame([(1, x) for x in a] + [(None, "AB"), (1, None), (3, "AB")], "block int, asked string")
    there = spark.createDataFrame([(1, x) for x in b] + [(2, "AB"), (1, None), (None, "AB")], "block int, name string")
    out = near_names(asked, there, least)
    got = sorted((r["asked"], r["name"]) for r in out.collect())
    pairs = list(itertools.product(a, b))
    alike = jaro_winkler_many([p[0] for p in pairs], [p[1] for p in pairs])
    assert got == sorted(p for p, s in zip(pairs, alike, strict=True) if s >= least)
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError, match="over 0.7"):
        near_names(asked, there, 0.7)


@pytest.fixture(scope="module")
def town(spark):
    """Records and inputs with odd parts: no number, no street, ties, ranges, letters."""
    rng = random.Random(8)
    street = lambda: rng.choice(["HIGH", "HIGHER", "HIGHLAND", "MARY", "MAREE", "QUEEN", "QUEENS", "KING", "KINGSTON", "ÉCOLE", "OAK TREE"])
    town = lambda: rng.choice(["RED HILL", "RED HIL", "BARDON", "OXLEY", "EAST OXLEY"])
    records = []
    for i in range(900):
        n, s, t, c = rng.choice([None, *range(1, 12)]), rng.choice([street(), None]), town(), 4000 + rng.randrange(6)
        records.append((f"P{i:04d}", f"{n or 5}{'' if n else 'A'} {s or ''} STREET, {t}", n, n + 6 if n and i % 9 == 0 else None, s, rng.choice(["STREET", None, "ROAD"]), rng.choice([None, "1"]), t, rng.choice(["QLD", "NSW", None]), c))
    inputs = [(i, rng.choice([None, *range(1, 12)]), rng.choice([None, None, "A"]), rng.choice([street(), typo(rng, street()), None, ""]), rng.choice(["STREET", None]), rng.choice([None, "1"]), rng.choice([town(), None]), rng.choice(["QLD", "NSW", None]), rng.choice([4000 + rng.randrange(8), None])) for i in range(250)]
    a = spark.createDataFrame(records, "address_detail_pid string, address_label string, number_first int, number_last int, street_name string, street_type string, flat_number string, locality_name string, state string, postcode int")
    b = spark.createDataFrame(inputs, "input_id int, in_number_first int, in_number_suffix string, in_street_name string, in_street_type string, in_flat_number string, in_locality string, in_state string, in_postcode int")
    return m.inputs_of(b).cache(), m.candidates_of(a).cache()


@pytest.mark.parametrize(("k", "floor", "tries"), [(1, 60, 8), (3, 20, 1)])
def test_bounded_paths_find_what_plain_ones_find(spark, town, monkeypatch, k, floor, tries):
    monkeypatch.setattr(m, "FIRST_TRIES", tries)
    inputs, addresses = town
    index = m.locality_index(addresses)
    rows = lambda df: sorted((r["input_id"], r["match_rank"], r["address_detail_pid"], r["total_score"]) for r in df.collect())
    for path in (m.postcode_path, m.state_path, lambda *a, **kw: m.locality_path(*a[:2], index, **kw)):
        plain, bounded = (rows(path(inputs, addresses, max_results=k, min_score=floor, bounded=b)) for b in (False, True))
        assert len(plain) > 20 and plain == bounded


def test_few_pairs_are_compared(spark, town, monkeypatch):
    inputs, addresses = town
    compared, exactly = [], m._exactly

    def counted(pairs, *rest):
        compared.append(pairs.count())
        return exactly(pairs, *rest)

    monkeypatch.setattr(m, "_exactly", counted)
    m.state_path(inputs, addresses, bounded=False)
    plain, compared[:] = sum(compared), []
    m.state_path(inputs, addresses, bounded=True)
    assert sum(compared) < plain / 2


def test_localities_as_by_a_look_at_all(spark, town):
    inputs, addresses = town
    index = m.locality_index(addresses)
    by_all = set()
    places, asked = [tuple(r) for r in index.collect()], inputs.collect()
    for r in asked:
        by_all |= {(r["input_id"], r["in_postcode"] + o) for o in m.OFFSETS if r["in_postcode"] is not None}
        if r["in_locality"] is not None:
            # A name's postcodes serve every input that has it, whatever state that one names.
            states = {x["in_state"] for x in asked if x["in_locality"] == r["in_locality"]}
            for name, code, state in places:
                if jaro_winkler_many([name], [r["in_locality"]])[0] >= 0.85 and any(s is None or s == state for s in states):
                    by_all.add((r["input_id"], code))
    out = m.near_postcodes(inputs, index)
    assert {(r["input_id"], r["alt_postcode"]) for r in out.collect()} == by_all
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()


def test_broadcast_is_by_bytes(spark):
    few, wide = spark.range(10).withColumn("t", F.lit("x")), spark.range(10).withColumn("t", F.repeat(F.lit("x"), 2_000_000))
    assert m.measured(few) == (10, True) and m.measured(wide) == (10, False)
