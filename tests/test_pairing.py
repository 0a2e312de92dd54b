"""Bounded groups of pairs, against paths that compare all pairs as rows."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from streetwise.functions import similarity
from streetwise.functions.similarity import Names, jaro_winkler_many
from streetwise.operators import matching as m
from streetwise.operators import pairing
from streetwise.operators.diagnostics import add_text_diagnostics
from streetwise.plans.catalogue import name_pairs

from .test_fuzzy import town  # noqa: F401

RECORD = "address_detail_pid string, address_label string, number_first int, number_last int, street_name string, street_type string, flat_number string, locality_name string, postcode int, alias_type string"


def rows(df):
    return sorted(tuple(r[c] for c in ("input_id", "match_rank", "address_detail_pid", "total_score", *m.SCORES)) for r in df.collect())


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_names_are_compared_as_one_by_one():
    rng = random.Random(5)
    names = ["", "A"] + ["".join(rng.choice("ABCÉ 1-😀") for _ in range(rng.choice([3, 12, 63, 64, 65]))) for _ in range(150)]
    a, b = (np.array([rng.randrange(len(names)) for _ in range(4000)]) for _ in range(2))
    many = Names(names)
    for boost in (0.7, None):
        want = jaro_winkler_many([names[i] for i in a], [names[i] for i in b], boost)
        assert (many.alike(a, b, boost) == want).all()
    assert (many.at_most(a, b) >= jaro_winkler_many([names[i] for i in a], [names[i] for i in b])).all()


@pytest.mark.parametrize("k", [1, 3])
def test_keys_dealt_over_many_groups_give_the_same(spark, town, monkeypatch, k):  # noqa: F811
    for name, value in (("IN_ROWS", 7), ("OF_ROWS", 11), ("GROUP_ROWS", 40)):
        monkeypatch.setattr(pairing, name, value)
    inputs, addresses = town
    for path in (m.postcode_path, m.state_path):
        got = rows(path(inputs, addresses, max_results=k, min_score=30))
        assert len(got) > 50 and got == rows(path(inputs, addresses, max_results=k, min_score=30, bounded=False))


def test_wide_ranges_letters_and_copies(spark):
    records = [("P1", "5A HIGH ST", None, None), ("P2", "5AB HIGH ST", None, None), ("P3", "1 HIGH ST", 1, 900), ("P4", "1 HIGH ST", 1, 90_000), ("P5", "5 HIGH ST", 5, None), ("P6", "5 HIGH ST", 5, None), ("P7", None, None, None), (None, "5 HIGH ST", 5, None), ("P8", "5 HIGH ST", 5, 2)]
    of = spark.createDataFrame([(p, label, a, b, "HIGH", None, None, "OXLEY", 4000, "street_only") for p, label, a, b in records], RECORD)
    asked = spark.createDataFrame([(1, 5, None), (2, 5, "A"), (3, 700, None), (4, 70_000, None), (5, None, None), (6, None, "A"), (7, 5, None)], "input_id int, in_number_first int, in_number_suffix string")
    asked = m.inputs_of(asked.selectExpr("*", "'HIGH' AS in_street_name", "'OXLEY' AS in_locality", "4000 AS in_postcode"))
    of = m.candidates_of(of)
    for k in (1, 2, 20):
        assert rows(m.postcode_path(asked, of, k)) == rows(m.postcode_path(asked, of, k, bounded=False))
        assert rows(m.street_only_path(asked, of, k)) == rows(m.street_only_path(asked, of, k, bounded=False))


def test_paths_make_no_row_of_a_pair(spark, town):  # noqa: F811
    """As before a row for each pair of a block, these grew with the square of the tables."""
    inputs, addresses = town
    for path in (m.postcode_path, m.state_path, m.street_only_path):
        assert "FlatMapCoGroupsInArrow" in plan(path(inputs, addresses))


def test_records_of_few_files_are_dealt_over_tasks_before_they_get_keys(spark, town):  # noqa: F811
    inputs, addresses = town
    assert "RepartitionByExpression" in plan(m.postcode_path(inputs, addresses))


def test_names_of_a_group_are_compared_once_not_for_each_pair(monkeypatch):
    """Bounds of names were made anew for each pair of an input and a record."""
    compared = []
    for way in ("alike", "at_most"):
        plain = getattr(Names, way)
        monkeypatch.setattr(Names, way, lambda self, a, b, *boost, plain=plain: compared.append(len(a)) or plain(self, a, b, *boost))
    names, n, m_ = [f"{x} {y}" for x in ("HIGH", "LOW", "OLD", "NEW") for y in ("HILL", "RIDGE", "BANK", "PLAIN", "END")], 200, 2000
    both = lambda size: {"_sub": ["s"] * size, "_kind": ["any"] * size}
    asked = pa.table({"input_id": range(n), "in_street_name": [names[i % 20][:-1] for i in range(n)], "in_locality": ["OXLEY"] * n, "in_street_type": ["ROAD"] * n, "in_flat_number": [str(i // 20) for i in range(n)], "in_postcode": [4000] * n, "in_number_first": pa.nulls(n, pa.int32()), "in_number_suffix": pa.nulls(n, pa.string()), **both(n)})
    of = pa.table({"address_detail_pid": [f"A{i:04d}" for i in range(m_)], "address_label": ["X"] * m_, "number_first": [1] * m_, "number_last": [1] * m_, "street_name": [names[i % 20] for i in range(m_)], "street_type": ["ROAD"] * m_, "flat_number": [str(i // 20) for i in range(m_)], "locality_name": ["OXLEY"] * m_, "postcode": [4000] * m_, **both(m_)})
    schema = pa.schema([("input_id", pa.int64()), ("address_detail_pid", pa.string()), *[(s, pa.int32()) for s in [*m.SCORES, "total_score"]]])
    out = pairing._best_of_group(asked, of, 1, 9, 60, m.check_weights(None), True, m.LEAST_STREET, schema)
    assert out["address_detail_pid"].to_pylist() == [f"A{i:04d}" for i in range(n)]
    assert sum(compared) <= 20 * 20 + 1


def many_names(n, m_, keys=2, seed=3):
    """Inputs without a number and records of some keys, nearly all with a street of their own; some inputs have none."""
    rng = random.Random(seed)
    words, ends = ("LARGE RING", "HOT BOLT", "BLUE PLATE", "COLD GEAR", "OLD SCREW", "GREEN WASHER", "TINY", "É"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    streets = [f"{rng.choice(words)} {rng.choice(ends)}{rng.choice(ends)}{rng.choice(ends)}" for _ in range(m_)]
    both = lambda size: {"_sub": [str(i % keys) for i in range(size)], "_kind": ["any"] * size}
    asked = pa.table({"input_id": range(n), "in_street_name": [None if i % 29 == 0 else streets[rng.randrange(m_)][: rng.choice([-1, None])] for i in range(n)], "in_locality": [rng.choice(["OXLEY", "OXLE", None]) for _ in range(n)], "in_street_type": [rng.choice(["ROAD", "LANE", None]) for _ in range(n)], "in_flat_number": [rng.choice(["1", None]) for _ in range(n)], "in_postcode": [rng.choice([4000, 4001, None]) for _ in range(n)], "in_number_first": pa.nulls(n, pa.int32()), "in_number_suffix": pa.nulls(n, pa.string()), **both(n)})
    of = pa.table({"address_detail_pid": [f"A{i:05d}" for i in range(m_)], "address_label": ["X"] * m_, "number_first": [1] * m_, "number_last": [1] * m_, "street_name": [None if i % 41 == 0 else s for i, s in enumerate(streets)], "street_type": [rng.choice(["ROAD", "LANE"]) for _ in range(m_)], "flat_number": [rng.choice(["1", "2", None]) for _ in range(m_)], "locality_name": [rng.choice(["OXLEY", "INALA"]) for _ in range(m_)], "postcode": [rng.choice([4000, 4002]) for _ in range(m_)], **both(m_)})
    return asked, of


def best_of(asked, of, k, floor):
    schema = pa.schema([("input_id", pa.int64()), ("address_detail_pid", pa.string()), ("street_name", pa.string()), *[(s, pa.int32()) for s in [*m.SCORES, "total_score"]]])
    out = sorted(pairing._best_of_group(asked, of, k, k + m.FIRST_TRIES, floor, m.check_weights(None), True, m.LEAST_STREET, schema).to_pylist(), key=lambda r: (r["input_id"], -r["total_score"], r["address_detail_pid"]))
    rank = {}
    return [r for r in out if rank.setdefault(r["input_id"], []).append(0) or len(rank[r["input_id"]]) <= k]


@pytest.mark.parametrize("k,floor", [(1, 60), (3, 40), (5, 0)])
def test_runs_of_names_leave_the_same_best_as_a_table_of_all(monkeypatch, k, floor):
    asked, of = many_names(150, 900, keys=1)
    found = []
    for table in (0, 1 << 30):
        monkeypatch.setattr(pairing, "TABLE", table)
        monkeypatch.setattr(pairing, "RUN", 7)
        found.append(best_of(asked, of, k, floor))
    assert found[0] == found[1] and len(found[0]) >= 120


def test_bounds_of_names_are_not_made_for_each_pair(monkeypatch):
    """Where nearly every record had a street of its own, each input's name met each of them."""
    compared = []
    for way in ("alike", "at_most"):
        plain = getattr(Names, way)
        monkeypatch.setattr(Names, way, lambda self, a, b, *more, plain=plain, **named: compared.append(len(a)) or plain(self, a, b, *more, **named))
    asked, of = many_names(600, 6000)
    known = asked.filter(asked["in_locality"].is_valid())
    known = known.set_column(known.column_names.index("in_postcode"), "in_postcode", pa.array([4000] * len(known)))
    of = of.set_column(of.column_names.index("postcode"), "postcode", pa.array([4000] * len(of)))
    of = of.set_column(of.column_names.index("locality_name"), "locality_name", pa.array(["OXLEY"] * len(of)))
    known = known.filter(known["in_street_name"].is_valid())
    assert len(best_of(known, of, 1, 60)) == len(known)
    assert sum(compared) < len(known) * len(of) / 2 / 3


def test_runs_bound_all_their_names():
    rng = random.Random(8)
    names = sorted({"", *("".join(rng.choice("ABCÉ 1-😀") for _ in range(rng.choice([1, 3, 12, 30, 65, 80]))) for _ in range(300))})
    many, at = Names(names), np.array([-1, *range(len(names))])
    start = np.arange(0, len(at), 5)
    runs = similarity.Runs(many, at, start)
    a, b = (x.ravel() for x in np.meshgrid(np.arange(len(names)), np.arange(len(at))))
    a, b = a[at[b] >= 0], b[at[b] >= 0]
    assert (many.at_most(a, b // 5, of=runs) >= many.alike(a, at[b])).all()


def test_pairs_of_names_meet_as_different_names(spark, town):  # noqa: F811
    inputs, addresses = town
    once, thrice = (sorted(map(str, name_pairs(inputs, of).collect())) for of in (addresses, addresses.union(addresses).union(addresses)))
    assert once == thrice and len(once) > 100
    below = plan(name_pairs(inputs, addresses)).split("Join", 1)[1]
    assert below.count("Aggregate") == 2


def test_a_text_is_made_once_for_its_bigrams(spark):
    """Inside the function over places it was made anew for each place."""
    df = spark.createDataFrame([("High St", "HIGH STREET"), ("A", None)], "input_raw string, address_label string")
    out = add_text_diagnostics(df)
    from_text = similarity.bigram_jaccard(F.upper("input_raw"), F.upper("address_label"))._jc.toString()
    assert from_text.lower().count("upper(input_raw") <= 2
    assert [r["text_jaccard"] for r in out.collect()][1] is None
