"""Goldens of the score's parts, and messy inputs end to end."""

import pytest

from streetwise.operators import matching
from streetwise.operators.scoring import SCORES, check_weights, with_scores
from streetwise.sources.store import AddressStore

BASE = {"in_postcode": 4000, "postcode": 4000, "in_locality": "BRISBANE", "locality_name": "BRISBANE", "in_street_name": "MAIN", "street_name": "MAIN", "in_street_type": "STREET", "street_type": "STREET",
        "in_number_first": 10, "in_number_suffix": None, "number_first": 10, "number_last": None, "in_flat_number": None, "flat_number": None, "address_label": "10 MAIN STREET, BRISBANE QLD 4000"}
TYPES = {"in_postcode": "int", "postcode": "int", "in_number_first": "int", "number_first": "int", "number_last": "int"}
POSTCODE, SUBURB, STREET, TYPE, NUMBER, FLAT = SCORES
#: Changes of the pair, part of the score, its value. The values are fixed.
CASES = [
    ({}, POSTCODE, 20), ({"postcode": 4001}, POSTCODE, 14), ({"postcode": 3998}, POSTCODE, 8), ({"postcode": 4003}, POSTCODE, 4), ({"postcode": 4004}, POSTCODE, 0), ({"in_postcode": None}, POSTCODE, 0),
    ({}, SUBURB, 15), ({"in_locality": None}, SUBURB, 0), ({}, STREET, 40), ({"in_street_name": None}, STREET, 0), ({"in_street_name": "MIAN"}, STREET, 37),
    ({}, TYPE, 10), ({"in_street_type": None, "street_type": None}, TYPE, 10), ({"in_street_type": None}, TYPE, 5), ({"in_street_type": "LANE"}, TYPE, 4),
    ({}, NUMBER, 10), ({"number_first": 8, "number_last": 12}, NUMBER, 7), ({"in_number_first": None}, NUMBER, 0), ({"number_first": 9}, NUMBER, 0),
    ({"in_number_suffix": "A", "number_first": None, "address_label": "10A MAIN STREET"}, NUMBER, 10), ({"in_number_suffix": "A"}, NUMBER, 0),
    ({}, FLAT, 5), ({"in_flat_number": "3"}, FLAT, 0), ({"in_flat_number": " 3", "flat_number": "3 "}, FLAT, 5),
]


def scored(spark, changes, **kw):
    schema = ", ".join(f"{c} {TYPES.get(c, 'string')}" for c in BASE)
    return with_scores(spark.createDataFrame([tuple((BASE | c).values()) for c in changes], schema), **kw).collect()


def test_parts(spark):
    rows = scored(spark, [c[0] for c in CASES])
    assert [r[part] for r, (_, part, _) in zip(rows, CASES, strict=True)] == [c[2] for c in CASES]
    assert rows[0]["total_score"] == 100


def test_rounding_of_the_block_paths_and_of_the_exact_path(spark):
    weights = {"postcode": 15, "suburb": 15, "street": 45, "type": 5, "number": 15, "flat": 5}
    change = [{"postcode": 4001}]
    assert scored(spark, change, weights=weights)[0][POSTCODE] == 11  # 10.5 away from zero
    assert scored(spark, change, weights=weights, strict=False)[0][POSTCODE] == 10  # to even
    for wrong in ({**weights, "flat": 6}, {**weights, "flat": -5, "type": 15}, {k: v for k, v in weights.items() if k != "flat"}, [1]):
        with pytest.raises(ValueError):
            check_weights(wrong)


#: Records, and inputs with the record (by its place) that they mean. Fixed values.
RECORDS = [
    (None, 25, None, "SAINT JAMES", "COURT", "EAGLE HEIGHTS", 4272), (None, 110, 120, "MUSGRAVE", "ROAD", "RED HILL", 4059), ("6019", 6, None, "PARKLAND", "BOULEVARD", "BRISBANE CITY", 4000),
    (None, 2641, None, "THE ADDRESS", None, "HOPE ISLAND", 4212), (None, 1235, None, "TAMBORINE - OXENFORD", "ROAD", "WONGAWALLAN", 4210), ("6020", 6, None, "PARKLAND", "BOULEVARD", "BRISBANE CITY", 4000),
    (None, 4, None, "CRESCENT", "ROAD", "KELVIN GROVE", 4059),
]
MESSY = [
    ("25 ST JAMES CR EAGLE HEIGHTS QLD 4271", 0), ("25 ST JAMES CR EAGLE HEIGHTS 4271 QLD", 0), ("110-120 MUSGRADE RD RED HILL QLD 4060", 1), ("112 MUSGRAVE RD RED HILLS QLD 4059", 1),
    ("PARLAND 6019/6 PARKLAND BVD BRISBANE QLD 4001", 2), ("PARLAND 6019 6 PARKLAND BVD BRISBANE QLD 4001", 2), ("U6019 6 PARKLAND BVD BRISBANE QLD 4001", 2), ("2641 THE ADDRESS, HOPE ISLANDS QLD 4212", 3),
    ("1235 TAMBORINE - OXENFORD RD, WONGAWALLAN QLD 4210", 4), ("1235 TAMBORINE-OXENF RD, WONGAWALLAN QLD 4210", 4), ("1235 TAMBORINE-OXENFORD RD, WONGAWALLAN QLD 4210", 4), ("1235 TAMBORINE RD, WONGAWALLAN QLD 4210", 4),
    ("2641 THE ADDRESS, SANTUARY COVE QLD 4212", 3), ("6020 6 PARKLAND BVD BRISBANE CITY QLD 4001", 5), ("6020/6 PARKLAND BVD BRISBANE CITY QLD 4000", 5), ("6020 6 PARKLANDS ST BRISBANE CITY QLD 4000", 5),
    ("6020/6 PARKLANDS BVD BRISBANE CITY QLD 4000", 5), ("UNIT 6020/6 PARKLAND BVD BRISBANE CITY QLD 4000", 5), ("112 MUSGRAVE RD PADDINGTON QLD 4059", 1),
]
MORE = [
    ("4 CRESCENT RD, KELVIN GROVE QLD 4059", 6), ("U10 BLAH 6019 6 parkland bvd brisbane city QLD 4000", 2), ("U1 BLAH 6019 6 parkland bvd brisbane city QLD 4000", 2), ("6 UNIT 6019 parkland bvd brisbane city QLD 4000", 2),
    ("U10 BLAH UNIT 6019 6 parkland bvd brisbane city QLD 4000", 2), ("5 BLIND ROAD UNIT 6019 6 parkland bvd brisbane city QLD 4000", 2), ("U6019 6 parkland bvd brisbane city QLD 4000", 2), ("UNIT 6019/6 parkland bvd brisbane city QLD 4000", 2), ("UNIT 6019 6 parkland bvd brisbane city QLD 4000", 2),
]


def test_messy_inputs_find_their_records(spark):
    """Also without their state."""
    label = lambda f, n, m, s, t, loc, pc: " ".join(x for x in [f"UNIT {f}" if f else "", f"{n}-{m}" if m else str(n), s, t or ""] if x) + f", {loc} QLD {pc}"
    rows = [(f"P{i}", label(*r), "UNIT" if r[0] else None, r[0], r[1], r[2], r[3], r[4], r[5], "QLD", r[6]) for i, r in enumerate(RECORDS)]
    store = AddressStore(spark)
    store.add_custom(spark.createDataFrame(rows, "address_detail_pid string, address_label string, flat_type string, flat_number string, number_first int, number_last int, street_name string, street_type string, locality_name string, state string, postcode int"))
    inputs = MESSY + [(t.replace(" QLD", ""), i) for t, i in MESSY] + MORE
    out = store.match([t for t, _ in inputs])
    got = {r["input_id"]: r["address_detail_pid"] for r in out.collect()}
    matching.release(out)
    wrong = [(t, got[k], f"P{i}") for k, (t, i) in enumerate(inputs, 1) if got[k] != f"P{i}"]
    assert wrong == []
