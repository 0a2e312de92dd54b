"""Parser cases: one text to the fields that matter in it; the quick grammar's two forms."""

import random

import pytest

from streetwise.operators.parser import FIELDS, normalise, parse_addresses, parse_text, with_quick

NAMES = {"pc": "in_postcode", "st": "in_state", "loc": "in_locality", "name": "in_street_name", "type": "in_street_type", "dir": "in_street_suffix", "n": "in_number_first", "to": "in_number_last", "sfx": "in_number_suffix", "ft": "in_flat_type", "fn": "in_flat_number", "bld": "in_building_name"}
TM = {"loc": "TAMBORINE MOUNTAIN", "st": "QLD", "pc": 4272}
PARK = {"fn": "6019", "n": 6, "name": "PARKLAND", "type": "BOULEVARD"}
CASES = [
    ("25 SAINT JAMES CT, TAMBORINE MOUNTAIN QLD 4272", {"n": 25, "name": "SAINT JAMES", "type": "COURT", "ft": None} | TM),
    ("25 St James Rd, Tamborine Mountain QLD 4272", {"n": 25, "name": "SAINT JAMES", "type": "ROAD"} | TM),
    ("12 Kings Street, Sydney NSW 2000", {"name": "KINGS", "type": "STREET"}),
    ("50 Murray Tce, Adelaide SA 5000", {"name": "MURRAY", "type": "TERRACE", "st": "SA"}),
    ("25 Saint James Ct Tamborine Mountain QLD 4272", {"n": 25, "name": "SAINT JAMES"} | TM),
    ("25 saint james ct, tamborine mountain qld 4272", {"type": "COURT"} | TM),
    ("3/25 Saint James Ct, Tamborine Mountain QLD 4272", {"ft": "UNIT", "fn": "3", "n": 25, "name": "SAINT JAMES"}),
    ("UNIT 3 25 Smith St, Sydney NSW 2000", {"ft": "UNIT", "fn": "3", "n": 25, "name": "SMITH"}),
    ("APT 4 10 Main Rd, Melbourne VIC 3000", {"ft": "APARTMENT", "fn": "4", "n": 10}),
    ("U3 25 Smith St, Sydney NSW 2000", {"ft": "UNIT", "fn": "3", "n": 25, "name": "SMITH"}),
    ("110-120 Musgrave Rd, Red Hill QLD 4059", {"n": 110, "to": 120, "name": "MUSGRAVE"}),
    ("25 Saint James Ct, Tamborine Mountain QLD", {"st": "QLD", "pc": None, "loc": "TAMBORINE MOUNTAIN"}),
    ("25 Saint James Ct, Tamborine Mountain 4272", {"st": None, "pc": 4272, "loc": "TAMBORINE MOUNTAIN"}),
    ("10 Oak St. Sydney NSW 2000", {"n": 10, "name": "OAK", "type": "STREET", "loc": "SYDNEY"}),
    ("190 MUSGRAVE RED HILL QLD 4059", {"n": 190, "name": "MUSGRAVE", "type": None, "loc": "RED HILL", "pc": 4059}),
    ("190 MUSGRAVE QLD 4059", {"n": 190, "name": "MUSGRAVE", "loc": None}),
    ("190A MUSGRAVE RD RED HILL QLD 4059", {"n": 190, "sfx": "A", "name": "MUSGRAVE", "loc": "RED HILL"}),
    ("UNIT 3 190A MUSGRAVE RD RED HILL QLD 4059", {"fn": "3", "n": 190, "sfx": "A"}),
    ("U10 BLAH 6019 6 parkland bvd brisbane city QLD 4000", PARK | {"ft": "UNIT"}),
    ("6 UNIT 6019 parkland bvd brisbane city QLD 4000", PARK | {"ft": "UNIT"}),
    ("U10 BLAH UNIT 6019 6 parkland bvd brisbane city QLD 4000", PARK | {"bld": "U10 BLAH"}),
    ("5 BLIND ROAD UNIT 6019 6 parkland bvd brisbane city QLD 4000", PARK),
    ("U6019 6 parkland bvd brisbane city QLD 4000", PARK | {"loc": "BRISBANE CITY"}),
    ("UNIT 6019 6 parkland bvdz, brisbane city QLD 4000", PARK | {"loc": "BRISBANE CITY"}),
    ("25 St James Rode, Tamborine Mountain QLD 4272", {"n": 25, "name": "SAINT JAMES", "type": "ROAD"} | TM),
    ("1 Smith STX, Brisbane QLD 4000", {"name": "SMITH", "type": "STREET", "loc": "BRISBANE"}),
    ("UNIT 5, 10 Smith St, Brisbane QLD 4000", {"fn": "5", "n": 10, "name": "SMITH", "type": "STREET"}),
    ("F8 536 BEACONSFIELD TERRACE, BRIGHTON QLD 4017", {"ft": "FLAT", "fn": "8", "n": 536, "name": "BEACONSFIELD"}),
    ("A6 536 BEACONSFIELD TERRACE, BRIGHTON QLD 4017", {"ft": "APARTMENT", "fn": "6", "n": 536}),
    ("D2 536 BEACONSFIELD TERRACE, BRIGHTON QLD 4017", {"ft": "UNIT", "fn": "2", "n": 536}),
    ("36 A1 TAVISTOCK ST, TORQUAY QLD 4655", {"ft": "APARTMENT", "fn": "1", "n": 36, "name": "TAVISTOCK"}),
    ("5 MT GRAVATT RD, MT GRAVATT QLD 4122", {"name": "MOUNT GRAVATT", "loc": "MOUNT GRAVATT"}),
    ("5 MNT VIEW DR, MNT ISA QLD 4825", {"name": "MOUNT VIEW", "loc": "MOUNT ISA"}),
    ("10 ST JAMES CT, ST LUCIA QLD 4067", {"name": "SAINT JAMES", "loc": "SAINT LUCIA"}),
    ("1 NTH QUAY ST, STH BRISBANE QLD 4101", {"name": "NORTH QUAY", "loc": "SOUTH BRISBANE"}),
    ("1 N SHORE DR, W END QLD 4101", {"name": "NORTH SHORE", "loc": "WEST END"}),
    ("12 MOUNTAIN CK RD, MOUNTAIN CREEK QLD 4557", {"name": "MOUNTAIN CREEK"}),
    ("5 1ST AVE, BROADBEACH QLD 4218", {"name": "FIRST", "type": "AVENUE"}),
    ("5 12TH ST, SOUTH BRISBANE QLD 4101", {"name": "TWELFTH", "type": "STREET"}),
    ("4000 SMITH STREEET BRISBANE QLD 4000", {"n": 4000, "pc": 4000, "type": "STREET"}),
    ("unit 5 18-20 drift cl goldsborough 4865", {"fn": "5", "n": 18, "to": 20, "name": "DRIFT", "loc": "GOLDSBOROUGH", "pc": 4865}),
    ("Mt Gravatt East", {"loc": "GRAVATT EAST"}),
]


@pytest.mark.parametrize("text,want", CASES)
def test_fields(text, want):
    got = parse_text(text)
    assert {k: got[NAMES[k]] for k in want} == want


def test_without_expansion():
    got = parse_text("10 ST JAMES CT, ST LUCIA QLD 4067", normalised=False)
    assert (got["in_street_name"], got["in_locality"]) == ("ST JAMES", "ST LUCIA")
    assert parse_text("Mt Gravatt East", normalised=False)["in_locality"] == "GRAVATT EAST"


@pytest.mark.parametrize("text", [None, "", "   ", ",,."])
def test_blank(text):
    assert parse_text(text) == dict.fromkeys(FIELDS)


def test_normalise_unglues_but_keeps_ordinals():
    cases = {"25ST JAMES": "25 ST JAMES", "1ST AVE": "1ST AVE", "11ST": "11 ST", "11TH": "11TH", "13RD": "13 RD", "21ST": "21ST", "3RDX": "3 RDX", "190A X": "190A X"}
    assert {k: normalise(k) for k in cases} == cases


PIECES = (
    "25|3/25|U3|UNIT 5|APT 4A|A|F8|110-120|190A|12A-14B|1ST|12TH|5,|LOT 7|36 A1|99999999999|0|6019|2000|4000|St|Rd|Court|grove|Parkland|bvd|Bvdz|Smith|Mt|MNT|N|W|North|SOUTH|nth|qld|NSW|VIC|4272|ST JAMES|"
    "Mount Gravatt|CK|& Co|Tower|U10|Shop 3|x|-|/|'|(rear)|é|ſt|\xa0|\t|_|St.|,|.|UNITS|O'Brien|10/12-14|B/7 9|3/ 25|25ST|\x1f"
).split("|")


def generated(n):
    rng = random.Random(11)
    out = [" ".join(rng.choice(PIECES) for _ in range(rng.randint(0, 9))) for _ in range(n)]
    one = lambda *words: rng.choice(words)
    out += [f"{one('25', '3/25', 'U3 25', 'UNIT 5 18-20', '190A', '36 A1', 'Tower 3/25', 'A/3 9')} {one('SMITH', 'ST JAMES', '1ST', 'MT & B', '')} {one('ST', 'RD', 'WAY NORTH')}{one(',', '')} {one('BRISBANE', 'NORTH QUAY', 'W END')} {one('QLD', 'QLD 4000', '2000 NSW', '4000', '')}" for _ in range(n)]
    return [None, "", " ", ",,.", "12 " + "A " * 5000 + "ST X", *out, *[c[0] for c in CASES]]


@pytest.mark.parametrize("normalised", [True, False])
def test_quick_grammar_has_two_forms_that_agree(spark, normalised):
    texts = generated(1500)
    df = spark.createDataFrame(list(enumerate(texts)), "input_id int, input_raw string").repartition(4)
    got = {r["input_id"]: r["quick"] for r in with_quick(df, "input_raw", normalised=normalised).collect()}
    claimed = {i: q.asDict() for i, q in got.items() if q is not None}
    assert len(claimed) > 1000
    assert claimed == {i: parse_text(texts[i], normalised) for i in claimed}
    both = {r["input_id"]: r.asDict() for r in parse_addresses(df, normalised=normalised, native=True).collect()}
    assert {i: {k: r[k] for k in FIELDS} for i, r in both.items()} == {i: parse_text(t, normalised) for i, t in enumerate(texts)}


def test_quick_grammar_runs_without_python(spark):
    df = spark.createDataFrame([(1, "3/25 St James Rd, Red Hill QLD 4059", "kept"), (2, "é 1 Smith St", None)], "id int, text string, quick_ string")
    out = with_quick(df, "text")
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString().replace("existing", "")
    rows = {r["id"]: r for r in out.collect()}
    assert rows[1]["quick"]["in_street_name"] == "SAINT JAMES" and rows[1]["quick_"] == "kept" and rows[2]["quick"] is None


def test_texts_of_few_files_are_dealt_over_tasks(spark):
    """One file of texts was parsed by one task."""
    df = spark.range(0, 50, 1, 1).selectExpr("id AS input_id", "concat(id + 1, ' 2nd Mt View St, Oxley QLD 4075') AS input_raw")
    out = parse_addresses(df)
    assert "RepartitionByExpression" in out._jdf.queryExecution().optimizedPlan().toString()
    assert {r["in_street_name"] for r in out.collect()} == {"SECOND MOUNT VIEW"}
