"""The store end to end, with the demo records."""

import pytest
from pyspark.sql import functions as F

from streetwise.operators import matching, perturb, spatial, tables
from streetwise.sources.store import AddressStore, write_csv
from streetwise.streaming.incremental import match_stream

DEMO = [
    ("10 MUSGRAVE ROAD, RED HILL QLD 4059", 10, None, "MUSGRAVE", "ROAD", "RED HILL", "QLD", 4059),
    ("120 MUSGRAVE ROAD, RED HILL QLD 4059", 120, None, "MUSGRAVE", "ROAD", "RED HILL", "QLD", 4059),
    ("18-20 DRIFT CLOSE, GOLDSBOROUGH QLD 4865", 18, 20, "DRIFT", "CLOSE", "GOLDSBOROUGH", "QLD", 4865),
    ("13-27 FAIRWAY DRIVE, CLEAR ISLAND WATERS QLD 4226", 13, 27, "FAIRWAY", "DRIVE", "CLEAR ISLAND WATERS", "QLD", 4226),
    ("77 BROADWATER ROAD, MOUNT GRAVATT EAST QLD 4122", 77, None, "BROADWATER", "ROAD", "MOUNT GRAVATT EAST", "QLD", 4122),
]
SCHEMA = "address_label string, number_first int, number_last int, street_name string, street_type string, locality_name string, state string, postcode int"
GOLDEN = [
    ("unit 5 18-20 drift cl goldsborough 4865", 95, "matched"),
    ("10 Musgrave Road, Red Hill QLD 4059", 100, "matched"),
    ("10 Musgrave Road, Red Hill QLD 4058", 94, "matched"),
    ("999 Musgrave Road, Red Hill QLD 4059", None, "no_candidate"),
    ("13 Fairway Avenue, Clear Island Waters QLD 4226", 94, "matched"),
    ("15 Fairway Drive, Clear Island Waters QLD 4226", 97, "matched"),
    ("77 Broadwater Road, Mt Gravatt East QLD 9999", 80, "matched"),
    ("1 Nowhere Street, Fakesuburb QLD 9999", None, "no_candidate"),
    ("", None, "insufficient_parse"),
]


def test_golden_scores_cache_and_changes(spark, tmp_path):
    store = AddressStore(spark, str(tmp_path / "store"))
    assert store.list_tables() == ["addresses", "custom_addresses", "locality_index", "match_cache"]
    assert store.add_custom(spark.createDataFrame(DEMO, SCHEMA)) == (5, 0)
    inputs = spark.createDataFrame(list(enumerate([g[0] for g in GOLDEN], 1)), "input_id int, input_raw string")
    rows = store.match(inputs).collect()
    assert [(r["total_score"], r["match_status"]) for r in rows] == [g[1:] for g in GOLDEN]
    assert store.cache_status().first()["cached_rows"] == 3  # 95, 100 and 97
    again = store.match(inputs).collect()
    assert [r["total_score"] for r in again] == [r["total_score"] for r in rows]
    store.remove_custom(["CUSTOM_1"])
    assert store.table("custom_addresses").count() == 4
    assert store.cache_clear(confirm=True) == 3


def test_core_csv_is_loaded_once(spark, tmp_path):
    header = "ADDRESS_DETAIL_PID,DATE_CREATED,ADDRESS_LABEL,NUMBER_FIRST,STREET_NAME,STREET_TYPE,LOCALITY_NAME,STATE,POSTCODE,LONGITUDE,LATITUDE"
    (tmp_path / "core.csv").write_text(header + "\nP1,25-12-2020,1 A ST,1,A,ST,B,QLD,4000,153.1,-27.1\nP2,bad,2 A ST,x,A,AV,B,QLD,4000,,\nP1,25-12-2021,again,1,A,ST,B,QLD,4000,,\n")
    store = AddressStore(spark, str(tmp_path / "store"))
    assert store.load_core(str(tmp_path / "core.csv")) == 2
    assert store.load_core(str(tmp_path / "core.csv")) == 2
    rows = {r["address_detail_pid"]: r for r in store.table("addresses").collect()}
    assert (rows["P1"]["street_type"], rows["P2"]["street_type"], rows["P2"]["number_first"], rows["P2"]["date_created"]) == ("STREET", "AVENUE", None, None)
    assert store.build_street_aliases() == 2
    assert store.table("locality_index").count() == 1
    with pytest.raises(FileNotFoundError):
        store.load_core(str(tmp_path / "none.csv"))
    with pytest.raises(PermissionError):
        AddressStore(spark, str(tmp_path / "store"), read_only=True).rebuild_locality_index()


def test_perturbation_is_the_same_for_a_seed(spark):
    text = "UNIT 3 25 SAINT JAMES COURT, TAMBORINE MOUNTAIN QLD 4272"
    rows = spark.createDataFrame([(i, text) for i in range(30)] + [(30, "")], "k long, label string")
    damaged = lambda df: {r["k"]: (r["simulated_address"], r["perturbations"]) for r in perturb.perturbed(df, "label", F.col("k"), 7).collect()}
    once = damaged(rows)
    assert once == damaged(rows.repartition(5))
    assert once[30] == ("", "none")
    assert all(once[i][0] != text for i in range(30))


def test_polygons_with_hole_edge_and_null(spark):
    ring = lambda *ps: [(float(x), float(y)) for x, y in ps]
    shapes = spark.createDataFrame([(0, [ring((0, 0), (10, 0), (10, 10), (0, 10)), ring((4, 4), (6, 4), (6, 6), (4, 6))], "a"), (1, [ring((5, 5), (15, 5), (10, 15))], "b")], f"poly_idx int, rings {spatial.RINGS}, zone string")
    points = spark.createDataFrame([(1, 1.0, 1.0), (2, 5.0, 4.5), (3, 10.0, 3.0), (4, 9.0, 7.0), (5, None, 1.0), (6, 99.0, 99.0)], "id int, longitude double, latitude double")
    first = {r["id"]: r["zone"] for r in spatial.spatial_lookup(points, shapes).collect()}
    assert first == {1: "a", 2: None, 3: "a", 4: "a", 5: None, 6: None}
    every = sorted((r["id"], r["zone"] or "") for r in spatial.spatial_lookup(points, shapes, multiple="all").collect())
    assert every == [(1, "a"), (2, ""), (3, "a"), (4, "a"), (4, "b"), (5, ""), (6, "")]
    assert spatial.subset(shapes, "zone", ["a"], invert=True).count() == 1
    assert spatial.simplified([(0, 0), (1, 0.01), (2, 0)], 0.1) == [(0, 0), (2, 0)]


def test_versions_appends_and_cache_by_time(spark, tmp_path):
    store = AddressStore(spark, str(tmp_path / "store"))
    store.add_custom(spark.createDataFrame(DEMO, SCHEMA))
    at = lambda t: F.lit(t).cast("timestamp")
    for i, (text, day) in enumerate([(GOLDEN[1][0], "2024-01-01 10:00:00"), (GOLDEN[5][0], "2024-01-02 10:00:00"), (GOLDEN[1][0], "2024-01-03 10:00:00")]):
        matching.release(store.match([text], now=at(day)))
        assert store.table("match_cache").count() == (1, 2, 2)[i]
    said = store.history("match_cache").orderBy("version").collect()
    assert [(r["operation"], r["rows_added"], r["files_removed"]) for r in said] == [("create", 0, 0), ("match", 1, 0), ("match", 1, 0)]  # nothing was written again
    got = store.cache_sample(5, seed=1).collect()
    assert len(got) == 2 and {r["address_label"] for r in got} == {DEMO[0][0], DEMO[3][0]}
    assert store.cache_sample(5, cached_on="2024-01-01").count() == 1
    store.remove_custom(["CUSTOM_1"])
    assert store.cache_sample(5).count() == 1  # an entry whose record is gone is left out
    assert store.cache_rollback("2024-01-02 00:00:00", confirm=True) == 1
    assert store.table("match_cache").first()["input_standardised"].startswith("10 MUSGRAVE")
    with pytest.raises(ValueError):
        store.cache_rollback("2024-01-02")
    store.cache_clear(confirm=True)
    assert store.table("match_cache").count() == 0 and store.table("match_cache", version=2).count() == 2
    with pytest.raises(ValueError):
        store.match([])
    with pytest.raises(ValueError):
        store.match(spark.range(1))


def test_diagnostics_summary_and_column_order(spark, caplog):
    store = AddressStore(spark)
    store.add_custom(spark.createDataFrame(DEMO, SCHEMA))
    with caplog.at_level("INFO", logger="streetwise.operators.matching"):
        out = store.match([g[0] for g in GOLDEN[:4]], with_diagnostics=True, max_results=2, min_score=40)
    assert out.columns[: len(matching.FIRST)] == matching.FIRST
    rows = out.collect()
    assert [r["input_id"] for r in rows] == sorted(r["input_id"] for r in rows)
    best = {r["input_id"]: (r["retained_count"], r["best_score"], r["matched"]) for r in rows if r["match_rank"] in (1, None)}
    assert best[2][0] >= 1 and best[2][1] == 100 and best[4][2] is False and best[4][0] == 0
    said = " ".join(r.getMessage() for r in caplog.records)
    assert all(x in said for x in ("exact:", "postcode:", "state:", "locality:", "matched in"))
    matching.release(out)


PIPES = {
    "ADDRESS_DETAIL": ["ADDRESS_DETAIL_PID|STREET_LOCALITY_PID|LOCALITY_PID|BUILDING_NAME|FLAT_TYPE_CODE|FLAT_NUMBER|NUMBER_FIRST|NUMBER_FIRST_SUFFIX|NUMBER_LAST|POSTCODE|ALIAS_PRINCIPAL|DATE_RETIRED", "D1|S1|L1||UNIT|3|12|A||4059|P|", "D2|S1|L1|TOWER|||20||24|4059|A|", "D3|S1|L1||||9|||4059|P|2020-01-01"],
    "ADDRESS_DEFAULT_GEOCODE": ["ADDRESS_DETAIL_PID|LONGITUDE|LATITUDE|DATE_RETIRED", "D1|153.5|-27.5|"],
    "STREET_LOCALITY": ["STREET_LOCALITY_PID|STREET_NAME|STREET_TYPE_CODE|STREET_SUFFIX_CODE|DATE_RETIRED", "S1|MUSGRAVE|RD||"],
    "LOCALITY": ["LOCALITY_PID|LOCALITY_NAME|DATE_RETIRED", "L1|RED HILL|"],
    "ADDRESS_ALIAS": ["ALIAS_PID|ALIAS_TYPE_CODE|DATE_RETIRED", "D2|SYN|"],
    "LOCALITY_ALIAS": ["LOCALITY_ALIAS_PID|LOCALITY_PID|NAME|POSTCODE|ALIAS_TYPE_CODE|DATE_RETIRED", "1|L1|OLD HILL|4060|SYN|"],
    "STREET_LOCALITY_ALIAS": ["STREET_LOCALITY_ALIAS_PID|STREET_LOCALITY_PID|STREET_NAME|STREET_TYPE_CODE|STREET_SUFFIX_CODE|ALIAS_TYPE_CODE|DATE_RETIRED", "7|S1|OLD MUSGRAVE|ST||SYN|"],
}


def test_set_of_pipe_files_and_csv_sink(spark, tmp_path):
    folder = tmp_path / "set"
    folder.mkdir()
    for name, lines in PIPES.items():
        (folder / f"QLD_{name}_psv.psv").write_text("\n".join(lines) + "\n")
    store = AddressStore(spark)
    assert store.load_set(str(folder)) == 4
    rows = {r["address_detail_pid"]: r for r in store.table("addresses").collect()}
    assert {k: (r["address_label"], r["alias_type"], r["postcode"]) for k, r in rows.items()} == {
        "D1": ("UNIT 3 12A MUSGRAVE ROAD, RED HILL QLD 4059", None, 4059), "D2": ("TOWER 20-24 MUSGRAVE ROAD, RED HILL QLD 4059", "ADDRESS:SYN", 4059),
        "D1_LA1": ("UNIT 3 12A MUSGRAVE ROAD, OLD HILL QLD 4060", "LOCALITY:SYN", 4060), "D1_SA7": ("UNIT 3 12A OLD MUSGRAVE STREET, RED HILL QLD 4059", "STREET:SYN", 4059)}
    assert (rows["D1"]["longitude"], rows["D2"]["longitude"]) == (153.5, None)
    assert store.load_set(str(folder), aliases=False, overwrite=True) == 2
    assert store.canonicalise_street_types() == 2
    write_csv(store.table("addresses").select("address_detail_pid", "postcode"), str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 2
    (folder / "QLD_LOCALITY_psv.psv").unlink()
    with pytest.raises(FileNotFoundError):
        store.load_set(str(folder))


def test_first_of_equal_keys_in_file_order_counts(spark):
    table = spark.createDataFrame([("a", 1)], "k string, v int")
    rows = spark.createDataFrame([("b", 9), ("b", 2), ("a", 5), (None, 1), (None, 1)], "k string, v int").coalesce(1)
    assert sorted(map(str, tables.insert_ignore(table, rows, "k").collect())) == sorted(map(str, spark.createDataFrame([("a", 1), ("b", 9), (None, 1), (None, 1)], "k string, v int").collect()))


def test_stream_by_batches_and_after_a_restart(spark, tmp_path):
    store = AddressStore(spark, str(tmp_path / "store"))
    store.add_custom(spark.createDataFrame(DEMO, SCHEMA))
    source, seen = tmp_path / "in", []
    for part in ([(1, GOLDEN[1][0])], [(2, GOLDEN[5][0]), (3, GOLDEN[3][0])]):
        spark.createDataFrame(part, "input_id int, input_raw string").coalesce(1).write.mode("append").json(str(source))
        stream = spark.readStream.schema("input_id int, input_raw string").json(str(source))
        running = match_stream(stream, store, lambda df, n: seen.extend((n, r["input_id"], r["total_score"]) for r in df.collect()), str(tmp_path / "checkpoint"), max_results=1)
        running.processAllAvailable()
        running.stop()
    assert sorted((x[1], x[2] or 0) for x in seen) == [(1, 100), (2, 97), (3, 0)]
    assert store.cache_status().first()["cached_rows"] == 2
