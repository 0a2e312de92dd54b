"""Versions, writers in each other's way, changes that write only what changes, and pruning."""

import pytest
from pyspark.sql import functions as F

from streetwise.operators import matching, tables
from streetwise.sources import versions
from streetwise.sources.store import AddressStore
from streetwise.sources.versions import Conflict, VersionedTable

SCHEMA = {"k": "string", "v": "int", "kept": "string", "postcode": "int"}


def opened(spark, path, layout=("k",)):
    return VersionedTable(spark, str(path), SCHEMA, "k", list(layout))


def rows_of(spark, ids, v, kept="a"):
    return spark.createDataFrame([(f"k{i:05d}", v, kept, 4000 + i // 100) for i in ids], ", ".join(f"{c} {t}" for c, t in SCHEMA.items()))


def content(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(autouse=True)
def several_files(spark):
    """Small tables are one file otherwise."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.fixture
def table(spark, tmp_path):
    t = opened(spark, tmp_path / "t")
    t.replace(lambda old: old.unionByName(rows_of(spark, range(1000), 0)).repartition(4, "k"), "create")
    return t


def add(spark, t, ids, v):
    return t.append(lambda old: tables.new_rows(old, rows_of(spark, ids, v), "k"))


def test_two_writers_both_keep_their_rows(spark, tmp_path, table):
    other, seen = opened(spark, tmp_path / "t"), []

    def slow(old):
        seen.append(old.count())
        if len(seen) == 1:  # another writer commits between this one's reading and writing
            assert add(spark, other, range(990, 1010), 2) == 10
        return tables.new_rows(old, rows_of(spark, range(1005, 1015), 1), "k")

    reader = table.read()
    assert table.append(slow) == 5  # done again: five of its keys are there by now
    assert seen == [1000, 1010] and reader.count() == 1000
    got = {r["k"]: r["v"] for r in table.read().collect()}
    assert len(got) == 1015 and got["k01005"] == 2 and got["k01012"] == 1
    assert table.snapshot().version == 2
    assert [table.read(v).count() for v in (0, 1, 2)] == [1000, 1010, 1015]
    with pytest.raises(LookupError):
        table.read(3)


def test_writers_of_other_keys_are_not_in_the_way(spark, tmp_path, table):
    other, seen = opened(spark, tmp_path / "t"), []

    def slow(old):
        if not seen:
            add(spark, other, range(5000, 5010), 2)
        seen.append(1)
        return tables.new_rows(old, rows_of(spark, range(2000, 2010), 1), "k")

    assert table.append(slow) == 10 and len(seen) == 1 and table.read().count() == 1020


def test_a_delete_and_an_upsert_of_one_row(spark, tmp_path, table):
    other, seen = opened(spark, tmp_path / "t"), []

    def slow(old):
        if not seen:
            assert other.delete(rows_of(spark, [7], 0)) == 1
        seen.append(1)
        return rows_of(spark, [7, 8], 5, "b")

    assert table.upsert(slow, {"k", "kept"}) == (1, 1) and len(seen) == 2
    got = {r["k"]: (r["v"], r["kept"]) for r in table.read().where("v = 5").collect()}
    assert got == {"k00007": (5, "b"), "k00008": (5, "a")} and table.read().count() == 1000


def test_a_commit_in_the_way_is_seen(spark, table):
    read = table.snapshot()
    assert table.delete(rows_of(spark, [1], 0)) == 1
    with pytest.raises(Conflict):
        table.commit(read, versions.Change("x", removed=list(read.files)))


def test_upsert_reads_and_writes_few(spark, table):
    n = len(table.snapshot().files)
    assert n >= 3
    read = []
    whole = table._files
    table._files = lambda files, places=False: (read.append(len(files)) if places else None, whole(files, places))[1]
    assert table.upsert(lambda _: rows_of(spark, [3, 4, 2000], 9, "new"), {"k", "kept"}) == (1, 2)
    assert read == [1]  # of all files the one whose bounds hold a key
    last = table.history().orderBy(F.desc("version")).first()
    assert (last["rows_added"], last["rows_deleted"], last["files_removed"]) == (3, 2, 0)
    want = tables.upsert(table.read(0), rows_of(spark, [3, 4, 2000], 9, "new"), "k", {"k", "kept"})
    assert content(table.read()) == content(want)
    assert table.delete(condition=F.col("v") == 9) == 3 and table.read().count() == 998
    assert table.delete(rows_of(spark, [], 0)) == 0 and table.delete(rows_of(spark, [90_000], 0)) == 0


def test_a_file_without_rows_is_removed(spark, table):
    assert table.delete(condition=F.lit(True)) == 1000
    last = table.history().orderBy(F.desc("version")).first()
    assert last["files_removed"] >= 3 and last["rows_deleted"] == 0 and table.read().count() == 0
    assert table.read(0).count() == 1000


def test_update_compact_and_vacuum(spark, table, monkeypatch):
    monkeypatch.setattr(versions, "LOOSE", 3)
    assert table.update(F.col("postcode") == 4002, lambda df: df.withColumn("v", F.lit(7))) == 100
    for i in range(4):
        add(spark, table, range(3000 + i, 3001 + i), i)
    assert "compact" in {r["operation"] for r in table.history().collect()}
    before = content(table.read())
    assert len(before) == 1004 and sum(r[1] == 7 for r in before) == 100
    assert not any(f["notes"] for f in table.snapshot().files.values())
    assert table.vacuum() == 0  # all is young: it might be another writer's
    assert table.vacuum(versions=1, older_than_s=-5) > 0
    assert content(table.read()) == before and content(opened(spark, table.path).read()) == before


def test_versions_beyond_a_listing(spark, table):
    for i in range(versions.LISTED_EVERY + 2):
        table.delete(rows_of(spark, [i], 0))
    assert table.read().count() == 1000 - versions.LISTED_EVERY - 2
    assert table.read(3).count() == 997


def test_reading_within_blocks(spark, tmp_path):
    t = opened(spark, tmp_path / "p", ["postcode", "k"])
    t.replace(lambda old: old.unionByName(rows_of(spark, range(2000), 0)).unionByName(rows_of(spark, range(5000, 5004), 0).withColumn("postcode", F.lit(None).cast("int"))))
    some = t.read(within={"postcode": [4003, 4019]})
    assert 0 < len(some.inputFiles()) < len(t.read().inputFiles()) and some.count() == 200
    assert t.read(within={"postcode": []}).count() == 0 and t.read(within={"postcode": [1]}).count() == 0


def test_match_reads_the_files_of_its_postcodes(spark, tmp_path, monkeypatch):
    store = AddressStore(spark, str(tmp_path / "store"))
    record = lambda i: (f"P{i:06d}", f"{i % 40 + 1} HIGH{i % 7} STREET, TOWN{i // 50} QLD {4000 + i // 50}", i % 40 + 1, f"HIGH{i % 7}", "STREET", f"TOWN{i // 50}", "QLD", 4000 + i // 50)
    rows = spark.createDataFrame([record(i) for i in range(2000)], "address_detail_pid string, address_label string, number_first int, street_name string, street_type string, locality_name string, state string, postcode int")
    store.tables["addresses"].append(lambda t: tables.aligned(rows.withColumn("source", F.lit("core")), tables.ADDRESS).repartition(8))
    store.rebuild_locality_index()
    read, table = [], store.table
    monkeypatch.setattr(store, "table", lambda name, version=None, within=None: (out := table(name, version, within), read.append((within, len(out.inputFiles()))) if within and name == "addresses" else None)[0])
    out = store.match([f"{n} High{n % 7} St, Town3 QLD 4003" for n in (1, 2)] + ["5 High2 St Town9 4009"], locality_fallback=False, cache=False)
    assert [(r["postcode"], r["matched"]) for r in out.collect()] == [(4003, True)] * 2 + [(4009, True)]
    within, files = read[0]
    assert sorted(within["postcode"]) == [4003, 4009] and 0 < files < len(store.tables["addresses"].snapshot().files)
    matching.release(out)
