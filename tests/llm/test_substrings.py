"""Operator 13 against brute force and its SQL."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from streetwise.llm import substrings

from .conftest import corpus

EXTRA = ("doc", "th", "first", "bucket", "packed", "k1", "ranges", "s", "least")


def passages(n: int = 60) -> list[tuple]:
    """Texts that share passages with others, at their ends, in the middle, twice, or next to each other."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdéß") for _ in range(rng.randint(1, 5)))
    shared = [[word() for _ in range(size)] for size in (12, 13, 14, 30, 60)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(0, 5)):
            parts += [word() for _ in range(rng.choice((0, 1, 5, 20)))]
            if rng.random() < 0.6:
                cut = rng.choice(shared)
                parts += cut[rng.randint(0, 3) :] if rng.random() < 0.5 else cut
        rows.append((i, rng.choice((" ", "  ", "\n", "\t ")).join(parts)))
    hot = " ".join(word() for _ in range(20))
    rows += [(100 + i, f"{word()} {word()} {hot} {word()} {word()}") for i in range(50)]
    rows += [(300, None), (301, ""), (302, " \n\x0b"), (303, "ha " * 400), (304, "ha " * 20), (305, "y" * 30_000 + " " + hot), (306, hot.replace(" ", " ")), (5, rows[6][1]), (6, rows[6][1]), (6, rows[6][1]), (None, hot), (-3, rows[9][1]), (400, " ".join(word() for _ in range(3000)) + " " + hot)]
    return rows


def brute(rows, window=13):
    split = [(i, [w.decode() for w in (t or "").encode().split()]) for i, t in rows]
    least = {}
    for i, w in split:
        if i is not None:
            for k in range(len(w) - window + 1):
                at = tuple(w[k : k + window])
                least[at] = min(i, least.get(at, i))
    out = []
    for i, w in split:
        gone = set()
        for k in range(len(w) - window + 1):
            if i is not None and least[tuple(w[k : k + window])] < i:
                gone |= set(range(k, k + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=str)


def got(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for c in EXTRA:
        df = df.withColumn(c, F.lit("clash"))
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["text"] or "") for r in substrings.drop_repeated(df.repartition(3), **options).collect()), key=str)


def test_repeated_words_equal_brute_force(spark):
    assert got(spark, passages()) == brute(passages())


def test_corpus_with_other_windows(spark):
    rows = [r[:2] for r in corpus()]
    for window in (13, 5, 2):
        assert got(spark, rows, window=window) == brute(rows, window)


@pytest.mark.parametrize("bounds", [{"BUCKET_STRINGS": 3}, {"BUCKET_BYTES": 100}, {"FILTER_BYTES": 64, "FILTER_BITS": 1}, {"BROADCAST_BYTES": 0}, {"LONGEST": 1}])
def test_bounds_change_no_result(spark, monkeypatch, bounds):
    """Hot buckets dealt by window, a filter that lets all pass, joins instead of broadcasts."""
    for name, value in bounds.items():
        monkeypatch.setattr(substrings, name, value)
    assert got(spark, passages()) == brute(passages())


def test_empty_tables(spark):
    df = spark.createDataFrame(passages(), "doc_id long, text string")
    assert substrings.drop_repeated(df.limit(0)).count() == 0
    assert substrings.drop_repeated(df.where("text is null")).first()["text"] is None


def test_query_equals_sql(spark, tmp_path):
    spark.createDataFrame(passages(), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(substrings.SQL).fetchall()
    assert sorted(map(tuple, substrings.op13_super_kmers(spark, str(tmp_path)).collect()), key=str) == sorted(want, key=str)
