"""Operators over conversations and pages (2 and 5), and the pipeline."""

import contextlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from streetwise.llm import chat_format, url_filter


def test_chats_can_be_read_back(spark):
    rows = [(1, 0, "user", "a </turn> ### b \\s \\h"), (1, 1, "assistant", None), (2, 0, "assistant", "too soon"), (3, 0, "system", "s"), (3, 1, "user", "q"), (3, 2, "assistant", "x"), (3, 2, "assistant", "x"), (4, 0, None, "no role"), (5, 0, "odd: role\n", "t"), (None, None, "user", "u")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("rows", F.lit("clash"))
    got = {r["conv_id"]: r for r in chat_format.read_chats(chat_format.format_chats(df)).collect()}
    for conv in (1, 2, 3, 4, 5, None):
        want = sorted((r[1] if r[1] is not None else -1, r[2] or "", r[3] or "") for r in rows if r[0] == conv)
        assert [(t["role"], t["text"]) for t in got[conv]["turns"]] == [w[1:] for w in want]
        assert "".join(s["text"] for s in got[conv]["segments"]) == got[conv]["formatted"]
    assert (got[1]["valid"], got[2]["bad_turn"], got[3]["bad_turn"], got[4]["valid"], got[None]["bad_turn"]) == (True, 0, 3, False, 1)
    assert chat_format.format_chats(df.limit(0)).count() == 0


def test_ties_of_turn_and_role_go_by_the_text_itself(spark):
    rows = [(1, 0, "user", t) for t in ("a###", "a$", "a\\", "aA", "a")]
    got = chat_format.read_chats(chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).first()
    assert [t["text"] for t in got["turns"]] == sorted(r[3] for r in rows)


def test_cascade_is_exact_over_its_universe():
    rng = np.random.default_rng(1)
    h, g = rng.integers(0, 2**64, (2, 40_000), dtype=np.uint64)
    listed = rng.random(40_000) < 0.2
    levels = url_filter.build_cascade(h, g, listed)
    assert len(levels) > 1 and (url_filter.probe_cascade(levels, h, g) == listed).all()
    assert url_filter.build_cascade(h, g, listed & False) == []
    assert not url_filter.probe_cascade([], h, g).any()


def test_the_second_hash_of_a_host_does_not_follow_from_the_first(spark):
    """Seeded by another column before it: of equal first hashes, the second ones differ by the key alone."""
    rows = spark.range(2000).select(F.concat(F.lit("host"), F.col("id").cast("string")).alias("key"))
    both = rows.select(F.xxhash64("key").alias("h"), F.xxhash64(F.lit(1), "key").alias("g"), F.xxhash64(F.xxhash64("key")).alias("x")).collect()
    assert len({r["g"] for r in both}) == 2000 and not any(r["g"] in (r["h"], r["x"]) for r in both)
    # A listed and an unlisted key of one first hash are told apart by the second.
    h, g = np.array([7, 7, 7, 9], dtype=np.uint64), np.array([1, 2, 3, 4], dtype=np.uint64)
    listed = np.array([True, False, True, False])
    assert (url_filter.probe_cascade(url_filter.build_cascade(h, g, listed), h, g) == listed).all()


def test_urls(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "SHARD_KEYS", 3)
    monkeypatch.setattr(url_filter, "BROADCAST_BYTES", 20)  # several turns
    urls = ["http://A.Example.COM/en/7x?q", "https://x.example.com/en/8", "http://com/en/", "http://acom/en/1", "ftp://a.example.net/de/81#f", "x.org/es/", None, "", "http://b.org?es", "http://b.org/es/9"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash"))
    got = {r["page_id"]: r for r in url_filter.judge_urls(df, F.col("key").isin("acom", "")).collect()}
    assert [got[i]["rule"] for i in range(10)] == ["example.com/en/7", "com/en/", "com/en/", None, "example.net/de/8", None, None, None, None, "org/es/"]
    assert [got[i]["verdict"] for i in range(10)] == ["allow", "block", "block", "block", "block", "block", "block", "block", "allow", "block"]
    assert (got[0]["host"], got[0]["path"], got[8]["host"], got[8]["path"]) == ("a.example.com", "/en/7x", "b.org", "")
    assert url_filter.judge_urls(df.limit(0), F.lit(True)).count() == 0


def test_each_rule_of_the_query_says_what_its_contract_says(spark):
    """All five rules, with every host listed and with none."""
    want = {"http://a.com/en/1": "block", "http://example.com/en/7": "allow", "http://a.net/de/1": "allow", "http://x.example.net/de/8": "block", "http://example.net/de/7": "allow", "http://a.org/es/1": "block"}
    df = spark.createDataFrame(list(enumerate(want)), "page_id long, url string")
    for listed in (True, False):
        got = {r["page_id"]: r["verdict"] for r in url_filter.judge_urls(df, F.lit(listed)).collect()}
        assert [got[i] for i in range(len(want))] == list(want.values())


def test_urls_by_shard_equal_urls_by_broadcast(spark, monkeypatch):
    """More cascades than may be broadcast; one host has a third of the rows; long urls and repeated rows."""
    rows = [(i, f"http://h{i % 40 if i % 3 else 0}.example.org/p{i % 7}") for i in range(300)] + [(5, "http://h5.example.org/p5"), (6, None), (None, "http://h1.example.org/" + "x" * 3000)]
    df = spark.createDataFrame(rows, "page_id long, url string")
    listed = F.substring(F.md5("key"), 1, 1).isin("0", "1", "2")
    key = lambda r: str(r)
    want = sorted(url_filter.judge_urls(df, listed).collect(), key=key)
    monkeypatch.setattr(url_filter, "SHARD_KEYS", 7)
    monkeypatch.setattr(url_filter, "BROADCAST_BYTES", 1)
    monkeypatch.setattr(url_filter, "GROUP_BYTES", 2000)
    assert sorted(url_filter.judge_urls(df, listed).collect(), key=key) == want and len(want) == len(rows)


def test_pipeline(spark, tmp_path):
    from .conftest import SCHEMA, corpus

    docs = spark.createDataFrame(corpus(), SCHEMA)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    item = corpus()[5][1]
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(0, 60, 2)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    left, seen = docs, []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / f"stage{i}")
        stage(spark, left, str(tmp_path)).write.parquet(path)
        left = spark.read.parquet(path)
        assert i == len(corpus_pipeline.STAGES) - 1 or left.columns == docs.columns
        seen.append({r["doc_id"] for r in left.select("doc_id").collect()})
    everyone = {r[0] for r in corpus()}
    assert everyone - seen[0] == {130, 131, 132, 135}
    assert seen[0] - seen[1] >= {103, 108, 120, 121, 134} and 0 in seen[1] and None in seen[1]
    assert seen[1] - seen[2] == {5}
    assert seen[3] == seen[2] == seen[4]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == left.count()


def test_stages_begin_with_heaps_given_back(spark):
    """A full collection on the executors (here the driver's own JVM) before each stage."""
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    full = lambda: sum(b.getCollectionCount() for b in beans if any(x in b.getName() for x in ("Old", "MarkSweep")))
    for _, stage in corpus_pipeline.STAGES:
        before = full()
        with contextlib.suppress(Exception):  # the stage itself is not looked at, and fails without tables
            stage(spark, None, "/nowhere")
        assert full() > before
