"""Operator 13: substring deduplication by super-k-mers.

A window is WINDOW consecutive words of a document. Its minimiser is the smallest hash
of SEED_WORDS consecutive words in it; consecutive windows that share one are a
super-k-mer, which travels as one string to the minimiser's bucket. Equal windows share
their minimiser, so they meet there, where sorting tells which of them other documents
have, and the smallest id of a document that has one.

A bucket that only one document fills has no such window: buckets are counted first, by
number alone, and a Bloom filter of bounded size keeps most of the others' strings from
being moved. Copies of a string are put together before they are moved, so a copied
passage is a few rows. A bucket whose strings still differ too much to be sorted by one
task is dealt on by window. Words themselves are compared, hashes only choose the way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, in_small_batches, removed, scratch_path, small, table
from .textarrays import chunks, mix, trimmed, utf8, word_spans

WINDOW, SEED_WORDS = 13, 4
#: Windows of a super-k-mer at most: a text that repeats one word has many.
LONGEST = 32
#: Strings of a bucket, and their bytes, up to which a task sorts it.
BUCKET_STRINGS, BUCKET_BYTES = 2_000, 2_000_000
#: Bits of the filter for each bucket that documents share, and in all.
FILTER_BITS, FILTER_BYTES = 12, 32 << 20
_U = np.uint64
_FOLD = np.arange(256, dtype=np.uint8)  # words stay as they are


def _super_kmers(hashes: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """text, first word (in the run), windows and minimiser of the super-k-mers of a run
    of texts; ``at`` has the bounds of the texts' words."""
    seed = min(SEED_WORDS, window)
    none = np.zeros(0, np.int64)
    if len(hashes) < window:
        return none, none, none, none
    low = hashes[: len(hashes) - seed + 1].copy()
    for i in range(1, seed):
        low = mix(low * _U(0x9FB21C651E98DF25) + hashes[i : len(hashes) - seed + 1 + i])
    n, width = len(hashes) - window + 1, 1
    while width < window - seed + 1:  # smallest of so many, by doubling
        step = min(width, window - seed + 1 - width)
        low = np.minimum(low[:-step], low[step:])
        width += step
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))[:n]
    inside = np.arange(n) + window <= at[text + 1]
    place = np.flatnonzero(inside)
    if not len(place):
        return none, none, none, none
    low, text = low[place], text[place]
    new = np.concatenate(([True], (low[1:] != low[:-1]) | (text[1:] != text[:-1]) | (place[1:] != place[:-1] + 1)))
    heads = np.flatnonzero(new)
    since = np.arange(len(place)) - np.repeat(heads, np.diff(np.append(heads, len(place))))
    heads = np.flatnonzero(since % LONGEST == 0)
    count = np.diff(np.append(heads, len(place)))
    return text[heads], place[heads], count, low[heads].view(np.int64)


def _packed(raw: np.ndarray, low: int, start: np.ndarray, length: np.ndarray, first: np.ndarray, words: np.ndarray) -> pa.Array:
    """Words first to first + words of a run, joined by one space, as strings."""
    ends = np.cumsum(length + 1)  # of the run's words, each with a space
    joined = np.full(int(ends[-1]), 0x20, dtype=np.uint8)
    begins = ends - length - 1
    body = np.repeat(start + low, length) + _within(length)
    joined[np.repeat(begins, length) + _within(length)] = raw[body]
    size = ends[first + words - 1] - 1 - begins[first]
    data = joined[np.repeat(begins[first], size) + _within(size)]
    return pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(np.concatenate(([0], np.cumsum(size))).astype(np.int64)), pa.py_buffer(data)]).cast(pa.string())


def _within(count: np.ndarray) -> np.ndarray:
    """0, 1, ... for each entry, as many as its count."""
    ends = np.cumsum(count)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - count, count)


def _runs_of(batch: pa.RecordBatch, window: int):
    raw, offsets = utf8(batch["text"])
    for first, last in chunks(offsets):
        at = offsets[first : last + 1]
        hashes, start, length, bounds = word_spans(raw, at, fold=_FOLD)
        yield raw, int(at[0]), start, length, bounds, first, *_super_kmers(hashes, bounds, window)


def _buckets(docs: DataFrame, window: int) -> DataFrame:
    """bucket, doc of every super-k-mer, without its words; once for a run of texts."""

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc = batch["doc"].to_numpy()
            for *_, first, text, _, _, bucket in _runs_of(batch, window):
                yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), pa.array(doc[first + text] if len(text) else text, pa.int64())], names=["bucket", "doc"])
        trimmed()

    return docs.select("doc", "text").mapInArrow(buckets, "bucket long, doc long")


class _Filter:
    """Bloom filter in shards: each is made where its keys are."""

    def __init__(self, keys: DataFrame, n: int):
        size = min(max(n * FILTER_BITS // 8, 1 << 10), FILTER_BYTES)
        shards = max(keys.sparkSession.sparkContext.defaultParallelism, size >> 20)
        bits = max(size // shards, 64) * 8

        def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, np.ndarray] = {}
            for batch in batches:
                shard, places = _Filter.places(batch["bucket"].to_numpy().view(_U), shards, bits)
                for s in np.unique(shard):
                    part = held.setdefault(int(s), np.zeros(bits, dtype=bool))
                    part[places[:, shard == s].reshape(-1)] = True
            for s, part in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([np.packbits(part).tobytes()], pa.binary())], names=["shard", "bits"])

        by_shard = keys.select("bucket", F.pmod("bucket", F.lit(shards)).alias("shard")).repartition(shards, "shard")
        found = by_shard.select("bucket").mapInArrow(filled, "shard int, bits binary").collect()  # FILTER_BYTES in all
        data = np.zeros((shards, bits // 8), dtype=np.uint8)
        for r in found:
            data[r["shard"]] |= np.frombuffer(r["bits"], dtype=np.uint8)
        self.data = keys.sparkSession.sparkContext.broadcast(data)

    @staticmethod
    def places(keys: np.ndarray, shards: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
        shard = np.mod(keys.view(np.int64), shards)
        h = mix(keys + _U(1))
        return shard, np.stack([mix(h + _U(i)) % _U(bits) for i in range(3)]).astype(np.int64)


def _may_hold(data: np.ndarray, keys: np.ndarray) -> np.ndarray:
    shard, places = _Filter.places(keys.view(_U), len(data), data.shape[1] * 8)
    return ((data[shard, places >> 3] >> (7 - (places & 7)).astype(np.uint8)) & 1).all(axis=0)


def _strings(docs: DataFrame, keys: _Filter, window: int) -> DataFrame:
    """bucket, doc, th, first (word in the document), packed of super-k-mers whose bucket passes the filter."""
    shared = keys.data

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, th = batch["doc"].to_numpy(), batch["th"].to_numpy()
            for raw, low, start, length, bounds, first, text, place, count, bucket in _runs_of(batch, window):
                if not len(text):
                    continue
                kept = _may_hold(shared.value, bucket)
                text, place, count = text[kept], place[kept], count[kept]
                if not len(text):
                    continue
                packed = _packed(raw, low, start, length, place, count + window - 1)
                yield pa.RecordBatch.from_arrays([pa.array(bucket[kept]), pa.array(doc[first + text]), pa.array(th[first + text]), pa.array(place - bounds[text], pa.int32()), packed], names=["bucket", "doc", "th", "first", "packed"])
        trimmed()

    return docs.select("doc", "th", "text").mapInArrow(strings, "bucket long, doc long, th long, first int, packed string")


def _windows(packed: str, window: int) -> list[str]:
    words = packed.split(" ")
    return [" ".join(words[i : i + window]) for i in range(len(words) - window + 1)]


def _smallest(strings: DataFrame, window: int) -> DataFrame:
    """k1, k2, least: for each window of a string the smallest document that has it; strings whose windows their own
    smallest document has alone are left out. ``strings`` has bucket, packed, k1, k2, doc (smallest), last (largest)."""

    def sorted_out(rows: list[dict]) -> Iterator[tuple[int, int, list[int]]]:
        if len(rows) == 1:
            r = rows[0]
            if r["doc"] < r["last"]:
                yield r["k1"], r["k2"], [r["doc"]] * len(_windows(r["packed"], window))
            return
        at = sorted((w, r["doc"], i, j) for i, r in enumerate(rows) for j, w in enumerate(_windows(r["packed"], window)))
        least: list[dict[int, int]] = [{} for _ in rows]
        word, doc = None, 0
        for w, d, i, j in at:
            if w != word:
                word, doc = w, d
            least[i][j] = doc
        for r, mine in zip(rows, least, strict=True):
            if any(d < r["last"] for d in mine.values()):
                yield r["k1"], r["k2"], [mine[j] for j in range(len(mine))]

    def each_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []

        def out(found: list[tuple[int, int, list[int]]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.list_(pa.int64()))], names=["k1", "k2", "least"])

        for batch in batches:
            found = []
            for row in batch.to_pylist():
                if rows and rows[0]["bucket"] != row["bucket"]:
                    found += sorted_out(rows)
                    rows = []
                rows.append(row)
            yield out(found)
        yield out(list(sorted_out(rows)) if rows else [])
        trimmed()

    ordered = strings.select("bucket", "k1", "k2", "doc", "last", "packed").repartition("bucket").sortWithinPartitions("bucket")
    return ordered.mapInArrow(each_bucket, "k1 long, k2 long, least array<long>")


def _smallest_by_window(strings: DataFrame, window: int, keep) -> DataFrame:
    """The same, each window for itself: counted where it is before it is dealt, and joined in a way that may be split."""
    words = F.split("packed", " ")
    slices = F.transform(F.sequence(F.lit(1), F.size(words) - window + 1), lambda i: F.array_join(F.slice(words, i, window), " "))
    each = strings.select("k1", "k2", "doc", F.posexplode(slices).alias("j", "w"))
    least = keep(each.groupBy("w").agg(F.min("doc").alias("least")))
    of = each.select("k1", "k2", "j", "w").join(least, "w")
    return of.groupBy("k1", "k2").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "least"))), lambda x: x["least"]).alias("least"))


def _covered(ranges: np.ndarray, n: int) -> np.ndarray:
    """Which of n words lie in a range (first, last)."""
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, ranges[:, 0], 1)
    np.add.at(edge, ranges[:, 1] + 1, -1)
    return np.cumsum(edge[:-1]) > 0


def _kept(text: pa.Array, ranges: pa.Array) -> pa.Array:
    n_words, n_removed, kept = [], [], []
    for t, r in zip(text, ranges, strict=True):
        words = (t.as_py() or "").encode().split()  # at ASCII white space
        gone = np.zeros(len(words), dtype=bool)
        if r.is_valid:
            both = r.values.to_numpy()
            gone = _covered(np.stack([both >> 32, both & 0xFFFFFFFF], axis=1), len(words))
        n_words.append(len(words))
        n_removed.append(int(gone.sum()))
        kept.append(b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g] if n_removed[-1] else words).decode() if t.is_valid else None)
    return pa.StructArray.from_arrays([pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], names=["n_words", "n_removed", "text"])


def repeated_ranges(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc, th, ranges (first word << 32 | last word): the windows that a smaller doc has as well. ``docs`` has
    doc, th (a hash of the text), text, none of them null."""
    spark = docs.sparkSession
    folder = scratch_path(spark, "substrings")
    made = iter(range(9))

    def keep(df: DataFrame) -> DataFrame:
        path = f"{folder}/{next(made)}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    shared = keep(_buckets(docs, window).groupBy("bucket").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).where("a < b").select("bucket"))
    found = _strings(docs, _Filter(shared, shared.count()), window)
    # 128 bits tell strings apart where they needn't be moved again.
    found = keep(found.select("*", F.xxhash64("packed").alias("k1"), F.xxhash64(F.lit(1), "packed").alias("k2")))
    strings = found.groupBy("bucket", "k1", "k2", "packed").agg(F.min("doc").alias("doc"), F.max("doc").alias("last"))
    strings = keep(strings)
    sizes = strings.groupBy("bucket").agg(F.count("*").alias("n"), F.sum(F.length("packed")).alias("size"))
    large = keep(sizes.where((F.col("n") > BUCKET_STRINGS) | (F.col("size") > BUCKET_BYTES)).select("bucket"))
    least = _smallest(strings.join(small(large), "bucket", "left_anti"), window)
    if not large.isEmpty():
        least = least.unionByName(_smallest_by_window(strings.join(small(large), "bucket", "left_semi"), window, keep))
    least = keep(least)
    both = found.select("k1", "k2", "doc", "th", "first").join(least, ["k1", "k2"])
    span = lambda j, more: F.shiftleft((F.col("first") + j).cast("long"), 32) + F.col("first") + j + more
    each = F.filter(F.transform("least", lambda x, j: F.when(x < F.col("doc"), span(j, window - 1))), lambda x: x.isNotNull())
    ranges = F.when(F.array_max("least") < F.col("doc"), F.array(span(F.lit(0), F.size("least") + (window - 2)))).otherwise(each)
    both = both.select("doc", "th", ranges.alias("ranges")).where(F.size("ranges") > 0)
    path = scratch_path(spark, "ranges")
    both.groupBy("doc", "th").agg(F.flatten(F.collect_list("ranges")).alias("ranges")).write.parquet(path)
    removed(spark, folder)
    return spark.read.parquet(path)


def drop_repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Returns doc_id, n_words, n_removed, text (the words left, joined by one space), one
    row for each row of ``docs``.

    Words are split at ASCII white space and not changed. A word goes if it lies in a
    window that also starts in a document of a smaller id; windows are those of the input.
    Ids are whole numbers. Rows that repeat an id are one document: what they share with
    one another stays. A row without an id neither loses words nor makes others lose any.
    A null text has no words and stays null; one of fewer than ``window`` words, or an
    empty one, loses none. Other columns are ignored; an empty table gives no rows."""
    in_small_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).withColumn("th", F.xxhash64("text"))
    ranges = repeated_ranges(base.where("doc is not null and text is not null"), window)
    held = ranges.agg(F.coalesce(F.sum(F.size("ranges") * 8 + 80), F.lit(0))).first()[0]
    out = base.join(F.broadcast(ranges) if held <= BROADCAST_BYTES else ranges, ["doc", "th"], "left")
    kept = F.arrow_udf(_kept, "struct<n_words:bigint,n_removed:bigint,text:string>")("text", "ranges")
    return out.select("doc", kept.alias("s")).select(F.col("doc").alias("doc_id"), "s.*")


def op13_super_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_repeated(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
o AS (SELECT r, doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
p AS (SELECT r, doc_id, i, word, CASE WHEN count(*) OVER ahead = {WINDOW} THEN string_agg(word, ' ') OVER ahead END AS win FROM o WINDOW ahead AS (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING)),
m AS (SELECT win, min(doc_id) AS least FROM p WHERE win IS NOT NULL GROUP BY win),
f AS (SELECT r, i, word, coalesce(least < doc_id, false) AS again FROM p LEFT JOIN m USING (win)),
c AS (SELECT r, i, word, bool_or(again) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW) AS gone FROM f),
k AS (SELECT r, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM c GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (r)
"""
