"""Operator 3: benchmark decontamination by a prefix-filtered set join.

Each benchmark item gives windows of ten consecutive words (a shorter item is
one window). A window can only occur where all its words do, so with words
ordered by rarity in the corpus its rarest word is prefix enough. The corpus is
streamed once past an index of those words; the position bound fixes where the
window would start, the length bound that it ends within the text, and the
words themselves decide. Nothing but hits and one row a document is shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

WINDOW = 10
#: Windows in one broadcast slice of the index, about 50 MB. A larger index is
#: probed slice by slice.
SLICE = 200_000
#: ASCII capitals and what is no word character.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text as they stand, not yet lower-cased."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BETWEEN), "")


def key(word: Column) -> Column:
    """Hash to probe by: full lower case, coarser than A-Z alone; the check is exact."""
    return F.xxhash64(F.lower(word))


def item_windows(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """wid, words, items of each different window. Items without words give none."""
    w = benchmark.select(F.col(item_col).alias("item"), words(F.translate(text_col, UPPER, LOWER)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (window - 1), F.lit(1)))
    each = w.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, window))).alias("win"))
    return each.groupBy("win").agg(F.collect_set("item").alias("items")).select(F.xxhash64("win").alias("wid"), "win", "items")


def _rarest(windows: DataFrame, texts: DataFrame) -> DataFrame:
    """Adds key and off: the hash and place of each window's rarest word in the corpus."""
    each = windows.select("wid", F.posexplode("win").alias("off", "word")).withColumn("key", key(F.col("word")))
    vocabulary = each.select("key").distinct()
    n = vocabulary.count()
    found = []
    for part in range(-(-n // (10 * SLICE))):
        mine = F.broadcast(vocabulary.where(F.pmod("key", F.lit(-(-n // (10 * SLICE)))) == part))
        found.append(texts.select(F.explode("w").alias("word")).select(key(F.col("word")).alias("key")).join(mine, "key").groupBy("key").count())
    counts = cut(reduce(DataFrame.union, found)) if found else vocabulary.withColumn("count", F.lit(0).cast("long"))
    best = each.join(counts, "key", "left").groupBy("wid").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "key", "off")).alias("best"))
    return windows.join(best, "wid").select("wid", "win", F.col("best.key").alias("key"), F.col("best.off").alias("off"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Returns doc_id, n_words, n_hit, n_items, item_ids (sorted strings), contaminated
    and text_hash for each row of ``docs``; repeated rows stay repeated.

    Null and empty texts have no words and no hits. An item without an id counts
    in hits but not in items. An empty benchmark gives no hits. Other columns are
    ignored."""
    windows = cut(item_windows(benchmark, window=window))
    base = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), words(F.col(text_col)).alias("w"))
    index = cut(_rarest(windows, base.select("w")))
    # An empty word before the first one stands for the document itself.
    each = base.select("doc_id", "text_hash", "w", F.posexplode(F.concat(F.array(F.lit("")), "w")).alias("pos", "word")).withColumn("key", key(F.col("word")))
    slices = max(1, -(-index.count() // SLICE))
    index = index.select("wid", "key", "off", F.size("win").alias("len"), key(F.element_at("win", 1)).alias("k1"), key(F.element_at("win", -1)).alias("k2"), F.array_join("win", " ").alias("said"))
    index = cut(index)
    found = []
    for part in range(slices):
        mine = F.broadcast(index.where(F.pmod("wid", F.lit(slices)) == part))
        joined = each.join(mine, "key", "left")
        start = F.col("pos") - 1 - F.col("off")
        # No higher-order function here: the whole filter stays in generated code, so
        # that no exploded row with its words is ever copied. Two words go first.
        fits = F.col("wid").isNotNull() & (start >= 0) & (start + F.col("len") <= F.size("w"))
        ends = (key(F.get("w", start)) == F.col("k1")) & (key(F.get("w", start + F.col("len") - 1)) == F.col("k2"))
        there = F.slice("w", F.greatest(start + 1, F.lit(1)), F.greatest(F.coalesce("len", F.lit(1)), F.lit(1)))
        hit = F.when(fits, F.when(ends, F.translate(F.array_join(there, " "), UPPER, LOWER) == F.col("said")).otherwise(False)).otherwise(False)
        head = (F.col("pos") == 0) if part == 0 else F.lit(False)
        rows = joined.where(head | hit)
        found.append(rows.select("doc_id", "text_hash", F.when(head, 1).otherwise(0).alias("head"), F.size("w").cast("long").alias("n_words"), F.when(F.col("wid").isNotNull(), F.struct(start.alias("s"), "len")).alias("span"), "wid"))
    per_doc = reduce(DataFrame.union, found).groupBy("doc_id", "text_hash").agg(
        F.sum("head").alias("copies"), F.max("n_words").alias("n_words"), F.sort_array(F.collect_set("span")).alias("spans"), F.collect_set("wid").alias("wids")
    )
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    cover = F.aggregate("spans", zero, lambda a, x: F.struct(F.greatest(a["end"], x["s"] + x["len"]).alias("end"), (a["n"] + F.greatest(F.lit(0), x["s"] + x["len"] - F.greatest(a["end"], x["s"]))).alias("n")))
    per_doc = per_doc.select("doc_id", "text_hash", "copies", "n_words", cover["n"].alias("n_hit"), F.explode_outer("wids").alias("wid"))
    with_items = per_doc.join(windows.select("wid", "items"), "wid", "left")
    out = with_items.groupBy("doc_id", "text_hash").agg(
        F.max("copies").alias("copies"), F.max("n_words").alias("n_words"), F.max("n_hit").alias("n_hit"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("ids")
    )
    out = out.withColumn("item_ids", F.sort_array(F.transform("ids", lambda x: x.cast("string"))))
    out = out.withColumn("_", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))))
    return out.select("doc_id", "text_hash", "n_words", "n_hit", F.size("ids").cast("long").alias("n_items"), "item_ids", (F.col("n_hit") > 0).alias("contaminated"))


def op3_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, w[i:i + 9] AS win FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT len(win) AS n FROM bw),
dw AS (SELECT doc_id, n, i, w[i:i + n - 1] AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
m AS (SELECT DISTINCT doc_id, i, n, item_id FROM dw JOIN bw USING (win)),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits ON hits.doc_id = d.doc_id LEFT JOIN its ON its.doc_id = d.doc_id
"""
