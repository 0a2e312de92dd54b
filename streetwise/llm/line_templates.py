"""Operator 4: line deduplication by a log-template tree.

A line goes down a tree of fixed depth: count of tokens, then its first DEPTH
tokens, where a token with a digit is already a wildcard. In a leaf, the different
lines come in order of their text; each joins the template whose constants agree
with it in most places, if these are at least AGREE of its tokens, and the places
that disagree become variable; otherwise it begins a template. Templates that at
least MIN_DOCS documents have are dropped.

Documents meet only in group-wise counts and equi-joins on hashes, and a leaf's
different lines in one pass over sorted rows; only places of dropped lines return
to the documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, cut, in_small_batches, table

DEPTH, MIN_TOKENS, MIN_DOCS = 3, 4, 3
AGREE = 0.5
WILD = "<*>"


def _key(*columns) -> Column:
    """128 bits."""
    return F.struct(F.xxhash64(*columns).alias("a"), F.xxhash64(F.lit(1), *columns).alias("b"))


def _lines(docs: DataFrame, min_tokens: int) -> DataFrame:
    """doc (hash of the row), pos, line (wildcards put in), leaf; lines under ``min_tokens`` are left out."""
    each = docs.select("doc", F.posexplode(F.split("text", "\n")).alias("pos", "raw"))
    masked = F.when(F.col("raw").rlike("[0-9]"), F.regexp_replace("raw", r"[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*", WILD)).otherwise(F.col("raw"))
    each = each.select("doc", "pos", masked.alias("line"))
    each = each.withColumn("tokens", F.array_remove(F.split("line", r"[\x20\x09-\x0D]+"), "")).where(F.size("tokens") >= min_tokens)
    return each.select("doc", "pos", F.array_join("tokens", " ").alias("line"), _key(F.size("tokens"), F.slice("tokens", 1, DEPTH)).alias("leaf"))


class _Leaf:
    """Templates of one leaf: constants as numbers of tokens, -1 where variable."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {}
        self.fixed = np.zeros((0, 0), dtype=np.int32)
        self.n = 0

    def join(self, line: str) -> int:
        words = line.split(" ")
        row = np.array([self.number.setdefault(w, len(self.number)) for w in words], dtype=np.int32)
        if self.n:
            same = (self.fixed[: self.n] == row).sum(axis=1)
            best = int(same.argmax())
            if same[best] >= AGREE * len(row):
                self.fixed[best][self.fixed[best] != row] = -1
                return best
        if self.n == len(self.fixed):
            more = np.full((max(2 * self.n, 1), len(row)), -1, dtype=np.int32)
            more[: self.n] = self.fixed[: self.n].reshape(self.n, len(row))
            self.fixed = more
        self.fixed[self.n] = row
        self.n += 1
        return self.n - 1


def _templates(different: DataFrame) -> DataFrame:
    """leaf, own, template of the different lines of each leaf."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, leaf = None, _Leaf()
        for batch in batches:
            found = []
            for key, line in zip(batch["leaf"].to_pylist(), batch["line"].to_pylist(), strict=True):
                if key != at:
                    at, leaf = key, _Leaf()
                found.append(leaf.join(line))
            yield pa.RecordBatch.from_arrays([batch["leaf"], batch["own"], pa.array(found, pa.int64())], names=["leaf", "own", "k"])

    ordered = different.select("leaf", "own", "line").repartition("leaf").sortWithinPartitions("leaf", "line")
    return ordered.mapInArrow(assign, "leaf struct<a:long,b:long>, own long, k long").select("leaf", "own", F.struct("leaf", "k").alias("template"))


def _few(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids


def recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """doc, pos of the lines to drop; ``docs`` has doc (a key) and text."""
    lines = _lines(docs, min_tokens)
    seen = lines.select("leaf", "doc").distinct().groupBy("leaf").agg(F.count("*").alias("n"))
    leaves = cut(seen.where(F.col("n") >= min_docs).select("leaf"))
    lines = cut(lines.join(_few(leaves), "leaf", "left_semi").select("leaf", "doc", "pos", F.xxhash64("line").alias("own"), "line"))
    different = cut(lines.groupBy("leaf", "own").agg(F.min("line").alias("line")))
    assigned = _templates(different)
    of = lines.select("leaf", "own", "doc", "pos").join(assigned, ["leaf", "own"])
    counts = of.select("template", "doc").distinct().groupBy("template").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs).select("template")
    return of.join(counts, "template", "left_semi").select("doc", "pos")


def _left(text: pa.Array, gone: pa.Array) -> pa.Array:
    """Texts without the lines at these places."""
    out = []
    for t, places in zip(text.to_pylist(), gone.to_pylist(), strict=True):
        drop = set(places or ())
        out.append(None if t is None else "\n".join([line for i, line in enumerate(t.split("\n")) if i not in drop]))
    return pa.array(out, pa.string())


def drop_recurring_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """Returns doc_id, n_lines, n_dropped, text (the lines left) for each row of ``docs``.

    Lines of fewer than ``min_tokens`` tokens always stay; with 1, all lines with a
    token are judged, and those of DEPTH tokens or fewer are a leaf each. Rows with equal id and text
    count as one document. A null text stays null, with no lines; an empty one has one
    empty line. Other columns are ignored; an empty table gives no rows."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    base = base.withColumn("doc", _key("doc_id", "text"))
    drop = recurring_lines(base.select("doc", F.coalesce("text", F.lit("")).alias("text")), min_docs, min_tokens)
    per_doc = drop.groupBy("doc").agg(F.collect_set("pos").alias("gone"))
    in_small_batches(docs.sparkSession)
    some = F.coalesce(F.size("gone") > 0, F.lit(False))
    left = F.arrow_udf(_left, "string")(F.when(some, F.col("text")), "gone")  # other texts stay where they are
    out = base.join(per_doc, "doc", "left").select("doc_id", "text", "gone", left.alias("left"))
    n = F.when(F.col("text").isNull(), 0).otherwise(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long")
    return out.select("doc_id", n.alias("n_lines"), F.when(some, F.size("gone")).otherwise(0).cast("long").alias("n_dropped"), F.when(some, F.col("left")).otherwise(F.col("text")).alias("text"))


def op4_template_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_recurring_lines(table(spark, sf_dir, "documents"), min_tokens=1)
    return out.select("doc_id", "n_lines", "n_dropped", F.length("text").cast("long").alias("n_chars_left"), F.sha2("text", 256).alias("left_sha256"))


#: A leaf's different lines are taken one by one, in order of their text, by a recursive query.
SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, text, dense_rank() OVER (ORDER BY doc_id, text) AS doc FROM documents),
l AS (SELECT DISTINCT doc, i AS pos, x[i] AS raw FROM (SELECT doc, x, unnest(range(1, len(x) + 1)) AS i FROM (SELECT DISTINCT doc, string_split(coalesce(text, ''), chr(10)) AS x FROM d))),
t AS (SELECT doc, pos, list_filter(regexp_split_to_array(regexp_replace(raw, '[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*', '<*>', 'g'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM l),
k AS (SELECT doc, pos, w, len(w) AS size, w[1:3] AS head FROM t WHERE len(w) >= 1),
leaves AS (SELECT size, head, row_number() OVER () AS leaf FROM (SELECT size, head FROM k GROUP BY ALL HAVING count(DISTINCT doc) >= 3)),
c AS MATERIALIZED (SELECT doc, pos, w, leaf FROM k JOIN leaves USING (size, head)),
u AS MATERIALIZED (SELECT leaf, w, row_number() OVER (PARTITION BY leaf ORDER BY array_to_string(w, ' ')) AS n FROM (SELECT DISTINCT leaf, w FROM c)),
walk AS (SELECT leaf, n, w, [w] AS templates, CAST(1 AS BIGINT) AS k FROM u WHERE n = 1
  UNION ALL
  SELECT leaf, n, w, CASE WHEN hit THEN list_transform(templates, lambda y, i: CASE WHEN i = best THEN list_transform(y, lambda x, j: CASE WHEN x = w[j] THEN x END) ELSE y END) ELSE list_append(templates, w) END,
    CASE WHEN hit THEN best ELSE len(templates) + 1 END
  FROM (SELECT *, list_position(same, list_max(same)) AS best, 2 * list_max(same) >= len(w) AS hit
    FROM (SELECT u.leaf, u.n, u.w, templates, list_transform(templates, lambda y: len(list_filter(y, lambda x, j: x = u.w[j]))) AS same FROM walk JOIN u ON u.leaf = walk.leaf AND u.n = walk.n + 1))),
o AS (SELECT c.doc, c.pos, c.leaf, walk.k FROM c JOIN walk ON walk.leaf = c.leaf AND walk.w = c.w),
r AS (SELECT leaf, k FROM o GROUP BY ALL HAVING count(DISTINCT doc) >= 3),
gone AS (SELECT doc, list(DISTINCT pos) AS ps FROM (SELECT o.doc, o.pos FROM o JOIN r USING (leaf, k)) GROUP BY doc),
e AS (SELECT doc_id, text, string_split(text, chr(10)) AS x, coalesce(ps, []) AS ps FROM d LEFT JOIN gone USING (doc)),
z AS (SELECT doc_id, text, coalesce(len(x), 0) AS n_lines, len(ps) AS n_dropped,
  CASE WHEN text IS NOT NULL THEN coalesce(array_to_string(list_transform(list_filter(range(1, len(x) + 1), lambda i: NOT list_contains(ps, i)), lambda i: x[i]), chr(10)), '') END AS kept FROM e)
SELECT doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_dropped AS BIGINT) AS n_dropped, length(kept) AS n_chars_left, sha256(kept) AS left_sha256 FROM z
"""
