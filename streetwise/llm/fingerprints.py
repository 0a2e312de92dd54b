"""Operator 8: document fingerprints as bottom-k sketches of shingle hashes.

A sketch is the sorted array of the k smallest different 64-bit hashes of a
text's five-word shingles. Sketches of parts merge into that of the whole, and
two of them estimate resemblance, containment and the count of different
shingles. All of it is column expressions; a text never leaves its row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

K, SHINGLE = 128, 5
#: Characters in one range of documents, sorted together: the least for up to MANY
#: ranges, and the most.
LEAST_CHARS, MANY, MOST_CHARS = 4_000_000, 4_000, 256_000_000
_SPAN = 2.0**64


def sketch(text: Column, k: int = K, shingle: int = SHINGLE) -> Column:
    """The sketch of a text: words are runs without ASCII white space, A-Z and other
    capitals lower-cased. A text of fewer words is one shingle; null and empty texts
    and white space have an empty sketch."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), "")
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def of(h: Column) -> Column:
        n = F.size(h)
        each = F.transform(F.sequence(F.lit(0), n - shingle), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(shingle)]))
        shingles = F.when(n >= shingle, each).when(n > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))
        return F.slice(F.array_sort(F.array_distinct(shingles)), 1, k)

    return F.element_at(F.transform(F.array(hashes), of), 1)  # binds the hashes once


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of a text of both parts' shingles."""
    return F.slice(F.array_sort(F.array_union(a, b)), 1, k)


def merge_all(sketches: Column, k: int = K) -> Column:
    """An aggregate: the sketch of a group's shingles together."""
    return F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_set(sketches)))), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity; exact while both sets have at most k shingles
    together. Two empty sketches have 1, an empty one and another 0."""
    both, union = F.size(F.array_intersect(F.array_intersect(a, b), merge(a, b, k))), F.size(merge(a, b, k))
    return F.when(union == 0, 1.0).otherwise(both / union)


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated count of different shingles: exact below k, else (k - 1) over the
    k-th hash's share of the hash range."""
    share = (F.element_at(a, -1).cast("double") + _SPAN / 2) / _SPAN
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has; null if a has none."""
    j = resemblance(a, b, k)
    both = j / (1 + j) * (distinct_count(a, k) + distinct_count(b, k))
    return F.when(F.size(a) > 0, F.least(both / distinct_count(a, k), F.lit(1.0)))


def as_text(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """doc_id, text and sketch of each row; other columns are ignored."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), sketch(F.col(text_col), k).alias("sketch"))


def _range_of(k: Column, h: Column, cuts: list[int]) -> Column:
    """Number of cuts below ``k``. A value that is a cut several times is many rows of one
    id: they are dealt over as many ranges by the hash, in its order."""
    once = sorted(set(cuts))
    if not once:
        return F.lit(0)
    # Two levels of cuts: about 2 * sqrt(n) comparisons a row.
    step = max(1, int(len(once) ** 0.5))
    blocks = [once[i : i + step] for i in range(0, len(once), step)]
    below = lambda xs: F.size(F.filter(xs, lambda x: x < k))
    outer = F.greatest(below(F.lit([b[0] for b in blocks])), F.lit(1)) - 1
    out = outer * step + below(F.get(F.array(*[F.lit(b) for b in blocks]), outer))
    many = {c: cuts.count(c) for c in once} if len(once) < len(cuts) else {}
    wide = [(c, n) for c, n in many.items() if n > 1]
    widest = max((n for _, n in wide), default=1)
    part = F.lit(0)
    for c, n in wide:
        part = F.when(k == c, F.floor((h.cast("double") + _SPAN / 2) / _SPAN * n)).otherwise(part)
    return out * widest + F.least(part, F.lit(widest - 1))


def with_next(rows: DataFrame, columns: list[str], range_chars: int | None = None) -> DataFrame:
    """Adds next_<column>: that of the following row in descending doc_id (equal ids
    by a hash of the text, null ids last), of the last row the first one's.

    Rows are dealt out by ranges between quantiles of all ids, as many partitions as
    ranges. The first row of each range is also put into the range before it, so each
    range is worked on alone. A range holds ``range_chars`` characters or so: LEAST_CHARS
    for up to MANY ranges, then more, up to MOST_CHARS."""
    key = F.coalesce("doc_id", F.lit(-(2**63)))
    ids = rows.select(key.alias("k"), F.length("text").alias("n"), F.xxhash64("text").alias("h"))
    size = ids.agg(F.count("*").alias("rows"), F.sum("n").alias("chars")).first()
    if not size["rows"]:
        return rows.select("*", *[F.col(c).alias(f"next_{c}") for c in columns])
    total = size["chars"] + 200 * size["rows"]
    range_chars = range_chars or min(max(LEAST_CHARS, total // MANY), MOST_CHARS)
    n = max(1, -(-total // range_chars))
    cuts = sorted(ids.agg(F.percentile_approx("k", [i / n for i in range(1, n)], 20 * n).alias("q")).first()["q"] or []) if n > 1 else []
    ranged = _range_of(F.col("k"), F.col("h"), cuts).cast("long")
    # Each range's first row, by its id and hash, goes to the range before it.
    heads = ids.select("k", "h", ranged.alias("range")).groupBy("range").agg(F.max(F.struct("k", "h")).alias("top"))
    heads = cut(heads.select("range", "top.k", "top.h"))
    down = Window.orderBy(F.desc("range"))  # a row for each range
    last = heads.agg(F.min("range")).first()[0]
    ghosts = heads.select("k", "h", F.lag("range", 1, last).over(down).alias("ghost")).groupBy("k", "h").agg(F.collect_list("ghost").alias("ghosts"))
    placed = rows.withColumn("k", key).withColumn("h", F.xxhash64("text")).withColumn("range", ranged)
    marked = placed.join(F.broadcast(ghosts), ["k", "h"], "left")
    own = F.array(F.struct(F.col("range").alias("range"), F.lit(False).alias("ghost")))
    over = F.coalesce(F.transform("ghosts", lambda g: F.struct(g.alias("range"), F.lit(True).alias("ghost"))), F.array().cast("array<struct<range:bigint,ghost:boolean>>"))
    dealt = marked.withColumn("to", F.explode(F.concat(own, over))).select(*rows.columns, "k", "h", F.col("to.range").alias("range"), F.col("to.ghost").alias("ghost"))
    dealt = dealt.repartition(len(cuts) + 1, "range") if cuts else dealt
    w = Window.partitionBy("range").orderBy(F.col("ghost"), F.col("k").desc(), F.col("h").desc())
    led = dealt.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in columns])
    return led.where("not ghost").drop("k", "h", "range", "ghost")


def op8_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_next(fingerprints(table(spark, sf_dir, "documents")), ["text", "sketch"])
    n = F.length("text")
    edited = F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 2) as int))"), F.expr("substring(next_text, 1, cast(floor(length(text) / 2) as int))"))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "sketch", "next_sketch", edited.alias("edited"))
    rows = rows.select("doc_id", "n_chars", "sketch", "next_sketch", F.sha2("edited", 256).alias("edited_sha256"), sketch(F.col("edited")).alias("edited_sketch"))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("sketch")).alias("fingerprint"), as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"), resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        distinct_count(F.col("sketch")).alias("n_shingles_est"), containment(F.col("sketch"), F.col("edited_sketch")).alias("contained_in_edited"),
    )
