"""The corpus pipeline: five stages over documents, each by one operator.

Each stage takes what the one before it kept, written as Parquet and read again,
and returns the columns of documents; the last returns where each document's
tokens lie. Rows of a null text do not pass language ID; an empty table passes
all stages as one. Columns that a stage does not use pass through untouched.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from streetwise.llm import decontamination, language, mixing, near_duplicates, token_files
from streetwise.llm.common import cut, heap_given_back, removed, scratch_path, small


def _without(docs: DataFrame, keys: DataFrame, *columns) -> DataFrame:
    """``docs`` but for the rows whose columns equal the columns k0, k1, ... of ``keys``."""
    keys = small(cut(keys.distinct()))
    same = F.lit(True)
    for i, c in enumerate(columns):
        same = same & c.eqNullSafe(keys[f"k{i}"])
    return docs.join(keys, same, "left_anti")


def _afresh(stage):
    """The stage, begun with heaps that hold nothing of the stages before."""

    @wraps(stage)
    def begun(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        heap_given_back(spark)
        return stage(spark, docs, sf_dir)

    return begun


@_afresh
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts whose language can't be told (null, or without a letter) go. If there is
    nothing to learn from, texts with a letter stay."""
    model = language.fit(language.learnable(docs))
    if not model.langs:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    return docs.where(language.predicted(model)["lang_pred"] != language.UNKNOWN)


@_afresh
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document of the smallest id stays. Of rows
    that repeat an id one stays, by a hash of the text; rows without an id stay."""
    found = near_duplicates.near_duplicates(docs)
    out = _without(docs, found.where("not kept").select(F.col("doc_id").alias("k0")), docs["doc_id"])
    repeated = cut(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("k")))
    if repeated.isEmpty():
        return out
    repeated = small(repeated)
    again = out.join(repeated, out["doc_id"] == repeated["k"], "left_semi")
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text")))
    once = again.select(F.struct(*[again[c] for c in again.columns]).alias("row"), first.alias("place")).where("place = 1").select("row.*")
    return out.join(repeated, out["doc_id"] == repeated["k"], "left_anti").union(once)


@_afresh
def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go. A null text has no words and
    stays; all rows that repeat a document go or stay together, by id and a hash of the
    text; an empty table, or an empty benchmark, leaves everything as it is."""
    found = decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = found.where("contaminated").select(F.col("doc_id").alias("k0"), F.col("text_hash").alias("k1"))
    return _without(docs, hit, docs["doc_id"], F.xxhash64(docs["text"]))


@_afresh
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document comes as often as its rate says; those of rate 0 go. A null text is
    an empty one; rows that repeat a document all come equally often; an empty table
    stays empty; without labels every document comes once."""
    _, model, steps = mixing.mix_rates(docs, mixing.labels_of(spark, sf_dir))
    own = F.struct(*[F.col(c) for c in docs.columns])
    rows = docs.select(own.alias("row"), F.xxhash64("text").alias("h"), mixing.predicted(model).alias("m"))
    n = mixing.copies(mixing.replayed(F.col("m.p"), steps), F.col("row.doc_id"), F.col("h"))
    return rows.select("row", F.explode(F.array_repeat(F.lit(0), n.cast("int")))).select("row.*")


@_afresh
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in directly addressable codes; returns what is read back from them. A
    null text has the end id alone; null ids come first; rows that repeat a document are
    documents of their own; an empty table gives no rows."""
    path = scratch_path(spark, "tokens")
    token_files.write_tokens(docs, path, token_files.default_tokenizer())
    return token_files.read_tokens(spark, path)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontamination", decontaminated), ("mixing", mixed), ("tokens", tokens)]
#: A fitted classifier and a tokenizer are no SQL; the tests hold a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = scratch_path(spark, name)
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            if before:
                removed(spark, before)
            before = path
    return docs
