"""How alike the input's text and the matched label are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.similarity import bigram_jaccard, jw


def add_text_diagnostics(results: DataFrame) -> DataFrame:
    """Adds text_jw, text_jaccard and text_similarity (their mean), in percent with one
    decimal; null where nothing matched."""
    a, b = F.col("_a"), F.col("_b")
    out = results.withColumns({"_a": tx.normalise(F.col("input_raw")), "_b": tx.normalise(F.col("address_label"))})
    out = out.withColumns({"text_jw": F.round(100 * jw(a, b, None), 1), "text_jaccard": F.round(100 * bigram_jaccard(a, b), 1)}).drop("_a", "_b")
    return out.withColumn("text_similarity", F.round((F.col("text_jw") + F.col("text_jaccard")) / 2, 1))


def score_colour(score: float | None, low: tuple = (215, 48, 39), high: tuple = (26, 152, 80)) -> str:
    """A hex colour for a score, in 101 steps; grey without one."""
    if score is None:
        return "#cccccc"
    share = min(max(round(score), 0), 100) / 100
    return "#" + "".join(f"{round(a + (b - a) * share):02x}" for a, b in zip(low, high, strict=True))
