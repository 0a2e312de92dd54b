"""The six-part score of an input against a candidate, 0 to 100."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import jw

#: The default weights.
WEIGHTS = {"postcode": 20.0, "suburb": 15.0, "street": 40.0, "type": 10.0, "number": 10.0, "flat": 5.0}
PARTS = list(WEIGHTS)
SCORES = [f"score_{p}" for p in ["postcode", "suburb", "street_name", "street_type", "number", "flat"]]


def check_weights(weights: dict[str, float] | None) -> dict[str, float]:
    """The weights as floats in order; raises unless they are the six, none negative, with sum 100."""
    if weights is None:
        return dict(WEIGHTS)
    if not isinstance(weights, dict) or set(weights) != set(PARTS):
        raise ValueError(f"weights must have exactly these names: {', '.join(PARTS)}")
    for name, w in weights.items():
        if isinstance(w, bool) or not isinstance(w, int | float) or w != w or w < 0:
            raise ValueError(f"weight {name} must be a number that is not negative")
    if abs(sum(weights.values()) - 100) > 1e-8:
        raise ValueError("weights must sum to 100")
    return {p: float(weights[p]) for p in PARTS}


def _suffixed(n: Column, letter: Column, label: Column) -> Column:
    """Whether a label begins with the number, its letter and a space."""
    return F.coalesce(label.startswith(F.concat(n.cast("string"), letter, F.lit(" "))), F.lit(False))


def number_gate(c: dict[str, Column]) -> Column:
    """Whether a candidate may be scored at all for the input's number."""
    n, first, last = c["in_number_first"], c["number_first"], c["number_last"]
    lettered = first.isNull() & c["in_number_suffix"].isNotNull() & _suffixed(n, c["in_number_suffix"], c["address_label"])
    return F.coalesce(n.isNull() | (n == first) | (last.isNotNull() & n.between(first, last)) | lettered, F.lit(False))


def score_columns(weights: dict[str, float] | None = None, strict: bool = True) -> dict[str, Column]:
    """Score columns over the columns of a candidate pair, with jw_suburb and jw_street
    present. ``strict`` rounds halves away from zero, as the block paths do; the exact
    path (strict=False) rounds them to even."""
    w = check_weights(weights)
    rounded = (lambda x: F.round(x).cast("int")) if strict else (lambda x: F.bround(x).cast("int"))
    const = lambda x: F.lit(round(x))  # noqa: E731  halves to even
    tier = lambda share: F.lit(int(round(w["postcode"]) * share + 0.5 + 1e-9) if strict else round(w["postcode"] * share))
    col = F.col
    gap = F.abs(col("in_postcode") - col("postcode"))
    postcode = F.when(gap == 0, tier(1.0)).when(gap == 1, tier(0.7)).when(gap == 2, tier(0.4)).when(gap == 3, tier(0.2)).otherwise(0)
    like = lambda sim, weight: F.coalesce(rounded(F.lit(weight) * sim), F.lit(0))
    a, b = col("in_street_type"), col("street_type")
    kind = F.when(a.eqNullSafe(b), const(w["type"])).when(a.isNull() | b.isNull(), const(w["type"] * 0.5)).otherwise(const(w["type"] * 0.4))
    n, letter = col("in_number_first"), col("in_number_suffix")
    same = (n == col("number_first")) | col("number_first").isNull()
    number = (
        F.when(n.isNull(), 0)
        .when(letter.isNotNull(), F.when(same & _suffixed(n, letter, col("address_label")), const(w["number"])).otherwise(0))
        .when(n == col("number_first"), const(w["number"]))
        .when(col("number_last").isNotNull() & n.between(col("number_first"), col("number_last")), const(w["number"] * 0.7))
        .otherwise(0)
    )
    x, y = F.trim(F.coalesce("in_flat_number", F.lit(""))), F.trim(F.coalesce("flat_number", F.lit("")))
    flat = F.when(x == y, const(w["flat"])).otherwise(0)
    parts = [postcode, like(col("jw_suburb"), w["suburb"]), like(col("jw_street"), w["street"]), kind, number, flat]
    return dict(zip(SCORES, [p.cast("int") for p in parts], strict=True))


def with_scores(pairs: DataFrame, weights: dict[str, float] | None = None, strict: bool = True) -> DataFrame:
    """Adds the six scores and total_score; similarities that are missing are computed."""
    boost = 0.7 if strict else None
    for name, left, right in (("jw_suburb", "in_locality", "locality_name"), ("jw_street", "in_street_name", "street_name")):
        if name not in pairs.columns:
            pairs = pairs.withColumn(name, jw(F.col(left), F.col(right), boost))
    pairs = pairs.withColumns(score_columns(weights, strict))
    return pairs.withColumn("total_score", sum((F.col(s) for s in SCORES[1:]), F.col(SCORES[0])))
