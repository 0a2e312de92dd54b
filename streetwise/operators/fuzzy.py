"""Names that are spelt alike, by an index of their letters instead of a comparison of all.

Jaro-Winkler similarity of ``least`` or more needs one of two things. Either the names
begin with the same three characters; or, with at most two, their Jaro similarity is so
high that they have a certain number of letters in common, which depends on their lengths
alone. Put in one order, rare letters first, two such names share a letter among the
first few of each: as many as are not needed, and one. Both are keys of an equi-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bounds import jw_at_most, signature
from ..functions.similarity import jw

#: Letters from rare to frequent; a guess that only decides how long the lists of names are.
RARE_FIRST = "QZXJKVBYWGPFMCDHUTLSINORAE "
SAME = 3


def _letters(name: str) -> Column:
    """A name's characters, each with the number of its occurrence, rare ones first."""
    chars = f"transform(sequence(1, length({name})), i -> substring({name}, i, 1))"
    numbered = f"transform(x, (c, i) -> concat(lpad(CAST(instr('{RARE_FIRST}', c) AS STRING), 2, '0'), c, CAST(size(filter(slice(x, 1, i + 1), d -> d = c)) AS STRING)))"
    return F.expr(f"transform(array({chars}), x -> array_sort({numbered}))[0]")


def _keys(name: str, letters: str, least: float, asked: bool) -> Column:
    """The join keys of a name: its first characters, and for each length m that the other may have the first letters of
    which it must have one."""
    jaro = max((least - 0.1 * (SAME - 1)) / (1 - 0.1 * (SAME - 1)), 0.7)
    need = f"{3 * jaro - 1:.12f}D"  # common / one length + common / the other
    n = f"length({name})"
    lengths = f"sequence(CAST(ceil({n} * ({need} - 1D) - 1e-9) AS INT), CAST(floor({n} / ({need} - 1D) + 1e-9) AS INT))"
    common = f"CAST(ceil({need} * {n} * m / ({n} + m) - 1e-9) AS INT)"
    first = f"slice({letters}, 1, greatest({n} - {common} + 1, 0))"
    keys = f"flatten(transform({lengths}, m -> transform({first}, x -> xxhash64({f'{n}, m' if asked else f'm, {n}'}, x))))"
    return F.expr(f"array_distinct(concat(CASE WHEN {n} >= {SAME} THEN array(xxhash64(left({name}, {SAME}))) ELSE array() END, {keys}))")


def near_names(asked: DataFrame, names: DataFrame, least: float) -> DataFrame:
    """block, asked, name, jw: pairs of ``asked`` (block, asked) and ``names`` (block, name) of a block whose similarity
    is ``least`` or more. Both have different rows; a null block is no block, a null or empty name is like none."""
    if least <= 0.7:
        raise ValueError("the index needs a similarity of over 0.7")

    def keyed(df: DataFrame, c: str) -> DataFrame:
        df = df.where((F.length(c) > 0) & F.col("block").isNotNull()).withColumns({"_letters": _letters(c), f"_{c}": signature(c)})
        return df.select("block", c, f"_{c}", F.explode(_keys(c, "_letters", least, c == "asked")).alias("_key"))

    pairs = keyed(asked, "asked").join(keyed(names, "name"), ["block", "_key"])
    able = pairs.where(jw_at_most("asked", "name", "_asked", "_name") >= least).select("block", "asked", "name").distinct()
    return able.withColumn("jw", jw(F.col("asked"), F.col("name"))).where(F.col("jw") >= least)
