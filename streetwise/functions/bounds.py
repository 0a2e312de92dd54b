"""What Jaro-Winkler similarity can be at most, from counts of letters, as column expressions.

A signature holds a name's length and, for each letter, how often it occurs: up to four
times as bits of its own, the rest in all. Two signatures give at least the number of
letters that the names have in common, and so an upper bound of their similarity without
a look at the letters' places.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that are counted each for itself; all others are counted together.
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ "
PREFIX = 4
#: Bounds are doubles: so much is added to be safe.
SLACK = 1e-9


def signature(name: str) -> Column:
    """Of a column: n (length), s1, s2 (a letter's occurrences, four bits each), more (occurrences beyond four); null for null."""
    letters = "array(" + ", ".join(f"'{c}'" for c in LETTERS) + ")"
    packed = lambda part: f"aggregate({part}, 0L, (bits, k) -> bits * 16 + element_at(array(0, 1, 3, 7, 15), least(k, 4) + 1))"
    each = f"transform({letters}, c -> length({name}) - length(replace({name}, c, '')))"
    whole = f"transform(array({each}), x -> concat(x, array(length({name}) - aggregate(x, 0, (sum, k) -> sum + k))))"
    out = f"transform({whole}, x -> struct(length({name}) AS n, {packed('slice(x, 1, 15)')} AS s1, {packed('slice(x, 16, 15)')} AS s2, aggregate(x, 0, (sum, k) -> sum + greatest(k - 4, 0)) AS more))"
    return F.expr(f"CASE WHEN {name} IS NOT NULL THEN {out}[0] END")


def jw_at_most(a: str, b: str, sa: str, sb: str, boost: float = 0.7) -> Column:
    """An upper bound of jw(a, b, boost), from columns of names and of signatures; 1 for equal names, null where one is
    null. The signatures should be columns of the tables that were joined: they are named several times."""
    common = f"(bit_count({sa}.s1 & {sb}.s1) + bit_count({sa}.s2 & {sb}.s2) + least({sa}.more, {sb}.more))"
    jaro = f"(({common} * (1D / greatest({sa}.n, 1) + 1D / greatest({sb}.n, 1)) + 1D) / 3D)"
    same = " ".join(f"WHEN left({a}, {k}) = left({b}, {k}) THEN {k / 10}D" for k in range(PREFIX, 0, -1))
    share = f"(CASE {same} ELSE 0D END)"
    bound = f"CASE WHEN {jaro} > {boost}D - {SLACK} THEN {share} + {jaro} * (1D - {share}) ELSE {jaro} END + {SLACK}"
    return F.expr(f"CASE WHEN {a} = {b} THEN 1D WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN least(CAST({bound} AS DOUBLE), 1D) END")
