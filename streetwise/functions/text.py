"""Column functions over raw address text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon

#: Digits that are followed by two letters or more which are not their ordinal ending.
GLUED = r"(\d+)(?!(?:(?<=1[123])TH|(?<=(?<!1)1)ST|(?<=(?<!1)2)ND|(?<=(?<!1)3)RD|(?:(?<=[4-90])|(?<=1[123]))TH)(?![A-Z]))(?<=\d)(?=[A-Z]{2})"
NUMBER = r"^(\d+)([A-Z]?)(?:-(\d+)[A-Z]?)?$"


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def trim_all(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def unglue(text: Column) -> Column:
    """A space between a number and the word stuck to it, but not in an ordinal."""
    return F.regexp_replace(text, GLUED, "$1 ")


def normalise(text: Column) -> Column:
    """Upper case, commas and dots as spaces, single spaces, numbers unglued."""
    return F.trim(unglue(squeeze(F.translate(F.upper(text), ",.", "  "))))


def expand(text: Column, ordinals: bool = False) -> Column:
    for pattern, word in lexicon.EXPANSIONS:
        text = F.regexp_replace(text, pattern, word)
    if ordinals:
        for n, word in enumerate(lexicon.ORDINALS, 1):
            text = F.regexp_replace(text, rf"\b{n}{lexicon.ordinal_suffix(n)}\b", word)
    return text


def split_number(token: Column) -> tuple[Column, Column, Column]:
    """First number, last number and the first one's letter of ``12A-14``."""
    part = lambda g: F.nullif(F.regexp_extract(token, NUMBER, g), F.lit(""))
    return part(1).try_cast("int"), part(3).try_cast("int"), part(2)


def comma_hint(text: Column) -> Column:
    """The word before the last comma, upper case; null if there is none."""
    return F.nullif(F.regexp_extract(F.upper(text), r"(?s)^.*?([^\s,]+)\s*,[^,]*$", 1), F.lit(""))


def canonical(value: Column, spellings: dict[str, str] = lexicon.STREET_TYPES) -> Column:
    """The canonical form of a known spelling; any other value as it is."""
    lookup = F.create_map(*[F.lit(x) for pair in spellings.items() for x in pair])
    return F.coalesce(F.element_at(lookup, value), value)


def geo_suffix(text: Column) -> Column:
    """Struct state, postcode, rest of what stands at the end of a normalised address:
    state and postcode in either order, or one of them; the first that fits counts."""
    state, code = rf"\b({'|'.join(lexicon.STATES)})\b", r"\b(\d{4})\b"
    out = F.struct(F.lit(None).cast("string").alias("state"), F.lit(None).cast("int").alias("postcode"), text.alias("rest"))
    for pattern, s, p in [(code + r"\s*$", 0, 1), (state + r"\s*$", 1, 0), (code + r"\s+" + state + r"\s*$", 2, 1), (state + r"\s+" + code + r"\s*$", 1, 2)]:
        get = lambda g, pattern=pattern: F.regexp_extract(text, pattern, g) if g else F.lit(None).cast("string")
        found = F.struct(get(s).alias("state"), get(p).try_cast("int").alias("postcode"), F.trim(F.regexp_replace(text, pattern, "")).alias("rest"))
        out = F.when(text.rlike(pattern), found).otherwise(out)
    return out


def street_type_case(value: Column) -> Column:
    return canonical(F.upper(F.trim(value)))
