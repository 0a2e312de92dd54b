"""Parser: one address text to twelve fields.

Two grammars, each a table of patterns with named parts. The quick one wants the
region at the end of the text and a known street type; what it does not claim goes
to the full one, which looks for every part anywhere and forgives misspelt types.

Both run in Python over Arrow batches. The quick one is there as column expressions too:
a pattern is matched once and puts all its parts, with a separator, in the text's place.
These leave to Python what the quick grammar does not claim, texts for which a likeness
decides, and those with other than ASCII characters, where the two regular languages differ.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as lex
from ..functions import text as tx
from ..functions.similarity import jaro_winkler_many

FIELDS = {
    "in_postcode": "int", "in_state": "string", "in_locality": "string", "in_street_name": "string", "in_street_type": "string", "in_street_suffix": "string",
    "in_number_first": "int", "in_number_last": "int", "in_number_suffix": "string", "in_flat_type": "string", "in_flat_number": "string", "in_building_name": "string",
}
LEAST_TYPE = 0.85
_STATE, _NUM, _FLAT = "|".join(lex.STATES), r"\d+[A-Z]?(?:-\d+[A-Z]?)?", r"\d+[A-Z]?"
_WORD = lex.alternation(lex.FLAT_TYPES)
_KEYS = list(lex.STREET_TYPES)


def _re(pattern: str) -> re.Pattern:
    return re.compile(pattern, re.ASCII)


_TYPE = _re(rf"\b(?:{lex.alternation(_KEYS)})\b")
_ENDS = [_re(rf"\b(?P<state>{_STATE})\b\s+\b(?P<code>\d{{4}})\b\s*$"), _re(rf"\b(?P<code>\d{{4}})\b\s+\b(?P<state>{_STATE})\b\s*$"), _re(rf"\b(?P<state>{_STATE})\b\s*$"), _re(r"\b(?P<code>\d{4})\b\s*$")]
_DIRECTION = _re(rf"^({'|'.join(lex.DIRECTIONS)})\b")
_NUMBER = _re(r"^(\d+)([A-Z]?)(?:-(\d+)[A-Z]?)?$")
_LETTER = _re(r"^[A-Z]$")
_MARK = _re(rf"\b(?:{_WORD})\s+\d+|\bU\d+\b")
_HINT = _re(r"\b([A-Z0-9]+)\s*,[^,]*$")
_TAIL = rf"(?P<letter>[A-Z])(?P<flat>{_FLAT})\s+(?P<street>\S.*)$"

#: Pattern, and whether no flat marker may stand behind its first number.
QUICK = [
    (_re(rf"^(?P<bld>.*?)(?P<flat>{_FLAT})/(?P<num>{_NUM})\s*(?P<street>.*)$"), False),
    (_re(rf"^(?P<word>{_WORD})\s+(?P<flat>{_FLAT})\s+(?:(?P<num>{_NUM})\s+(?P<street>.+)|(?P<rest>.*))$"), False),
    (_re(rf"^(?P<letter>[A-Z])(?P<flat>{_FLAT})\s+(?P<num>{_NUM})\s+(?P<street>.+)$"), False),
    (_re(rf"^(?P<flat>{_NUM})\s+(?P<num>{_NUM})\s+(?P<street>.+)$"), True),
    (_re(rf"^(?P<num>{_NUM})\s+{_TAIL}"), True),
    (_re(rf"^(?P<num>{_NUM})\s+(?P<street>.+)$"), True),
]
_ANY_SLASH = _re(rf"^(?P<bld>.*?)(?P<flat>{_FLAT})/(?P<num>{_NUM})(?P<street>.*)$")
_ATTACHED = _re(rf"^(?P<letter>[A-Z])(?P<flat>{_FLAT})\s+(?P<num>{_NUM})\s+(?P<street>\S.*)$")
_PAIR = _re(rf"^(?P<bld>.*)\b(?P<flat>{_FLAT})\s+(?P<num>{_NUM})\s+(?P<street>\D.*)$")
_ENDS_IN_WORD = _re(rf"^(?P<bld>.*?)\b(?P<word>{_WORD})\s*$")
_MARKERS = [_re(rf"\b(?P<word>{_WORD})\s+(?P<flat>{_FLAT})\b"), _re(r"\bU(?P<flat>\d+)\b")]
_LEFT_NUM, _RIGHT_NUM = _re(rf"^(?P<bld>.*?)\b(?P<num>{_NUM})\s*$"), _re(rf"^(?P<num>{_NUM})\s+(?P<street>.+)$")
_NUMBERED = _re(rf"^(?P<bld>.*?)(?P<num>{_NUM})\s+(?P<street>.*)$")
_DESIGNATED = _re("^" + _TAIL)


def _int(digits: str | None) -> int | None:
    return int(digits) if digits and int(digits) < 2**31 else None


def _fields(parts: dict[str, str | None], blank_street: bool = False) -> dict:
    """Fields from a match's named parts; a blank part is none."""
    get = lambda k: (parts.get(k) or "").strip() or None
    bld, letter = get("bld"), get("letter")
    if bld and get("flat") and not get("word") and _LETTER.match(bld) and parts.get("lone", True):
        bld, letter = None, bld
    kind = lex.FLAT_TYPES[parts["word"]] if get("word") else lex.ATTACHED.get(letter, "UNIT") if get("flat") else None
    out = {"in_building_name": bld, "in_flat_type": kind, "in_flat_number": get("flat"), "in_street_name": get("street") or get("rest")}
    if blank_street and out["in_street_name"] is None:
        out["in_street_name"] = ""
    if number := _NUMBER.match(parts.get("num") or ""):
        first, letter_of, last = number.groups()
        out |= {"in_number_first": _int(first), "in_number_suffix": letter_of or None, "in_number_last": _int(last)}
    return out


def _front(text: str) -> dict:
    """The full grammar over what stands before the street type."""
    text = text.strip()
    if not text:
        return {}
    for pattern in (_ANY_SLASH, _ATTACHED):
        if m := pattern.match(text):
            return _fields(m.groupdict())
    if m := _PAIR.match(text):
        parts = m.groupdict() | {"lone": False}
        if w := _ENDS_IN_WORD.match(parts["bld"]):
            parts |= w.groupdict()
        return _fields(parts)
    marks = [m for p in _MARKERS if (m := p.search(text))]
    if marks:
        mark = max(marks, key=lambda m: m.start())
        left, right = text[: mark.start()].strip(), text[mark.end() :].strip()
        parts = mark.groupdict() | {"lone": False}
        if m := _LEFT_NUM.match(left):
            parts |= m.groupdict() | {"street": right}
        elif m := _RIGHT_NUM.match(right):
            parts |= m.groupdict() | {"bld": left}
        else:
            parts |= {"bld": left, "street": right}
        return _fields(parts)
    if m := _NUMBERED.match(text):
        parts = m.groupdict() | {"lone": False}
        if d := _DESIGNATED.match(parts["street"].strip()):
            parts |= d.groupdict()
        return _fields(parts)
    return {"in_street_name": text}


@lru_cache(maxsize=200_000)
def _closest_type(word: str) -> tuple[float, str]:
    """Similarity and key of the street type most like a word (the first on ties)."""
    values = jaro_winkler_many([word] * len(_KEYS), _KEYS, None)
    best = int(values.argmax())
    return float(values[best]), _KEYS[best]


def _type_of(word: str) -> str | None:
    if word in lex.STREET_TYPES:
        return lex.STREET_TYPES[word]
    value, key = _closest_type(word)
    return lex.STREET_TYPES[key] if value >= LEAST_TYPE else None


def _split_at_type(text: str, hint: str | None) -> tuple[str, str, str] | None:
    """Street type, and the text on either side: by the comma hint, else the last
    known type, else the word that is most like one (the last on ties)."""
    if hint:
        at = [m.span() for m in re.finditer(rf"\b{re.escape(hint)}\b", text, re.ASCII)]
        if at and (kind := _type_of(hint)):
            return kind, text[: at[-1][0]].strip(), text[at[-1][1] :].strip()
    if known := list(_TYPE.finditer(text)):
        last = known[-1]
        return lex.STREET_TYPES[last.group()], text[: last.start()].strip(), text[last.end() :].strip()
    words = text.split()
    near = [(_closest_type(w), i) for i, w in enumerate(words) if not w[0].isdigit()] if len(words) > 1 else []
    if not near:
        return None
    (value, key), i = max(near, key=lambda x: (x[0][0], x[1]))
    return (lex.STREET_TYPES[key], " ".join(words[:i]), " ".join(words[i + 1 :])) if value >= LEAST_TYPE else None


def _behind(text: str) -> dict:
    """Street suffix and locality from what stands behind the street type."""
    m = _DIRECTION.match(text)
    rest = text[m.end() :].strip() if m else text
    return {"in_street_suffix": m.group(1) if m else None, "in_locality": rest or None}


def _quick(text: str, hint: str | None) -> dict | None:
    out: dict = {}
    for pattern in _ENDS:
        if m := pattern.search(text):
            got = m.groupdict()
            out = {"in_state": got.get("state"), "in_postcode": _int(got.get("code"))}
            text = text[: m.start()].strip()
            break
    known = list(_TYPE.finditer(text))
    if not known:
        return None
    last = known[-1]
    if hint and hint != last.group() and _type_of(hint):
        return None  # the comma says that another word is the type
    front = text[: last.start()].strip()
    for i, (pattern, bare) in enumerate(QUICK):
        m = pattern.match(front)
        if m and not (bare and _MARK.search(front, len(front.split(None, 1)[0]))):
            out |= {"in_street_type": lex.STREET_TYPES[last.group()]} | _behind(text[last.end() :].strip())
            return out | _fields(m.groupdict(), blank_street=i == 0)
    return None


def _full(text: str, hint: str | None) -> dict:
    out: dict = {}
    if codes := list(re.finditer(r"\b\d{4}\b", text, re.ASCII)):
        out["in_postcode"] = int(codes[-1].group())
        text = " ".join((text[: codes[-1].start()] + text[codes[-1].end() :]).split())
    if m := re.search(rf"\b(?:{_STATE})\b", text, re.ASCII):
        out["in_state"] = m.group()
        text = " ".join((text[: m.start()] + text[m.end() :]).split())
    if split := _split_at_type(text, hint):
        return out | {"in_street_type": split[0]} | _behind(split[2]) | _front(split[1])
    out |= _front(text)
    words = (out.get("in_street_name") or "").split()
    if len(words) > 1:  # no type at all: the first word is the street
        out |= {"in_street_name": words[0], "in_locality": " ".join(words[1:])}
    return out


_GLUED = re.compile(tx.GLUED, re.ASCII)


def normalise(text: str) -> str:
    """Python twin of functions.text.normalise."""
    text = " ".join(text.upper().replace(",", " ").replace(".", " ").split())
    return _GLUED.sub(r"\1 ", text)


_EXPANSIONS = [(_re(p), word) for p, word in lex.EXPANSIONS]
_ORDINALS = [(_re(rf"\b{n}{lex.ordinal_suffix(n)}\b"), word) for n, word in enumerate(lex.ORDINALS, 1)]
_ANY_EXPANSION, _DIGIT = _re("|".join(f"(?:{p})" for p, _ in lex.EXPANSIONS)), _re(r"\d")


@lru_cache(maxsize=100_000)
def _expanded(name: str, ordinals: bool) -> str:
    """A name with its abbreviations, and ordinals, as words: one look at names that have none, as most have not."""
    patterns = [*(_EXPANSIONS if _ANY_EXPANSION.search(name) else []), *(_ORDINALS if ordinals and _DIGIT.search(name) else [])]
    for pattern, word in patterns:
        name = pattern.sub(word, name)
    return name


def parse_text(text: str | None, normalised: bool = True) -> dict:
    """All fields of one address; a null or blank text has none."""
    out = dict.fromkeys(FIELDS)
    if text is None or not text.strip():
        return out
    m = _HINT.search(" ".join(text.upper().replace(".", " ").split()))
    hint, plain = m.group(1) if m else None, normalise(text)
    if not plain:
        return out
    found = _quick(plain, hint)
    out |= _full(plain, hint) if found is None else found
    if normalised:
        for field in ("in_locality", "in_street_name"):
            if out[field]:
                out[field] = _expanded(out[field], field == "in_street_name")
    return out


_ARROW = pa.struct([(k, pa.int32() if t == "int" else pa.string()) for k, t in FIELDS.items()])


def parsed(text: Column, normalised: bool = True) -> Column:
    """Struct of all fields, by Python. A null text has nulls."""
    none = dict.fromkeys(FIELDS)

    def parse(column: pa.Array) -> pa.Array:
        return pa.array([none if t is None else parse_text(t, normalised) for t in column.to_pylist()], _ARROW)

    return F.arrow_udf(parse, "struct<" + ",".join(f"{k}:{t}" for k, t in FIELDS.items()) + ">")(text)


#: Between the parts of a match; texts that have it go to Python.
_SEP = "\x1f"
_PARTS = ("bld", "word", "letter", "flat", "num", "street")
#: The region of a text: the longest of the four ends begins first.
_REGION = rf"^(?<rest>.*?)\s*\b(?:(?<s1>{_STATE})\s+(?<c1>\d{{4}})|(?<c2>\d{{4}})\s+(?<s2>{_STATE})|(?<s3>{_STATE})|(?<c3>\d{{4}}))$"
#: Words behind the last comma's word that are surely no street type.
_CALM = [w for w in [*lex.DIRECTIONS, *lex.STATES] if _type_of(w) is None]


def _by_letter(words) -> str:
    """A pattern of the words that looks at few of them at a place."""
    heads: dict[str, list[str]] = {}
    for w in words:
        heads.setdefault(w[0], []).append(w[1:])
    return "(?:" + "|".join(f"{c}(?:{lex.alternation(tails)})" for c, tails in heads.items()) + ")"


def _java(pattern: re.Pattern) -> str:
    return pattern.pattern.replace("(?P<", "(?<")


def _put(text: Column, pattern: str, *groups: str) -> Column:
    """Array of the groups' texts, null for blank ones; the text alone if nothing matches. ``a|b`` is whichever took part."""
    by = _SEP.join("".join(f"${{{g}}}" for g in group.split("|") if f"(?<{g}>" in pattern) for group in groups)
    return F.transform(F.split(F.regexp_replace(text, pattern, by), _SEP), lambda part: F.nullif(F.trim(part), F.lit("")))


def with_quick(df: DataFrame, text_col: str, name: str = "quick", normalised: bool = True) -> DataFrame:
    """Adds a struct of all fields by the quick grammar, as column expressions; null for
    texts that it leaves to the full grammar or to Python. Null and blank texts are claimed: they have no field."""
    none = lambda t: F.lit(None).cast(t)
    spaced = tx.squeeze(F.translate(F.upper(F.col(text_col)), ".", " "))
    out = df.withColumns({"_plain": tx.normalise(F.col(text_col)), "_hint": F.regexp_extract(spaced, _HINT.pattern, 1), "_ascii": F.col(text_col).rlike(r"^[\x20-\x7E\t\n\r]*$")})
    out = out.withColumn("_region", _put(F.col("_plain"), _REGION, "rest", "s1|s2|s3", "c1|c2|c3"))
    out = out.withColumn("_cut", _put(F.get("_region", F.lit(0)), rf"^(?<front>.*)\b(?<type>{_by_letter(_KEYS)})\b(?<behind>.*)$", "front", "type", "behind"))
    out = out.withColumn("_front", F.when(F.size("_cut") == 3, F.get("_cut", F.lit(0))))
    marked = F.col("_front").rlike(rf"^\S+(?=\s).*?(?:{_MARK.pattern})")
    parts, nth = none("array<string>"), none("int")
    for i, (pattern, bare) in reversed(list(enumerate(QUICK))):
        fits = F.col("_front").rlike(_java(pattern))
        fits = fits & ~marked if bare else fits
        nth = F.when(fits, i).otherwise(nth)
    out = out.withColumn("_nth", nth)
    for i, (pattern, _) in reversed(list(enumerate(QUICK))):
        parts = F.when(F.col("_nth") == i, _put(F.col("_front"), _java(pattern), *_PARTS[:-1], "street|rest")).otherwise(parts)
    out = out.withColumn("_parts", parts).withColumn("_behind", _put(F.get("_cut", F.lit(2)), rf"{_DIRECTION.pattern.replace('^(', '^(?<dir>')}(?<loc>.*)$", "dir", "loc"))

    bld, word, letter, flat, num, street = (F.get("_parts", F.lit(i)) for i in range(len(_PARTS)))
    lone = bld.isNotNull() & flat.isNotNull() & word.isNull() & bld.rlike(_LETTER.pattern)
    first, last, suffix = tx.split_number(num)
    table = lambda d: F.create_map(*[F.lit(x) for pair in d.items() for x in pair])
    kind = F.coalesce(F.element_at(table(lex.FLAT_TYPES), word), F.when(flat.isNotNull(), F.coalesce(F.element_at(table(lex.ATTACHED), F.when(lone, bld).otherwise(letter)), F.lit("UNIT"))))
    turned = F.size("_behind") == 2
    name_, locality = F.coalesce(street, F.when(F.col("_nth") == 0, "")), F.get("_behind", F.when(turned, 1).otherwise(0))
    if normalised:
        out = out.withColumns({"_name": name_, "_locality": locality})
        out = out.withColumns({"_name": tx.expand(F.col("_name"), ordinals=True), "_locality": tx.expand(F.col("_locality"))})
        name_, locality = F.col("_name"), F.col("_locality")
    hint, found = F.col("_hint"), F.get("_cut", F.lit(1))
    plain_hint = (hint == "") | (hint == found) | hint.rlike(r"^\d+$") | hint.isin(_CALM)
    empty = F.coalesce(F.col("_plain"), F.lit("")) == ""
    claimed = F.coalesce(F.col("_ascii"), F.lit(True)) & (empty | F.coalesce(F.col("_nth").isNotNull() & plain_hint, F.lit(False)))
    values = {
        "in_postcode": F.get("_region", F.lit(2)).try_cast("int"), "in_state": F.get("_region", F.lit(1)), "in_locality": locality, "in_street_name": name_,
        "in_street_type": F.element_at(table(lex.STREET_TYPES), found), "in_street_suffix": F.when(turned, F.get("_behind", F.lit(0))), "in_number_first": first, "in_number_last": last,
        "in_number_suffix": suffix, "in_flat_type": kind, "in_flat_number": flat, "in_building_name": F.when(~F.coalesce(lone, F.lit(False)), bld),
    }
    nothing = F.col("_nth").isNull()
    got = F.struct(*[F.when(nothing, none(t)).otherwise(values[k]).cast(t).alias(k) for k, t in FIELDS.items()])
    return out.withColumn(name, F.when(claimed, got)).select(*df.columns, name)


def parse_addresses(df: DataFrame, text_col: str = "input_raw", id_col: str = "input_id", normalised: bool = True, native: bool = False) -> DataFrame:
    """input_id, input_raw and the twelve fields of each row. ``native`` asks the quick
    grammar as column expressions first, and Python only for what that leaves; the rows are
    the same. It is worth it where Python workers are dear: on one machine it was slower."""
    rows = df.select(F.col(id_col).cast("int").alias("input_id"), F.col(text_col).alias("input_raw"))
    if not native:
        # Parsing is dear and texts are short: they are dealt evenly over tasks, however few files they come from.
        return rows.repartition("input_id", "input_raw").withColumn("p", parsed(F.col("input_raw"), normalised)).select("input_id", "input_raw", "p.*")
    rows = with_quick(rows, "input_raw", "q", normalised).withColumn("p", parsed(F.when(F.col("q").isNull(), F.col("input_raw")), normalised))
    return rows.select("input_id", "input_raw", F.coalesce("q", "p").alias("p")).select("input_id", "input_raw", "p.*")


def standardised() -> Column:
    """The standard text of a parsed row; null if nothing was parsed. A flat type
    without a number is left out; a number's letter follows the first number."""
    flat = F.when(F.col("in_flat_number").isNotNull(), F.concat_ws(" ", "in_flat_type", "in_flat_number"))
    first = F.col("in_number_first").cast("string")
    number = F.concat(first, F.coalesce("in_number_suffix", F.lit("")), F.coalesce(F.concat(F.lit("-"), F.col("in_number_last").cast("string")), F.lit("")))
    tidy = lambda *parts: F.nullif(tx.squeeze(F.concat_ws(" ", *parts)), F.lit(""))
    street = tidy("in_building_name", flat, number, "in_street_name", "in_street_type", "in_street_suffix")
    region = tidy("in_locality", "in_state", F.col("in_postcode").cast("string"))
    return F.nullif(F.concat_ws(", ", street, region), F.lit(""))
