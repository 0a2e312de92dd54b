"""Queries of the text functions and the parser."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon as lex
from ..functions import text as tx
from ..operators import parser
from .catalogue import query
from .fixture import WITH, load

#: Raw texts: number stuck to the street, abbreviations, commas and dots.
_RAW = """SELECT CAST(substring(address_detail_pid, 2, 9) AS INT) AS id, ' ' || CASE WHEN number_first % 3 = 0 THEN CAST(number_first AS VARCHAR(20)) || 'ST. ' WHEN number_first % 3 = 1 THEN CAST(number_first AS VARCHAR(20)) || 'th  ' ELSE coalesce(CAST(number_first AS VARCHAR(20)), '7A') || ' ' END
  || lower(street_name) || ',' || locality_name || '. ' || state AS raw FROM addr"""
_PLAIN = "trim(regexp_replace(translate(upper(raw), ',.', '  '), '\\s+', ' ', 'g'))"


def _rows(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    load(spark, sf_dir)
    return spark.sql(f"{WITH} {sql}")


# The digits are at most two here, so CASE can say which ending is an ordinal's.
_ORDINAL = "(CASE WHEN d IN ('11', '12', '13') THEN 'TH' WHEN right(d, 1) = '1' THEN 'ST' WHEN right(d, 1) = '2' THEN 'ND' WHEN right(d, 1) = '3' THEN 'RD' ELSE 'TH' END)"
_UNGLUED = f"CASE WHEN l <> '' AND l <> {_ORDINAL} THEN trim(d || ' ' || l || rest) ELSE t END"
_SPLIT = f"SELECT id, raw, t, regexp_extract(t, '^(\\d+)([A-Z]{{2,}})?', 1) AS d, regexp_extract(t, '^(\\d+)([A-Z]{{2,}})?', 2) AS l, regexp_replace(t, '^\\d+[A-Z]*', '') AS rest FROM (SELECT id, raw, {_PLAIN} AS t FROM ({_RAW}))"


@query("normalise_text", f"SELECT id, {_UNGLUED} AS plain FROM ({_SPLIT})")
def normalise_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir, _RAW).select("id", tx.normalise(F.col("raw")).alias("plain"))


@query("unglue_numbers", f"SELECT id, {_UNGLUED} AS unglued FROM ({_SPLIT})")
def unglue_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = tx.squeeze(F.translate(F.upper("raw"), ",.", "  "))
    return _rows(spark, sf_dir, _RAW).select("id", tx.unglue(plain).alias("unglued"))


_ABBREVIATED = "SELECT CAST(substring(address_detail_pid, 2, 9) AS INT) AS id, CASE number_first % 6 WHEN 0 THEN 'MT ' WHEN 1 THEN 'N ' WHEN 2 THEN 'ST ' WHEN 3 THEN 'STH ' WHEN 4 THEN '3RD ' ELSE '' END || street_name || CASE number_first % 4 WHEN 0 THEN ' CK' WHEN 1 THEN ' & CO' ELSE '' END AS name FROM addr WHERE number_first IS NOT NULL"
_EXPAND = "name"
for _p, _w in [*lex.EXPANSIONS, *((rf"\b{_n}{lex.ordinal_suffix(_n)}\b", _o) for _n, _o in enumerate(lex.ORDINALS, 1))]:
    _EXPAND = f"regexp_replace({_EXPAND}, '{_p}', '{_w}', 'g')"


@query("expand_abbreviations", f"SELECT id, {_EXPAND} AS expanded FROM ({_ABBREVIATED})")
def expand_abbreviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir, _ABBREVIATED).select("id", tx.expand(F.col("name"), ordinals=True).alias("expanded"))


_TOKENS = "SELECT CAST(substring(address_detail_pid, 2, 9) AS INT) AS id, coalesce(CAST(number_first AS VARCHAR(20)), '7') || CASE WHEN flat_number IS NULL THEN '' ELSE 'B' END || coalesce('-' || CAST(number_last AS VARCHAR(20)), '') AS token FROM addr"


@query("split_number", f"SELECT id, CAST(regexp_extract(token, '^(\\d+)', 1) AS INT) AS first, CAST(nullif(regexp_extract(token, '-(\\d+)', 1), '') AS INT) AS last, nullif(regexp_extract(token, '^\\d+([A-Z]?)', 1), '') AS letter FROM ({_TOKENS})")
def split_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, last, letter = tx.split_number(F.col("token"))
    return _rows(spark, sf_dir, _TOKENS).select("id", first.alias("first"), last.alias("last"), letter.alias("letter"))


_TYPES = "SELECT CAST(substring(address_detail_pid, 2, 9) AS INT) AS id, CASE number_first % 5 WHEN 0 THEN 'ST' WHEN 1 THEN 'CDS' WHEN 2 THEN 'RDS' WHEN 3 THEN 'NOTATYPE' WHEN 4 THEN 'AV' END AS t FROM addr"


@query("canonicalise_types", f"SELECT id, CASE t WHEN 'ST' THEN 'STREET' WHEN 'CDS' THEN 'CUL-DE-SAC' WHEN 'RDS' THEN 'ROAD' WHEN 'AV' THEN 'AVENUE' ELSE t END AS street_type FROM ({_TYPES})")
def canonicalise_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir, _TYPES).select("id", tx.canonical(F.col("t")).alias("street_type"))


_STATES = "|".join(lex.STATES)
_GEO = "SELECT CAST(substring(address_detail_pid, 2, 9) AS INT) AS id, street_name || CASE coalesce(number_first, 0) % 5 WHEN 0 THEN ' ' || state || ' ' || CAST(postcode AS VARCHAR(20)) WHEN 1 THEN ' ' || CAST(postcode AS VARCHAR(20)) || ' ' || state WHEN 2 THEN ' ' || state WHEN 3 THEN ' ' || CAST(postcode AS VARCHAR(20)) ELSE '' END AS t FROM addr"


@query("parse_geo_suffix", f"SELECT id, nullif(regexp_extract(t, ' ({_STATES})( \\d{{4}})?$|\\d{{4}} ({_STATES})$', 1) || regexp_extract(t, '\\d{{4}} ({_STATES})$', 1), '') AS state0, nullif(regexp_extract(t, '\\b(\\d{{4}})( ({_STATES}))?$', 1), '') AS code0 FROM ({_GEO})")
def parse_geo_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = tx.geo_suffix(F.col("t"))
    return _rows(spark, sf_dir, _GEO).select("id", got["state"].alias("state0"), got["postcode"].cast("string").alias("code0"))


_SHAPES = {
    "parse_simple": ("coalesce(CAST(number_first AS VARCHAR(20)), '9') || ' ' || street_name || ' STREET, ' || locality_name || ' ' || state || ' ' || CAST(postcode AS VARCHAR(20))", "CAST(NULL AS VARCHAR)", "CAST(NULL AS VARCHAR)"),
    "parse_slash": ("'3/' || coalesce(CAST(number_first AS VARCHAR(20)), '9') || ' ' || street_name || ' STREET, ' || locality_name || ' ' || state || ' ' || CAST(postcode AS VARCHAR(20))", "'UNIT'", "'3'"),
    "parse_unit_prefix": ("'APT 4A ' || coalesce(CAST(number_first AS VARCHAR(20)), '9') || ' ' || street_name || ' STREET, ' || locality_name || ' ' || state || ' ' || CAST(postcode AS VARCHAR(20))", "'APARTMENT'", "'4A'"),
}


def _shape(name: str, text: str, kind: str, flat: str) -> None:
    sql = f"SELECT CAST(substring(address_detail_pid, 2, 9) AS INT) AS input_id, coalesce(number_first, 9) AS in_number_first, {kind} AS in_flat_type, {flat} AS in_flat_number, street_name AS in_street_name, 'STREET' AS in_street_type, regexp_replace(locality_name, '^(WEST|UPPER) ', '') AS in_locality, nullif(regexp_extract(locality_name, '^(WEST|UPPER) ', 1), '') AS in_street_suffix, state AS in_state, postcode AS in_postcode FROM addr"

    @query(name, sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _rows(spark, sf_dir, f"SELECT CAST(substring(address_detail_pid, 2, 9) AS INT) AS input_id, {text} AS input_raw FROM addr")
        return parser.parse_addresses(rows).select("input_id", "in_number_first", "in_flat_type", "in_flat_number", "in_street_name", "in_street_type", "in_locality", "in_street_suffix", "in_state", "in_postcode")


for _name, _parts in _SHAPES.items():
    _shape(_name, *_parts)


@query("parse_full")
def parse_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    (addr,) = load(spark, sf_dir, "addr")
    return parser.parse_addresses(addr.select(F.expr("CAST(substring(address_detail_pid, 2, 9) AS INT)").alias("input_id"), F.col("address_label").alias("input_raw")))


#: Six shapes of text; the last says with a comma that another word is the street's type.
_QUICK_TEXTS = """SELECT CAST(substring(address_detail_pid, 2, 9) AS INT) AS input_id, CAST(substring(address_detail_pid, 2, 9) AS INT) % 6 AS shape, CAST(substring(address_detail_pid, 2, 9) AS INT) % 90 + 1 AS n, street_name, locality_name, state, postcode,
  CASE CAST(substring(address_detail_pid, 2, 9) AS INT) % 6 WHEN 0 THEN 'Tower 7B/' WHEN 1 THEN 'lvl 4 ' WHEN 2 THEN 'F8 ' WHEN 3 THEN '12 ' ELSE '' END || CAST(CAST(substring(address_detail_pid, 2, 9) AS INT) % 90 + 1 AS VARCHAR(20)) || CASE CAST(substring(address_detail_pid, 2, 9) AS INT) % 6 WHEN 4 THEN ' A1 ' WHEN 5 THEN 'C-95 ' ELSE ' ' END
  || lower(street_name) || ' St.' || CASE CAST(substring(address_detail_pid, 2, 9) AS INT) % 6 WHEN 5 THEN ', ' ELSE ' Upper ' END || locality_name || CASE postcode % 3 WHEN 0 THEN ' ' || state || ' ' || CAST(postcode AS VARCHAR(20)) WHEN 1 THEN ' ' || CAST(postcode AS VARCHAR(20)) || ' ' || lower(state) ELSE '' END AS input_raw FROM addr"""
_FAR = "CASE WHEN shape = 5 THEN nullif(regexp_extract(locality_name, '^(WEST|UPPER) ', 1), '') ELSE 'UPPER' END"
#: A locality's last word may be a type, GROVE, and is one where no comma says otherwise.
_GROVE = "locality_name LIKE '% GROVE'"
_FIRST = "street_name || ' ST UPPER ' || regexp_replace(locality_name, ' GROVE$', '')"


@query("parse_quick", f"""SELECT input_id, NOT (shape = 5 AND {_GROVE}) AS claimed, CASE WHEN NOT (shape = 5 AND {_GROVE}) THEN n END AS in_number_first,
  CASE WHEN shape = 5 AND NOT {_GROVE} THEN 95 END AS in_number_last, CASE WHEN shape = 5 AND NOT {_GROVE} THEN 'C' END AS in_number_suffix,
  CASE shape WHEN 0 THEN 'UNIT' WHEN 1 THEN 'LEVEL' WHEN 2 THEN 'FLAT' WHEN 3 THEN 'UNIT' WHEN 4 THEN 'APARTMENT' END AS in_flat_type, CASE shape WHEN 0 THEN '7B' WHEN 1 THEN '4' WHEN 2 THEN '8' WHEN 3 THEN '12' WHEN 4 THEN '1' END AS in_flat_number,
  CASE WHEN shape = 0 THEN 'TOWER' END AS in_building_name, CASE WHEN shape = 5 AND {_GROVE} THEN NULL WHEN {_GROVE} THEN {_FIRST} ELSE street_name END AS in_street_name,
  CASE WHEN shape = 5 AND {_GROVE} THEN NULL WHEN {_GROVE} THEN 'GROVE' ELSE 'STREET' END AS in_street_type, CASE WHEN NOT {_GROVE} THEN {_FAR} END AS in_street_suffix,
  CASE WHEN {_GROVE} THEN NULL WHEN shape = 5 THEN regexp_replace(locality_name, '^(WEST|UPPER) ', '') ELSE locality_name END AS in_locality,
  CASE WHEN postcode % 3 < 2 AND NOT (shape = 5 AND {_GROVE}) THEN state END AS in_state, CASE WHEN postcode % 3 < 2 AND NOT (shape = 5 AND {_GROVE}) THEN postcode END AS in_postcode FROM ({_QUICK_TEXTS})""")
def parse_quick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quick grammar as column expressions: whether it claims a text, and the fields as they are written."""
    got = parser.with_quick(_rows(spark, sf_dir, _QUICK_TEXTS), "input_raw", normalised=False)
    return got.select("input_id", F.col("quick").isNotNull().alias("claimed"), *[F.col("quick")[k].alias(k) for k in parser.FIELDS])


@query("standardise_input", "SELECT input_id, nullif(concat_ws(', ', nullif(concat_ws(' ', in_flat_number, CAST(in_number_first AS VARCHAR) || coalesce(in_number_suffix, ''), in_street_name, in_street_type), ''), nullif(concat_ws(' ', in_locality, in_state, CAST(in_postcode AS VARCHAR)), '')), '') AS input_standardised FROM inp")
def standardise_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.matching import inputs_of

    (inp,) = load(spark, sf_dir, "inp")
    return inputs_of(inp).select("input_id", parser.standardised().alias("input_standardised"))
