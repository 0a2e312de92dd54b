"""The queries over the derived fixture, each with its oracle where SQL has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import similarity as sim
from ..functions import text as tx
from ..operators import matching as m
from ..operators import scoring as sc
from ..operators.nearest import nearest_names
from . import oracle as o
from .fixture import WITH, load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_RESULT = ["input_id", "address_detail_pid", *sc.SCORES, "total_score", "match_rank"]
_POSTCODE, _STATE = "g.postcode = i.in_postcode", "g.state = i.in_state"
_OWN_WEIGHTS = {"postcode": 30, "suburb": 20, "street": 20, "type": 10, "number": 15, "flat": 5}


def query(name: str, sql: str | None = None, fixture: bool = True):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = f"{WITH} {sql}" if fixture else sql
        return f

    return add


def _path(path, spark, sf_dir, table="addr", **kw) -> DataFrame:
    inp, addr = load(spark, sf_dir, "inp", table)
    return path(m.inputs_of(inp), m.candidates_of(addr), **kw).select(*_RESULT)


@query("match_postcode_top1", f"SELECT i.input_id, address_detail_pid, score_postcode, score_suburb, score_street_name, score_street_type, score_number, score_flat, total_score, match_rank, address_detail_pid IS NOT NULL AS matched, CASE WHEN address_detail_pid IS NOT NULL THEN 'matched' WHEN i.in_street_name IS NULL OR (i.in_postcode IS NULL AND i.in_state IS NULL AND i.in_locality IS NULL) THEN 'insufficient_parse' ELSE 'no_candidate' END AS match_status FROM inp i LEFT JOIN ({o.path('inp', 'addr', _POSTCODE)}) r ON r.input_id = i.input_id")
def match_postcode_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    inp, addr = load(spark, sf_dir, "inp", "addr")
    found = m.postcode_path(m.inputs_of(inp), m.candidates_of(addr))
    return m.attach(m.inputs_of(inp), found).select(*_RESULT, "matched", "match_status")


def _simple(name, path, on, table="addr", sql_kw=None, **kw):
    query(name, o.path("inp", table, on, **(sql_kw or {})))(lambda spark, sf_dir: _path(path, spark, sf_dir, table, **kw))


_simple("match_postcode_topk3", m.postcode_path, _POSTCODE, sql_kw={"k": 3, "floor": 40}, max_results=3, min_score=40)
_simple("match_state_path", m.state_path, _STATE)
_simple("match_postcode_bounded", m.postcode_path, _POSTCODE, sql_kw={"k": 3, "floor": 40}, max_results=3, min_score=40, bounded=True)
_simple("match_state_indexed", m.state_path, _STATE, bounded=True)
_simple("match_custom_weights", m.postcode_path, _POSTCODE, sql_kw={"w": _OWN_WEIGHTS, "k": 2}, weights=_OWN_WEIGHTS, max_results=2)
_simple("match_alias_filter_null", m.postcode_path, _POSTCODE, sql_kw={"where": "g.alias_type IS NULL"}, alias_types=[None])
_simple("match_alias_filter_in", m.postcode_path, _POSTCODE, sql_kw={"where": "g.alias_type IN ('LOCALITY:SYN')"}, alias_types=["LOCALITY:SYN"])
_simple("match_alias_filter_both", m.postcode_path, _POSTCODE, sql_kw={"where": "(g.alias_type IS NULL OR g.alias_type IN ('LOCALITY:SYN'))"}, alias_types=[None, "LOCALITY:SYN"])
_simple("match_alias_filter_none", m.postcode_path, _POSTCODE, sql_kw={"where": "1 = 0"}, alias_types=[])


@query("match_locality_fallback", f", ix AS ({o.INDEX}), wide AS ({o.widened('inp', 'ix')}) {o.path('wide', 'addr', 'g.postcode = i.alt_postcode')}")
def match_locality_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    inp, addr, cust = load(spark, sf_dir, "inp", "addr", "cust")
    index = m.locality_index(addr, cust)
    return m.locality_path(m.inputs_of(inp), m.candidates_of(addr), index).select(*_RESULT)


@query("match_exact_label", "SELECT i.input_id, g.address_detail_pid, g.address_label FROM inp i JOIN addr g ON upper(trim(g.address_label)) = upper(trim(i.input_raw))")
def match_exact_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    inp, addr = load(spark, sf_dir, "inp", "addr")
    return m.exact_path(m.inputs_of(inp).join(inp.select("input_id", "input_raw"), "input_id"), m.candidates_of(addr)).select("input_id", "address_detail_pid", "address_label")


@query("combine_core_custom", o.best_of([o.path("inp", "addr", _POSTCODE, 3), o.path("inp", "cust", _POSTCODE, 3)], 3))
def combine_core_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.combine([_path(m.postcode_path, spark, sf_dir, t, max_results=3) for t in ("addr", "cust")], 3).select(*_RESULT)


@query("path_diagnostics", f"SELECT input_id, count(*) AS retained_count, max(total_score) AS best_score FROM ({o.path('inp', 'addr', _POSTCODE, 5, 30)}) GROUP BY input_id")
def path_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.diagnostics(_path(m.postcode_path, spark, sf_dir, max_results=5, min_score=30))


@query("match_summary", f"SELECT count(DISTINCT i.input_id) AS inputs, count(DISTINCT r.input_id) AS matched_inputs, count(r.input_id) AS result_rows, round(avg(CASE WHEN match_rank = 1 THEN total_score END), 1) AS avg_top_score, round(100 * count(DISTINCT r.input_id) / count(DISTINCT i.input_id), 1) AS match_rate FROM inp i LEFT JOIN ({o.path('inp', 'addr', _POSTCODE, 2)}) r ON r.input_id = i.input_id")
def match_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    inp, addr = load(spark, sf_dir, "inp", "addr")
    return m.summary(m.attach(m.inputs_of(inp), m.postcode_path(m.inputs_of(inp), m.candidates_of(addr), max_results=2)))


@query("match_unmatched_status", f"SELECT CASE WHEN r.input_id IS NOT NULL THEN 'matched' WHEN i.in_street_name IS NULL OR (i.in_postcode IS NULL AND i.in_state IS NULL AND i.in_locality IS NULL) THEN 'insufficient_parse' ELSE 'no_candidate' END AS match_status, count(*) AS n FROM inp i LEFT JOIN ({o.path('inp', 'addr', _POSTCODE, 1, 80)}) r ON r.input_id = i.input_id GROUP BY 1")
def match_unmatched_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    inp, addr = load(spark, sf_dir, "inp", "addr")
    out = m.attach(m.inputs_of(inp), m.postcode_path(m.inputs_of(inp), m.candidates_of(addr), min_score=80))
    return out.groupBy("match_status").agg(F.count("*").alias("n"))


@query("number_gate_branches", f"SELECT i.input_id, g.address_detail_pid FROM inp i JOIN addr g ON {_POSTCODE} WHERE {o.GATE}")
def number_gate_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    inp, addr = load(spark, sf_dir, "inp", "addr")
    return m.block(m.inputs_of(inp), m.candidates_of(addr), "in_postcode", "postcode").select("input_id", "address_detail_pid")


@query("score_components", f"SELECT i.input_id, g.address_detail_pid, {o.scores()} FROM inp i JOIN addr g ON CAST(substring(g.address_detail_pid, 2, 9) AS INT) = i.input_id")
def score_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    inp, addr = load(spark, sf_dir, "inp", "addr")
    pairs = m.inputs_of(inp).join(m.candidates_of(addr), F.expr("CAST(substring(address_detail_pid, 2, 9) AS INT) = input_id"))
    return sc.with_scores(pairs).select("input_id", "address_detail_pid", *sc.SCORES)


#: Each input's street with the streets of its postcode: names of all kinds of likeness.
_NAMES = "SELECT DISTINCT i.in_street_name AS a, g.street_name AS b FROM inp i JOIN addr g ON g.postcode = coalesce(i.in_postcode, 4000) WHERE i.in_street_name IS NOT NULL"


def _names(inputs: DataFrame, addresses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Different names a of inputs and b of addresses, by postcode."""
    asked = inputs.where("in_street_name is not null").select(F.coalesce("in_postcode", F.lit(4000)).alias("block"), F.col("in_street_name").alias("a")).distinct()
    return asked, addresses.select(F.col("postcode").alias("block"), F.col("street_name").alias("b")).distinct()


def name_pairs(inputs: DataFrame, addresses: DataFrame) -> DataFrame:
    """The different pairs a, b of _NAMES. Each postcode's different names meet, not its rows."""
    asked, there = _names(inputs, addresses)
    return asked.join(there, "block").select("a", "b").distinct()


@query("jw_pairs", f"SELECT a, b, round(jaro_winkler_similarity(a, b), 6) AS jw FROM ({_NAMES})")
def jw_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return name_pairs(*load(spark, sf_dir, "inp", "addr")).select("a", "b", F.round(sim.jw(F.col("a"), F.col("b")), 6).alias("jw"))


@query("jw_winner_per_name", f"SELECT a, b, jw FROM (SELECT a, b, jw, row_number() OVER (PARTITION BY a ORDER BY jw DESC, b) AS n FROM (SELECT a, b, round(jaro_winkler_similarity(a, b), 6) AS jw FROM ({_NAMES}))) WHERE n = 1")
def jw_winner_per_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_names(*_names(*load(spark, sf_dir, "inp", "addr")))


@query("bigram_jaccard", f"SELECT a, b, round(len(list_intersect(x, y)) / nullif(len(list_distinct(list_concat(x, y))), 0), 6) AS jaccard FROM (SELECT a, b, list_distinct([substring(a, CAST(k AS INT), 2) FOR k IN range(1, length(a))]) AS x, list_distinct([substring(b, CAST(k AS INT), 2) FOR k IN range(1, length(b))]) AS y FROM ({_NAMES}))")
def bigram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return name_pairs(*load(spark, sf_dir, "inp", "addr")).select("a", "b", F.round(sim.bigram_jaccard(F.col("a"), F.col("b")), 6).alias("jaccard"))


from . import catalogue_store, catalogue_text  # noqa: E402, F401
