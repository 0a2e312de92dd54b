"""Queries of the tables, ingest, cache, perturbation and spatial operators."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cache as ca
from ..operators import diagnostics, parser, perturb, projection, spatial
from ..operators import matching as m
from ..operators import tables as tb
from ..scratch import shared_dir
from ..sources import ingest
from ..sources.versions import VersionedTable
from . import oracle as o
from .catalogue import query
from .fixture import WITH, load


def _sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    load(spark, sf_dir)
    return spark.sql(f"{WITH} {sql}")


# -- tables -------------------------------------------------------------------

_KEY = "CAST(substring(address_detail_pid, 2, 9) AS INT)"
_OLD = f"SELECT address_detail_pid, street_name, street_type, postcode, 'core' AS source FROM addr WHERE {_KEY} % 3 <> 0"
_NEW = f"SELECT address_detail_pid, street_name, 'LANE' AS street_type, postcode + 1 AS postcode, 'new' AS source FROM addr WHERE {_KEY} % 2 = 0"


@query("insert_ignore", f"SELECT * FROM ({_OLD}) UNION ALL SELECT * FROM ({_NEW}) WHERE address_detail_pid NOT IN (SELECT address_detail_pid FROM ({_OLD}))")
def insert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tb.insert_ignore(_sql(spark, sf_dir, _OLD), _sql(spark, sf_dir, _NEW), "address_detail_pid")


@query("upsert", f"SELECT coalesce(a.address_detail_pid, b.address_detail_pid) AS address_detail_pid, CASE WHEN b.address_detail_pid IS NOT NULL THEN b.street_name ELSE a.street_name END AS street_name, CASE WHEN b.address_detail_pid IS NOT NULL THEN b.street_type ELSE a.street_type END AS street_type, CASE WHEN b.address_detail_pid IS NOT NULL THEN b.postcode ELSE a.postcode END AS postcode, coalesce(a.source, b.source) AS source FROM ({_OLD}) a FULL JOIN ({_NEW}) b ON a.address_detail_pid = b.address_detail_pid")
def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tb.upsert(_sql(spark, sf_dir, _OLD), _sql(spark, sf_dir, _NEW))


#: What a table was in its versions: made, rows of new ids added, all rows of ids upserted, some deleted.
_HISTORY = f"""v0 AS ({_OLD}), v1 AS (SELECT * FROM v0 UNION ALL SELECT * FROM ({_NEW}) WHERE address_detail_pid NOT IN (SELECT address_detail_pid FROM v0)),
v2 AS (SELECT address_detail_pid, street_name, CASE WHEN b.k IS NOT NULL THEN 'MALL' ELSE street_type END AS street_type, CASE WHEN b.k IS NOT NULL THEN postcode + 2 ELSE postcode END AS postcode, source FROM v1 LEFT JOIN (SELECT address_detail_pid AS k FROM ({_NEW}) WHERE {_KEY} % 4 = 0) b ON b.k = address_detail_pid),
v3 AS (SELECT * FROM v2 WHERE postcode IS NULL OR postcode % 3 <> 0)"""


@query("store_versions", f", {_HISTORY} " + " UNION ALL ".join(f"SELECT {i} AS version, * FROM v{i}" for i in range(4)))
def store_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every version of a table that is made, appended to, upserted and deleted from; read from its log."""
    old, new = _sql(spark, sf_dir, _OLD), _sql(spark, sf_dir, _NEW)
    schema = {"address_detail_pid": "string", "street_name": "string", "street_type": "string", "postcode": "int", "source": "string"}
    t = VersionedTable(spark, f"{shared_dir(spark)}/versions-{uuid.uuid4().hex}", schema, "address_detail_pid", ["address_detail_pid"])
    t.replace(lambda _: old)
    t.append(lambda held: tb.new_rows(held, new, "address_detail_pid"))
    again = _sql(spark, sf_dir, f"SELECT address_detail_pid, street_name, 'MALL' AS street_type, postcode + CASE WHEN {_KEY} % 3 = 0 THEN 2 ELSE 1 END AS postcode, 'third' AS source FROM ({_NEW}) WHERE {_KEY} % 4 = 0")
    t.upsert(lambda _: again, tb.KEPT)
    t.delete(condition=F.col("postcode") % 3 == 0)
    return reduce(DataFrame.unionByName, [t.read(v).withColumn("version", F.lit(v)) for v in range(4)])


@query("delete_by_pid", f"SELECT address_detail_pid FROM ({_OLD}) WHERE address_detail_pid NOT IN (SELECT address_detail_pid FROM ({_NEW}))")
def delete_by_pid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tb.delete_keys(_sql(spark, sf_dir, _OLD), _sql(spark, sf_dir, _NEW)).select("address_detail_pid")


@query("predicate_delete", "SELECT address_detail_pid, alias_type FROM addr WHERE alias_type IS NULL OR alias_type <> 'LOCALITY:SYN'")
def predicate_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    (addr,) = load(spark, sf_dir, "addr")
    return tb.delete_where(addr, F.col("alias_type") == "LOCALITY:SYN").select("address_detail_pid", "alias_type")


@query("locality_index", o.INDEX)
def locality_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.locality_index(*load(spark, sf_dir, "addr", "cust"))


_ALIASES = """SELECT 'SO_' || md5(coalesce(street_name, '') || '|' || coalesce(street_type, '') || '||' || coalesce(locality_name, '') || '|' || coalesce(state, '') || '|' || coalesce(CAST(postcode AS VARCHAR), '')) AS address_detail_pid,
  concat_ws(' ', street_name, street_type) || ', ' || concat_ws(' ', locality_name, state, CAST(postcode AS VARCHAR)) AS address_label, street_name, street_type, locality_name, state, postcode, 'street_only' AS alias_type, CAST(NULL AS INT) AS number_first, CAST(NULL AS INT) AS number_last, CAST(NULL AS VARCHAR) AS flat_number
FROM (SELECT DISTINCT street_name, street_type, locality_name, state, postcode FROM addr WHERE alias_type IS NULL AND street_name IS NOT NULL AND locality_name IS NOT NULL AND postcode IS NOT NULL AND state IS NOT NULL)"""


def _aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    (addr,) = load(spark, sf_dir, "addr")
    return tb.street_aliases(tb.aligned(addr.withColumn("source", F.lit(tb.CORE)), tb.ADDRESS))


@query("street_aliases", f"SELECT address_detail_pid, address_label, alias_type FROM ({_ALIASES})")
def street_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _aliases(spark, sf_dir).select("address_detail_pid", "address_label", "alias_type")


@query("match_street_only", f", so AS ({_ALIASES}) {o.path('inp', 'so', 'g.postcode = i.in_postcode', gate=False)}")
def match_street_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    (inp,) = load(spark, sf_dir, "inp")
    out = m.street_only_path(m.inputs_of(inp), m.candidates_of(_aliases(spark, sf_dir)))
    return out.select("input_id", "address_detail_pid", *[f"score_{p}" for p in ("postcode", "suburb", "street_name", "street_type", "number", "flat")], "total_score", "match_rank")


@query("alias_frequency", "SELECT alias_type, count(*) AS n FROM addr GROUP BY alias_type")
def alias_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    (addr,) = load(spark, sf_dir, "addr")
    return addr.groupBy("alias_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"))


@query("table_status", "SELECT 'addresses' AS table_name, count(*) AS row_count FROM addr UNION ALL SELECT 'custom_addresses', count(*) FROM cust UNION ALL SELECT 'missing', NULL")
def table_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    addr, cust = load(spark, sf_dir, "addr", "cust")
    return tb.status({"addresses": addr, "custom_addresses": cust, "missing": None})


@query("custom_rows", "SELECT 'CUSTOM_' || CAST(row_number() OVER (ORDER BY lower(street_name), street_type NULLS FIRST, locality_name, state, postcode, number_first NULLS FIRST) AS VARCHAR) AS address_detail_pid, upper(trim(' ' || lower(street_name))) AS street_name, number_first, postcode, 'custom' AS source, CAST(NULL AS VARCHAR) AS alias_type FROM cust")
def custom_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    addr, cust = load(spark, sf_dir, "addr", "cust")
    rows = cust.select(F.concat(F.lit(" "), F.lower("street_name")).alias("street_name"), "street_type", "locality_name", "state", "postcode", "number_first")
    return tb.custom_rows(rows, addr).select("address_detail_pid", "street_name", "number_first", "postcode", "source", "alias_type")


@query("sample_rows", "SELECT * FROM addr ORDER BY md5('7|' || address_detail_pid) LIMIT 10")
def sample_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    (addr,) = load(spark, sf_dir, "addr")
    return tb.sample_rows(addr, 10, seed=7)


@query("perturb_sample")
def perturb_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    (addr,) = load(spark, sf_dir, "addr")
    return perturb.perturb_sample(addr, 50, seed=7).select("address_detail_pid", "address_label", "simulated_address", "perturbations")


_FOUND = f"SELECT i.input_id, i.input_raw, g.address_label FROM inp i LEFT JOIN (SELECT r.input_id, a.address_label FROM ({o.path('inp', 'addr', 'g.postcode = i.in_postcode')}) r JOIN addr a ON a.address_detail_pid = r.address_detail_pid) g ON g.input_id = i.input_id"


def _normal(c: str) -> str:
    """No word of these labels has digits and letters stuck together but for one letter."""
    return f"trim(regexp_replace(translate(upper({c}), ',.', '  '), '\\s+', ' ', 'g'))"


def _grams(c: str) -> str:
    return f"list_distinct([substring({c}, CAST(k AS INT), 2) FOR k IN range(1, length({c}))])"


@query("text_jaccard", f"SELECT input_id, address_label, CASE WHEN b IS NOT NULL THEN round(100 * (len(list_intersect({_grams('a')}, {_grams('b')})) / len(list_distinct(list_concat({_grams('a')}, {_grams('b')})))), 1) END AS text_jaccard FROM (SELECT input_id, address_label, {_normal('input_raw')} AS a, {_normal('address_label')} AS b FROM ({_FOUND}))")
def text_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_diagnostics(spark, sf_dir).select("input_id", "address_label", "text_jaccard")


#: No SQL: its Jaro-Winkler counts transpositions in halves, as DuckDB's does not.
@query("text_diagnostics")
def text_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    inp, addr = load(spark, sf_dir, "inp", "addr")
    found = m.attach(inp.select("input_id", "input_raw", *[c for c in inp.columns if c.startswith("in_")]), m.postcode_path(m.inputs_of(inp), m.candidates_of(addr)))
    return diagnostics.add_text_diagnostics(found).select("input_id", "address_label", "text_jw", "text_jaccard", "text_similarity")


# -- full pipeline ------------------------------------------------------------

_STATUS = "address_detail_pid IS NOT NULL AS matched, CASE WHEN address_detail_pid IS NOT NULL THEN 'matched' WHEN i.in_street_name IS NULL OR (i.in_postcode IS NULL AND i.in_state IS NULL AND i.in_locality IS NULL) THEN 'insufficient_parse' ELSE 'no_candidate' END AS match_status"


def _paths(inputs: str, k: int = 1) -> str:
    """Common table expressions of the postcode, state and locality paths."""
    code = o.path(f"(SELECT * FROM {inputs} WHERE in_postcode IS NOT NULL)", "al", "g.postcode = i.in_postcode", k)
    none = o.path(f"(SELECT * FROM {inputs} WHERE in_postcode IS NULL)", "al", "g.state = i.in_state", k)
    return f"""ix AS ({o.INDEX}), pr AS ({code}), sr AS ({none}),
weak AS (SELECT * FROM {inputs} WHERE in_locality IS NOT NULL AND (in_postcode IS NULL OR input_id NOT IN (SELECT input_id FROM pr WHERE total_score > 90))), wide AS ({o.widened("weak", "ix")}),
lr AS ({o.path("wide", "al", "g.postcode = i.alt_postcode", 2 * k)})"""


@query("match_block_paths", f", al AS (SELECT * FROM addr UNION ALL SELECT * FROM cust), {_paths('inp')}, br AS ({o.best_of(['SELECT * FROM pr', 'SELECT * FROM sr', 'SELECT * FROM lr'], 1)}) SELECT i.input_id, address_detail_pid, total_score, match_rank, {_STATUS} FROM inp i LEFT JOIN br ON br.input_id = i.input_id")
def match_block_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The postcode, state and locality paths alone: no raw text, no cache, no street-only records."""
    inp, addr, cust = (t.persist() for t in load(spark, sf_dir, "inp", "addr", "cust"))  # they stand for stored tables
    parsed = m.inputs_of(inp).withColumn("input_raw", F.lit(None).cast("string"))
    out = m.match_parsed(parsed, addr, cust, m.locality_index(addr, cust), m.Settings())
    return out.select("input_id", "address_detail_pid", "total_score", "match_rank", "matched", "match_status")


#: Raw texts of the inputs: every fourth is a label, the others are damaged. Their parts are such
#: that SQL knows what the parser makes of them.
_KEYED = "SELECT CAST(substring(address_detail_pid, 2, 9) AS INT) AS k, a.* FROM addr a"
_TEXTS = f"""SELECT k AS input_id, k % 4 = 0 AS exact, CASE WHEN k % 4 = 0 THEN address_label ELSE concat_ws(' ', CAST(k % 60 + 1 AS VARCHAR(20)), street, 'STREET,', locality, state, code) END AS input_raw,
  k % 60 + 1 AS n, number_last, flat_number, number_first IS NULL AS lettered, street, locality, state, code
FROM (SELECT k, address_label, number_first, number_last, flat_number, state,
  CASE WHEN k % 4 <> 0 AND k % 37 = 1 THEN 'Q ' || street_name ELSE street_name END AS street,
  CASE WHEN k % 4 <> 0 AND k % 5 = 1 THEN substring(locality_name, 1, length(locality_name) - 1) ELSE locality_name END AS locality,
  CASE WHEN k % 4 <> 0 AND k % 7 = 0 THEN NULL WHEN k % 4 <> 0 AND k % 7 = 3 THEN '9999' ELSE CAST(postcode AS VARCHAR(20)) END AS code
  FROM ({_KEYED}) s WHERE k % 3 = 0) d"""
_PARSED = f"""SELECT input_id, input_raw, TRY_CAST(code AS INT) AS in_postcode, state AS in_state, regexp_replace(locality, '^(WEST|UPPER) ', '') AS in_locality, nullif(regexp_extract(locality, '^(WEST|UPPER) ', 1), '') AS in_street_suffix,
  street AS in_street_name, 'STREET' AS in_street_type, n AS in_number_first, CASE WHEN exact THEN number_last END AS in_number_last, CASE WHEN exact AND lettered THEN 'A' END AS in_number_suffix, CASE WHEN exact THEN flat_number END AS in_flat_number FROM ({_TEXTS}) t"""
_STANDARD = "concat_ws(', ', concat_ws(' ', 'UNIT ' || in_flat_number, concat(in_number_first, in_number_suffix, '-' || in_number_last), in_street_name, in_street_type, in_street_suffix), concat_ws(' ', in_locality, in_state, CAST(in_postcode AS VARCHAR)))"
#: The store's entries: standard texts of inputs, each with the record of another customer.
_ENTRIES = "SELECT 'A' || lpad(CAST(CAST(n % 700 + 1 AS INT) AS VARCHAR(20)), 9, '0') AS address_detail_pid, input_standardised, CAST(97 AS INT) AS total_score FROM (SELECT input_id AS n, {standard} AS input_standardised FROM {parsed} WHERE input_id % 10 = 3) e"


@query("match_full_pipeline", f""", so AS ({{aliases}}), tx AS ({_PARSED}), st AS (SELECT *, {_STANDARD} AS input_standardised FROM tx),
al AS (SELECT * FROM addr UNION ALL SELECT * FROM cust UNION ALL BY NAME SELECT * FROM so),
ex AS (SELECT i.input_id, g.address_detail_pid, {o.scores()} FROM tx i JOIN al g ON upper(trim(g.address_label)) = upper(trim(i.input_raw))),
exact AS (SELECT input_id, address_detail_pid, CAST({o.TOTAL} AS INT) AS total_score FROM ex),
hits AS (SELECT st.input_id, c.address_detail_pid, c.total_score FROM st JOIN ({_ENTRIES.format(standard="input_standardised", parsed="st")}) c USING (input_standardised) JOIN al g ON g.address_detail_pid = c.address_detail_pid WHERE st.input_id NOT IN (SELECT input_id FROM exact)),
rest AS (SELECT * FROM tx WHERE input_id NOT IN (SELECT input_id FROM exact) AND input_id NOT IN (SELECT input_id FROM hits)), {_paths("rest", 2)},
found AS (SELECT * FROM exact UNION ALL SELECT * FROM hits UNION ALL SELECT input_id, address_detail_pid, total_score FROM pr UNION ALL SELECT input_id, address_detail_pid, total_score FROM sr UNION ALL SELECT input_id, address_detail_pid, total_score FROM lr),
orr AS (SELECT input_id, address_detail_pid, total_score FROM ({o.path("(SELECT * FROM rest WHERE in_postcode IS NOT NULL AND in_street_name IS NOT NULL AND input_id NOT IN (SELECT input_id FROM found))", "so", "g.postcode = i.in_postcode", 2, gate=False)})),
br AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY input_id ORDER BY total_score DESC, address_detail_pid) AS INT) AS match_rank FROM (SELECT input_id, address_detail_pid, max(total_score) AS total_score FROM (SELECT * FROM found UNION ALL SELECT * FROM orr) GROUP BY ALL)) WHERE match_rank <= 2)
SELECT i.input_id, i.input_standardised, address_detail_pid, total_score, match_rank, {_STATUS} FROM st i LEFT JOIN br ON br.input_id = i.input_id""".replace("{aliases}", _ALIASES))
def match_full_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All six paths, from raw text: parser, exact label, cache, postcode, state, locality, street-only records."""
    addr, cust = (t.persist() for t in load(spark, sf_dir, "addr", "cust"))  # they stand for stored tables
    core = m.candidates_of(addr).unionByName(m.candidates_of(_aliases(spark, sf_dir))).persist()
    texts = _sql(spark, sf_dir, f"SELECT input_id, input_raw FROM ({_TEXTS}) t")
    parsed = parser.parse_addresses(texts, normalised=False).withColumn("input_standardised", parser.standardised())

    def hits(inputs: DataFrame) -> DataFrame:
        entries = inputs.where("input_id % 10 = 3").select(F.format_string("A%09d", F.col("input_id") % 700 + 1).alias("address_detail_pid"), "input_standardised", F.lit(97).alias("total_score"))
        return ca.probe(inputs, tb.aligned(entries, tb.CACHE), core.unionByName(m.candidates_of(cust)))

    out = m.match_parsed(parsed, core, cust, m.locality_index(addr, cust), m.Settings(max_results=2, street_only_fallback=True), hits)
    return out.select("input_id", "input_standardised", "address_detail_pid", "total_score", "match_rank", "matched", "match_status")


# -- cache --------------------------------------------------------------------

_CACHE = "SELECT 'k' || CAST(event_id % 500 AS VARCHAR(20)) AS input_standardised, 'A' || lpad(CAST(event_id % 700 AS VARCHAR(20)), 9, '0') AS address_detail_pid, CAST(floor(value) AS INT) AS total_score, ts AS cached_at FROM events WHERE event_id < 500"
#: The store that the probe runs on: all events; of equal keys the first event's entry counts.
_STORED = "SELECT event_id, 'k' || CAST(event_id % 500 AS VARCHAR(20)) AS input_standardised, 'A' || lpad(CAST(event_id % 700 AS VARCHAR(20)), 9, '0') AS address_detail_pid, CAST(floor(value) AS INT) AS total_score, ts AS cached_at FROM events"
_EVENTS = "SELECT CAST(floor(value) AS INT) AS total_score, ts AS cached_at FROM events"


@query("cache_status", f"SELECT count(*) AS cached_rows, min(cached_at) AS oldest, max(cached_at) AS newest FROM ({_EVENTS})")
def cache_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ca.status(_sql(spark, sf_dir, _EVENTS))


def _history(by: str, bucket: str) -> None:
    @query(f"cache_history_{by}", f"SELECT {bucket} AS bucket, count(*) AS entries, min(total_score) AS min_score, round(avg(total_score), 6) AS avg_score, max(total_score) AS max_score FROM ({_EVENTS}) GROUP BY 1")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return ca.history(_sql(spark, sf_dir, _EVENTS), by)


_history("day", "CAST(cached_at AS DATE)")
_history("hour", "date_trunc('hour', cached_at)")


@query("cache_window", f"SELECT total_score, cached_at FROM ({_EVENTS}) WHERE cached_at >= TIMESTAMP '2024-01-03 00:00:00' AND cached_at <= TIMESTAMP '2024-01-05 12:00:00'")
def cache_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, _EVENTS).where(ca.window(since="2024-01-03 00:00:00", until="2024-01-05 12:00:00"))


@query("cache_rollback", f"SELECT total_score, cached_at FROM ({_EVENTS}) WHERE cached_at < TIMESTAMP '2024-01-05 00:00:00'")
def cache_rollback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tb.delete_where(_sql(spark, sf_dir, _EVENTS), ca.window(since="2024-01-05 00:00:00"))


@query("cache_probe", f"SELECT i.input_id, c.address_detail_pid, c.total_score FROM (SELECT input_id, 'k' || CAST(input_id % 600 AS VARCHAR) AS input_standardised FROM inp) i JOIN ({_CACHE}) c ON c.input_standardised = i.input_standardised JOIN addr g ON g.address_detail_pid = c.address_detail_pid")
def cache_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    inp, addr = load(spark, sf_dir, "inp", "addr")
    parsed = inp.select("input_id", F.concat(F.lit("k"), (F.col("input_id") % 600).cast("string")).alias("input_standardised"))
    empty = spark.createDataFrame([], ", ".join(f"{c} {t}" for c, t in tb.CACHE.items()))
    entries = tb.aligned(_sql(spark, sf_dir, _STORED), {"event_id": "long", **tb.CACHE})
    cached = tb.insert_ignore(empty, entries, "input_standardised", [F.asc("event_id")])
    return ca.probe(parsed, cached, m.candidates_of(addr)).select("input_id", "address_detail_pid", "total_score")


@query("cache_sample", f"SELECT c.input_standardised, address_detail_pid, c.total_score FROM ({_CACHE}) c JOIN addr USING (address_detail_pid) WHERE c.cached_at >= TIMESTAMP '2024-01-01 00:00:00' ORDER BY md5('3|' || c.input_standardised) LIMIT 20")
def cache_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    (addr,) = load(spark, sf_dir, "addr")
    return ca.sample(_sql(spark, sf_dir, _CACHE), addr, 20, seed=3, since="2024-01-01 00:00:00").select("input_standardised", "address_detail_pid", "total_score")


@query("cache_store", f"SELECT input_id, address_detail_pid, total_score FROM ({o.path('inp', 'addr', 'g.postcode = i.in_postcode')}) WHERE total_score >= 95")
def cache_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    inp, addr = load(spark, sf_dir, "inp", "addr")
    found = m.postcode_path(m.inputs_of(inp), m.candidates_of(addr)).withColumn("input_standardised", F.col("input_id").cast("string"))
    empty = spark.createDataFrame([], ", ".join(f"{c} {t}" for c, t in tb.CACHE.items()))
    return ca.store(empty, found).select(F.col("input_standardised").cast("int").alias("input_id"), "address_detail_pid", "total_score")


# -- ingest -------------------------------------------------------------------

#: The set's tables, from the driver's: details from customers, streets from parts, localities from nations.
_SET = {
    "ADDRESS_DETAIL": "SELECT 'D' || CAST(c_custkey AS VARCHAR(20)) AS ADDRESS_DETAIL_PID, 'S' || CAST(c_custkey % 50 AS VARCHAR(20)) AS STREET_LOCALITY_PID, 'L' || CAST(c_nationkey AS VARCHAR(20)) AS LOCALITY_PID, CASE WHEN c_custkey % 9 = 0 THEN 'TOWER' END AS BUILDING_NAME, CASE WHEN c_custkey % 5 = 0 THEN 'UNIT' END AS FLAT_TYPE_CODE, CAST(NULL AS VARCHAR(20)) AS FLAT_NUMBER_PREFIX, CASE WHEN c_custkey % 5 = 0 THEN CAST(c_custkey % 9 AS VARCHAR(20)) END AS FLAT_NUMBER, CASE WHEN c_custkey % 10 = 0 THEN 'B' END AS FLAT_NUMBER_SUFFIX, CAST(NULL AS VARCHAR(20)) AS LEVEL_TYPE_CODE, CAST(NULL AS VARCHAR(20)) AS LEVEL_NUMBER, CAST(NULL AS VARCHAR(20)) AS NUMBER_FIRST_PREFIX, CASE WHEN c_custkey % 31 <> 0 THEN CAST(c_custkey % 99 AS VARCHAR(20)) END AS NUMBER_FIRST, CASE WHEN c_custkey % 7 = 0 THEN 'A' END AS NUMBER_FIRST_SUFFIX, CAST(NULL AS VARCHAR(20)) AS NUMBER_LAST_PREFIX, CASE WHEN c_custkey % 13 = 0 THEN CAST(c_custkey % 99 + 4 AS VARCHAR(20)) END AS NUMBER_LAST, CAST(NULL AS VARCHAR(20)) AS NUMBER_LAST_SUFFIX, CAST(NULL AS VARCHAR(20)) AS LOT_NUMBER, CAST(4000 + c_nationkey AS VARCHAR(20)) AS POSTCODE, CASE WHEN c_custkey % 4 = 1 THEN 'A' ELSE 'P' END AS ALIAS_PRINCIPAL, CASE WHEN c_custkey % 17 = 0 THEN '2020-01-01' END AS DATE_RETIRED FROM customer",
    "ADDRESS_DEFAULT_GEOCODE": "SELECT 'D' || CAST(c_custkey AS VARCHAR(20)) AS ADDRESS_DETAIL_PID, CAST(150 + c_custkey % 7 AS VARCHAR(20)) AS LONGITUDE, CAST(-20 - c_custkey % 5 AS VARCHAR(20)) AS LATITUDE, CASE WHEN c_custkey % 19 = 0 THEN '2020-01-01' ELSE '' END AS DATE_RETIRED FROM customer",
    "STREET_LOCALITY": "SELECT 'S' || CAST(p_partkey AS VARCHAR(20)) AS STREET_LOCALITY_PID, upper(p_name) AS STREET_NAME, CASE p_partkey % 3 WHEN 0 THEN 'ST' WHEN 1 THEN 'AV' ELSE 'ROAD' END AS STREET_TYPE_CODE, CASE WHEN p_partkey % 11 = 0 THEN 'NORTH' END AS STREET_SUFFIX_CODE, CASE WHEN p_partkey % 23 = 0 THEN '2020-01-01' END AS DATE_RETIRED FROM part",
    "LOCALITY": "SELECT 'L' || CAST(n_nationkey AS VARCHAR(20)) AS LOCALITY_PID, upper(n_name) AS LOCALITY_NAME, CAST(NULL AS VARCHAR(20)) AS DATE_RETIRED FROM nation",
    "ADDRESS_ALIAS": "SELECT 'D' || CAST(c_custkey AS VARCHAR(20)) AS ALIAS_PID, CASE WHEN c_custkey % 8 = 1 THEN 'SYN' ELSE 'RA' END AS ALIAS_TYPE_CODE, CAST(NULL AS VARCHAR(20)) AS DATE_RETIRED FROM customer WHERE c_custkey % 8 = 1",
    "LOCALITY_ALIAS": "SELECT 'LA' || CAST(n_nationkey AS VARCHAR(20)) AS LOCALITY_ALIAS_PID, 'L' || CAST(n_nationkey AS VARCHAR(20)) AS LOCALITY_PID, 'OLD ' || upper(n_name) AS NAME, CASE WHEN n_nationkey % 2 = 0 THEN '4999' END AS POSTCODE, 'SYN' AS ALIAS_TYPE_CODE, CAST(NULL AS VARCHAR(20)) AS DATE_RETIRED FROM nation WHERE n_nationkey % 3 = 0",
    "STREET_LOCALITY_ALIAS": "SELECT 'SA' || CAST(p_partkey AS VARCHAR(20)) AS STREET_LOCALITY_ALIAS_PID, 'S' || CAST(p_partkey AS VARCHAR(20)) AS STREET_LOCALITY_PID, 'OLD ' || upper(p_name) AS STREET_NAME, 'CL' AS STREET_TYPE_CODE, CAST(NULL AS VARCHAR(20)) AS STREET_SUFFIX_CODE, 'SYN' AS ALIAS_TYPE_CODE, CAST(NULL AS VARCHAR(20)) AS DATE_RETIRED FROM part WHERE p_partkey % 4 = 0",
}
_LIVE = "(DATE_RETIRED IS NULL OR DATE_RETIRED = '')"
_TYPE = "CASE {k} WHEN 'ST' THEN 'STREET' WHEN 'AV' THEN 'AVENUE' WHEN 'CL' THEN 'CLOSE' ELSE {k} END"
_BASE = f"""SELECT d.*, s.STREET_NAME, s.STREET_TYPE_CODE, s.STREET_SUFFIX_CODE, l.LOCALITY_NAME, g.LONGITUDE, g.LATITUDE FROM (SELECT * FROM ({_SET["ADDRESS_DETAIL"]}) WHERE {_LIVE}) d
  JOIN (SELECT * FROM ({_SET["STREET_LOCALITY"]}) WHERE {_LIVE}) s USING (STREET_LOCALITY_PID) JOIN ({_SET["LOCALITY"]}) l USING (LOCALITY_PID)
  LEFT JOIN (SELECT * FROM ({_SET["ADDRESS_DEFAULT_GEOCODE"]}) WHERE {_LIVE}) g USING (ADDRESS_DETAIL_PID)"""


def _psv_sql(pid: str, street: str, kind: str, suffix: str, locality: str, code: str, alias: str, rows: str) -> str:
    """Records of the set. The label has two parts, each of the words that are there; a
    record without a first number has no label."""
    kind = _TYPE.format(k=kind)
    flat = "FLAT_NUMBER || coalesce(FLAT_NUMBER_SUFFIX, '')"
    number = "concat(NUMBER_FIRST, NUMBER_FIRST_SUFFIX, '-' || NUMBER_LAST)"
    street_part = f"concat_ws(' ', BUILDING_NAME, CASE WHEN FLAT_NUMBER IS NOT NULL THEN FLAT_TYPE_CODE END, {flat}, {number}, {street}, {kind}, {suffix})"
    return f"""SELECT {pid} AS address_detail_pid, CASE WHEN NUMBER_FIRST IS NOT NULL THEN {street_part} || ', ' || concat_ws(' ', {locality}, 'QLD', {code}) END AS address_label,
  {street} AS street_name, {kind} AS street_type, {locality} AS locality_name, CAST({code} AS INT) AS postcode, {flat} AS flat_number, CAST(LONGITUDE AS DOUBLE) AS longitude, {alias} AS alias_type FROM {rows}"""


_PSV = {
    "psv_standard": (ingest.standard_records, _psv_sql("ADDRESS_DETAIL_PID", "STREET_NAME", "STREET_TYPE_CODE", "STREET_SUFFIX_CODE", "LOCALITY_NAME", "POSTCODE", "CASE WHEN ALIAS_PRINCIPAL = 'A' THEN 'ADDRESS:' || coalesce(c, 'ALIAS') END", f"({_BASE}) LEFT JOIN (SELECT ALIAS_PID AS ADDRESS_DETAIL_PID, max(ALIAS_TYPE_CODE) AS c FROM ({_SET['ADDRESS_ALIAS']}) GROUP BY 1) USING (ADDRESS_DETAIL_PID)")),
    "psv_locality_alias": (ingest.locality_alias_records, _psv_sql("ADDRESS_DETAIL_PID || '_LA' || LOCALITY_ALIAS_PID", "STREET_NAME", "STREET_TYPE_CODE", "STREET_SUFFIX_CODE", "b.NAME", "coalesce(b.POSTCODE, a.POSTCODE)", "'LOCALITY:' || ALIAS_TYPE_CODE", f"(SELECT * FROM ({_BASE}) WHERE ALIAS_PRINCIPAL = 'P') a JOIN ({_SET['LOCALITY_ALIAS']}) b USING (LOCALITY_PID)")),
    "psv_street_alias": (ingest.street_alias_records, _psv_sql("ADDRESS_DETAIL_PID || '_SA' || STREET_LOCALITY_ALIAS_PID", "b.STREET_NAME", "b.STREET_TYPE_CODE", "b.STREET_SUFFIX_CODE", "LOCALITY_NAME", "POSTCODE", "'STREET:' || ALIAS_TYPE_CODE", f"(SELECT * FROM ({_BASE}) WHERE ALIAS_PRINCIPAL = 'P') a JOIN ({_SET['STREET_LOCALITY_ALIAS']}) b USING (STREET_LOCALITY_PID)")),
}


def _psv(name: str, records, sql: str) -> None:
    @query(name, sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = {k: _sql(spark, sf_dir, v) for k, v in _SET.items()}
        return records(t, "QLD").select("address_detail_pid", "address_label", "street_name", "street_type", "locality_name", "postcode", "flat_number", "longitude", "alias_type")


for _name, _parts in _PSV.items():
    _psv(_name, *_parts)


# -- spatial ------------------------------------------------------------------

_POINTS = f"SELECT {_KEY} AS id, CASE WHEN {_KEY} % 50 <> 0 THEN CAST({_KEY} % 97 AS DOUBLE) / 8 END AS longitude, CAST({_KEY} % 89 AS DOUBLE) / 8 AS latitude FROM addr"
#: Axis-aligned boxes: they overlap, share edges, and leave gaps.
_BOXES = [(0, 0, 4, 4, "a"), (4, 0, 8, 4, "b"), (2, 2, 6, 6, "c"), (8, 8, 12, 10, "d")]
_BOX_SQL = "(VALUES " + ", ".join(f"({i}, {a}, {b}, {c}, {d}, '{n}')" for i, (a, b, c, d, n) in enumerate(_BOXES)) + ") AS t(i, x0, y0, x1, y1, zone)"
_HITS = f"SELECT id, i, zone FROM ({_POINTS}) JOIN {_BOX_SQL} ON longitude BETWEEN x0 AND x1 AND latitude BETWEEN y0 AND y1"


def _boxes(spark: SparkSession) -> DataFrame:
    rows = [(i, [[(float(x), float(y)) for x, y in ((a, b), (c, b), (c, d), (a, d))]], n) for i, (a, b, c, d, n) in enumerate(_BOXES)]
    return spark.createDataFrame(rows, f"poly_idx int, rings {spatial.RINGS}, zone string")


@query("spatial_first", f"SELECT id, zone FROM ({_POINTS}) LEFT JOIN (SELECT id, arg_min(zone, i) AS zone FROM ({_HITS}) GROUP BY id) USING (id)")
def spatial_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.spatial_lookup(_sql(spark, sf_dir, _POINTS), _boxes(spark)).select("id", "zone")


@query("spatial_all", f"SELECT id, zone FROM ({_POINTS}) LEFT JOIN ({_HITS}) USING (id)")
def spatial_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.spatial_lookup(_sql(spark, sf_dir, _POINTS), _boxes(spark), multiple="all").select("id", "zone")


@query("density_grid", f"SELECT least(CAST(floor(longitude / 1.25) AS BIGINT), 9) AS gx, least(CAST(floor(latitude / 1.25) AS BIGINT), 9) AS gy, count(*) AS n FROM ({_POINTS}) WHERE longitude BETWEEN 0 AND 12.5 AND latitude BETWEEN 0 AND 12.5 GROUP BY 1, 2")
def density_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.density_grid(_sql(spark, sf_dir, _POINTS), 10, bounds=(0.0, 0.0, 12.5, 12.5))


#: The same grid, each cell with all others in reach at once.
_GRID = f"SELECT least(CAST(floor(longitude / 0.625) AS BIGINT), 19) AS gx, least(CAST(floor(latitude / 0.625) AS BIGINT), 19) AS gy, count(*) AS n FROM ({_POINTS}) WHERE longitude BETWEEN 0 AND 12.5 AND latitude BETWEEN 0 AND 12.5 GROUP BY 1, 2"
_SPREAD = "sum(g.n * exp(-0.5 * power((c.gx - g.gx) * 0.625 / 0.75, 2) - 0.5 * power((c.gy - g.gy) * 0.625 / 0.5, 2)))"


@query("kernel_density", f", g AS ({_GRID}), c AS (SELECT x AS gx, y AS gy FROM range(20) a(x), range(20) b(y)) SELECT c.gx, c.gy, round({_SPREAD} / (2 * pi() * 0.75 * 0.5 * (SELECT sum(n) FROM g)), 9) AS density FROM c JOIN g ON abs(c.gx - g.gx) <= 4 AND abs(c.gy - g.gy) <= 3 GROUP BY c.gx, c.gy")
def kernel_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = spatial.kernel_density(_sql(spark, sf_dir, _POINTS), 20, (0.0, 0.0, 12.5, 12.5), (0.75, 0.5))
    return out.withColumn("density", F.round("density", 9))


#: Points of a zone, some beyond its edges, and the same series in SQL: east and north, and how far off they come back.
_PLACES = f"SELECT {_KEY} AS id, CASE WHEN {_KEY} % 50 <> 0 THEN 143.5 + CAST({_KEY} % 97 AS DOUBLE) / 13 END AS longitude, -44 + CAST({_KEY} % 89 AS DOUBLE) / 3 AS latitude FROM addr"


def _terms(f: str, g: str) -> str:
    return " + ".join(f"{c!r} * {f}({2 * k} * xi) * {g}({2 * k} * eta)" for k, c in enumerate(projection.FORWARD, 1))


_ECC, _SIZE = projection._E2**0.5, projection.SCALE * projection._RADIUS


@query("grid_coordinates", f""", p AS ({_PLACES}), t AS (SELECT id, longitude, latitude, radians(longitude - 147) AS off, sinh(atanh(sin(radians(latitude))) - {_ECC!r} * atanh({_ECC!r} * sin(radians(latitude)))) AS t FROM p),
s AS (SELECT id, longitude, latitude, atan2(t, cos(off)) AS xi, atanh(sin(off) / sqrt(1 + t * t)) AS eta FROM t)
SELECT id, round(500000 + {_SIZE!r} * (eta + {_terms("cos", "sinh")}), 3) AS east, round(10000000 + {_SIZE!r} * (xi + {_terms("sin", "cosh")}), 3) AS north, longitude IS NOT NULL AS back FROM s""")
def grid_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EPSG:7855 of points, and whether they come back within 1e-9 degrees."""
    out = _sql(spark, sf_dir, _PLACES)
    x, y = projection.to_layer(F.col("longitude"), F.col("latitude"), 7855)
    out = out.withColumns({"east": x, "north": y})
    lon, lat = projection.from_layer(F.col("east"), F.col("north"), 7855)
    back = (F.abs(lon - F.col("longitude")) < 1e-9) & (F.abs(lat - F.col("latitude")) < 1e-9)
    return out.select("id", F.round("east", 3).alias("east"), F.round("north", 3).alias("north"), F.coalesce(back, F.lit(False)).alias("back"))


#: Cells of a grid, ten wide, one for each customer. Each side has a corner in its middle, pushed
#: up or to the right: by 0.3 where a third of the sides are, by 0.01 elsewhere.
_BEND = "CASE WHEN ({x} * 7 + {y} * 5 + {d}) % 3 = 0 THEN 0.3 ELSE 0.01 END"
_GRID = "SELECT k, x, y, CAST(left_ AS DOUBLE) AS l, CAST(right_ AS DOUBLE) AS r, CAST(low_ AS DOUBLE) AS b, CAST(high_ AS DOUBLE) AS t FROM (SELECT k, x, y, " + ", ".join(f"{_BEND.format(x=x, y=y, d=d)} AS {n}" for n, x, y, d in (("left_", "x", "y", 0), ("right_", "(x + 1)", "y", 0), ("low_", "x", "y", 1), ("high_", "x", "(y + 1)", 1))) + " FROM (SELECT c_custkey AS k, CAST((c_custkey - 1) % 10 AS INT) AS x, CAST(floor((c_custkey - 1) / 10) AS INT) AS y FROM customer))"
_BENT = " + ".join(f"CASE WHEN {c} > 0.1 THEN 1 ELSE 0 END" for c in "lrbt")
_BULGE = " + ".join(f"({s}CASE WHEN {c} > 0.1 THEN 0.15 ELSE 0 END)" for c, s in (("l", "-"), ("r", ""), ("b", "-"), ("t", "")))


@query("simplify_layer", f"SELECT k AS poly_idx, CAST(4 + {_BENT} AS INT) AS corners, round(CAST(1 + {_BULGE} AS DOUBLE), 6) AS area FROM ({_GRID})")
def simplify_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corners and area of each cell after sides that hardly bend were made straight."""
    at = lambda x, y: f"named_struct('x', CAST({x} AS DOUBLE), 'y', CAST({y} AS DOUBLE))"
    ring = ", ".join(at(*p) for p in (("x", "y"), ("x + 0.5", "y + b"), ("x + 1", "y"), ("x + 1 + r", "y + 0.5"), ("x + 1", "y + 1"), ("x + 0.5", "y + 1 + t"), ("x", "y + 1"), ("x + l", "y + 0.5")))
    layer = _sql(spark, sf_dir, f"SELECT k AS poly_idx, array(array({ring})) AS rings FROM ({_GRID})")
    out = spatial.simplify_layer(layer, 0.1).select("poly_idx", F.col("rings")[0].alias("p"))
    n = F.size("p")
    side = F.transform("p", lambda a, i: a["x"] * F.get(F.col("p"), (i + 1) % n)["y"] - F.get(F.col("p"), (i + 1) % n)["x"] * a["y"])
    return out.select("poly_idx", n.alias("corners"), F.round(F.abs(F.aggregate(side, F.lit(0.0), lambda a, b: a + b)) / 2, 6).alias("area"))
