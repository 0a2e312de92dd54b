"""Addresses and inputs derived from the driver's tables, in SQL for both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_LOCALITIES = (
    "ASHGROVE,BARDON HILL,CALAMVALE,DAISY HILL,EAGLE HEIGHTS,FERNY GROVE,GAYTHORNE,HOLLAND PARK,INDOOROOPILLY,JINDALEE,KELVIN GROVE,LUTWYCHE,MOUNT GRAVATT EAST,"
    "NEWMARKET,OXLEY,PADDINGTON,QUAMBY,RED HILL,SAINT LUCIA,TARINGA,UPPER KEDRON,VIRGINIA,WEST END,YERONGA,ZILLMERE"
).split(",")
_LOC = "SELECT k, nm FROM (VALUES " + ", ".join(f"({i}, '{n}')" for i, n in enumerate(_LOCALITIES)) + ") AS t(k, nm)"


def _addresses(table: str, key: str, nation: str, pid: str) -> str:
    return f"""SELECT '{pid}' || lpad(CAST(ck AS VARCHAR(20)), 9, '0') AS address_detail_pid,
  concat_ws(' ', CASE WHEN flat_number IS NOT NULL THEN 'UNIT ' || flat_number END,
    coalesce(CAST(number_first AS VARCHAR(20)) || coalesce('-' || CAST(number_last AS VARCHAR(20)), ''), CAST(ck % 60 + 1 AS VARCHAR(20)) || 'A'),
    street_name, street_type) || ', ' || concat_ws(' ', locality_name, state, CAST(postcode AS VARCHAR(20))) AS address_label,
  CASE WHEN flat_number IS NOT NULL THEN 'UNIT' END AS flat_type, flat_number, number_first, number_last,
  street_name, street_type, locality_name, state, postcode, CASE WHEN ck % 10 = 9 THEN 'LOCALITY:SYN' END AS alias_type
FROM (SELECT c.{key} AS ck, c.{nation} AS nk,
  CASE WHEN c.{key} % 46 <> 0 THEN CAST(c.{key} % 60 + 1 AS INT) END AS number_first,
  CASE WHEN c.{key} % 46 <> 0 AND c.{key} % 7 = 0 THEN CAST(c.{key} % 60 + 11 AS INT) END AS number_last,
  CASE WHEN c.{key} % 5 = 0 THEN CAST(c.{key} % 9 + 1 AS VARCHAR(20)) END AS flat_number,
  upper(p.p_name) AS street_name,
  CASE c.{key} % 4 WHEN 0 THEN 'STREET' WHEN 1 THEN 'ROAD' WHEN 2 THEN 'COURT' END AS street_type,
  loc.nm AS locality_name,
  CASE n.n_regionkey WHEN 0 THEN 'QLD' WHEN 1 THEN 'NSW' WHEN 2 THEN 'VIC' WHEN 3 THEN 'SA' ELSE 'WA' END AS state,
  CAST(4000 + c.{nation} * 5 AS INT) AS postcode
  FROM {table} c JOIN part p ON p.p_partkey = c.{key} JOIN nation n ON n.n_nationkey = c.{nation} JOIN loc ON loc.k = c.{nation}) base"""


ADDR = _addresses("customer", "c_custkey", "c_nationkey", "A")
CUST = _addresses("supplier", "s_suppkey", "s_nationkey", "C")
INP = """SELECT k AS input_id, address_label AS input_raw,
  CASE WHEN k % 11 = 0 THEN CAST(NULL AS INT) WHEN k % 11 = 3 THEN postcode + 1 WHEN k % 11 = 6 THEN 9999 ELSE postcode END AS in_postcode,
  CASE WHEN k % 13 = 0 THEN NULL ELSE state END AS in_state,
  CASE WHEN k % 17 = 0 THEN NULL WHEN k % 5 = 1 THEN substring(locality_name, 1, length(locality_name) - 1) ELSE locality_name END AS in_locality,
  CASE WHEN k % 29 = 0 THEN NULL WHEN k % 2 = 0 THEN substring(street_name, 1, length(street_name) - 1) ELSE street_name END AS in_street_name,
  CASE WHEN k % 8 = 5 THEN 'LANE' ELSE street_type END AS in_street_type,
  CASE WHEN k % 19 = 0 THEN CAST(NULL AS INT) WHEN k % 7 = 0 THEN k % 60 + 5 ELSE k % 60 + 1 END AS in_number_first,
  CASE WHEN k % 23 = 0 THEN 'A' END AS in_number_suffix,
  CASE WHEN k % 4 = 2 THEN NULL ELSE flat_number END AS in_flat_number
FROM (SELECT CAST(substring(address_detail_pid, 2, 9) AS INT) AS k, a.* FROM addr a) s WHERE k % 3 = 0"""
#: Common table expressions that every oracle may begin with.
WITH = f"WITH loc AS ({_LOC}), addr AS ({ADDR}), cust AS ({CUST}), inp AS ({INP})"


def load(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    """The named ones of addr, cust, inp, or of the driver's tables."""
    for t in ("customer", "supplier", "part", "nation", "events"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return [spark.sql(f"{WITH} SELECT * FROM {n}") for n in names]
