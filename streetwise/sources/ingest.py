"""Readers of address files: one core CSV, or the pipe-separated set of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from ..operators.tables import ADDRESS, aligned
from ..operators.tables import CORE as SOURCE

#: Columns of the core file, and those used of each table of the set. Fixed values.
CORE = [
    "ADDRESS_DETAIL_PID", "DATE_CREATED", "ADDRESS_LABEL", "ADDRESS_SITE_NAME", "BUILDING_NAME", "FLAT_TYPE", "FLAT_NUMBER", "LEVEL_TYPE",
    "LEVEL_NUMBER", "NUMBER_FIRST", "NUMBER_LAST", "LOT_NUMBER", "STREET_NAME", "STREET_TYPE", "STREET_SUFFIX", "LOCALITY_NAME",
    "STATE", "POSTCODE", "LEGAL_PARCEL_ID", "MB_CODE", "ALIAS_PRINCIPAL", "PRINCIPAL_PID", "PRIMARY_SECONDARY", "PRIMARY_PID",
    "GEOCODE_TYPE", "LONGITUDE", "LATITUDE",
]
TABLES = {
    "ADDRESS_DETAIL": [
        "ADDRESS_DETAIL_PID", "STREET_LOCALITY_PID", "LOCALITY_PID", "BUILDING_NAME", "FLAT_TYPE_CODE", "FLAT_NUMBER_PREFIX",
        "FLAT_NUMBER", "FLAT_NUMBER_SUFFIX", "LEVEL_TYPE_CODE", "LEVEL_NUMBER", "NUMBER_FIRST_PREFIX", "NUMBER_FIRST",
        "NUMBER_FIRST_SUFFIX", "NUMBER_LAST_PREFIX", "NUMBER_LAST", "NUMBER_LAST_SUFFIX", "LOT_NUMBER", "POSTCODE",
        "ALIAS_PRINCIPAL", "DATE_RETIRED",
    ],
    "ADDRESS_DEFAULT_GEOCODE": [
        "ADDRESS_DETAIL_PID", "LONGITUDE", "LATITUDE", "DATE_RETIRED",
    ],
    "STREET_LOCALITY": [
        "STREET_LOCALITY_PID", "STREET_NAME", "STREET_TYPE_CODE", "STREET_SUFFIX_CODE", "DATE_RETIRED",
    ],
    "LOCALITY": [
        "LOCALITY_PID", "LOCALITY_NAME", "DATE_RETIRED",
    ],
    "ADDRESS_ALIAS": [
        "ALIAS_PID", "ALIAS_TYPE_CODE", "DATE_RETIRED",
    ],
    "LOCALITY_ALIAS": [
        "LOCALITY_ALIAS_PID", "LOCALITY_PID", "NAME", "POSTCODE", "ALIAS_TYPE_CODE", "DATE_RETIRED",
    ],
    "STREET_LOCALITY_ALIAS": [
        "STREET_LOCALITY_ALIAS_PID", "STREET_LOCALITY_PID", "STREET_NAME", "STREET_TYPE_CODE", "STREET_SUFFIX_CODE", "ALIAS_TYPE_CODE",
        "DATE_RETIRED",
    ],
}
FOR_ALIASES = ["LOCALITY_ALIAS", "STREET_LOCALITY_ALIAS"]


def matching_files(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that a glob names, in whatever store Spark reads."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(conf).globStatus(path)
    return [str(f.getPath().toString()) for f in found] if found else []


def read_delimited(spark: SparkSession, path: str | list[str], sep: str = ",") -> DataFrame:
    """A file with a header: all columns as text, lines that don't fit left out, blanks as
    null. Columns go by the file's own header, so their order is free."""
    paths = [path] if isinstance(path, str) else path
    header = spark.read.option("sep", sep).option("header", True).option("inferSchema", False).csv(paths[0]).columns
    schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
    return spark.read.csv(paths, schema=schema, header=True, sep=sep, mode="DROPMALFORMED", quote='"', escape='"')


def core_addresses(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Address records of core files."""
    for p in [paths] if isinstance(paths, str) else paths:
        if not matching_files(spark, p):
            raise FileNotFoundError(p)
    raw = read_delimited(spark, paths)
    raw = raw.select(*[F.col(c) if c in raw.columns else F.lit(None).cast("string").alias(c) for c in CORE])
    out = raw.select(*[F.col(c).alias(c.lower()) for c in CORE])
    out = out.withColumn("date_created", F.try_to_date("date_created", "dd-MM-yyyy")).withColumn("street_type", tx.canonical(F.col("street_type")))
    return aligned(out.withColumn("source", F.lit(SOURCE)), ADDRESS)


def _active(df: DataFrame) -> DataFrame:
    return df.where("DATE_RETIRED is null or DATE_RETIRED = ''")


def _number(prefix: str, number: str, suffix: str) -> Column:
    return F.concat(F.coalesce(F.col(prefix), F.lit("")), F.col(number).try_cast("int").cast("string"), F.coalesce(F.col(suffix), F.lit("")))


def label(state: str, street: str = "STREET_NAME", kind: str = "STREET_TYPE_CODE", suffix: str = "STREET_SUFFIX_CODE", locality: str = "LOCALITY_NAME", postcode: Column | None = None) -> Column:
    """The address on one line. A record without a first number has none."""
    opt = lambda c: F.coalesce(F.concat(F.lit(" "), F.nullif(c, F.lit(""))), F.lit(""))
    flat = F.when(F.col("FLAT_NUMBER").isNotNull(), F.concat(F.coalesce(F.concat(F.col("FLAT_TYPE_CODE"), F.lit(" ")), F.lit("")), _number("FLAT_NUMBER_PREFIX", "FLAT_NUMBER", "FLAT_NUMBER_SUFFIX"), F.lit(" "))).otherwise("")
    to = F.when(F.col("NUMBER_LAST").isNotNull(), F.concat(F.lit("-"), _number("NUMBER_LAST_PREFIX", "NUMBER_LAST", "NUMBER_LAST_SUFFIX"))).otherwise("")
    return F.trim(F.concat(
        F.coalesce(F.concat(F.col("BUILDING_NAME"), F.lit(" ")), F.lit("")), flat, _number("NUMBER_FIRST_PREFIX", "NUMBER_FIRST", "NUMBER_FIRST_SUFFIX"), to, F.lit(" "),
        F.col(street), opt(tx.canonical(F.col(kind))), opt(F.col(suffix)), F.lit(", "), F.col(locality), F.lit(f" {state} "), F.col("POSTCODE") if postcode is None else postcode,
    ))


def _record(state: str, pid: Column, text: Column, alias: Column, street="STREET_NAME", kind="STREET_TYPE_CODE", suffix="STREET_SUFFIX_CODE", locality="LOCALITY_NAME", postcode: Column | None = None) -> list[Column]:
    flat = F.when(F.col("FLAT_NUMBER").isNotNull(), _number("FLAT_NUMBER_PREFIX", "FLAT_NUMBER", "FLAT_NUMBER_SUFFIX"))
    cast = lambda c: F.col(c).try_cast("int")
    return [
        pid.alias("address_detail_pid"), text.alias("address_label"), F.col("BUILDING_NAME").alias("building_name"), F.col("FLAT_TYPE_CODE").alias("flat_type"), flat.alias("flat_number"),
        F.col("LEVEL_TYPE_CODE").alias("level_type"), cast("LEVEL_NUMBER").cast("string").alias("level_number"), cast("NUMBER_FIRST").alias("number_first"), cast("NUMBER_LAST").alias("number_last"),
        F.col("LOT_NUMBER").alias("lot_number"), F.col(street).alias("street_name"), tx.canonical(F.col(kind)).alias("street_type"), F.col(suffix).alias("street_suffix"), F.col(locality).alias("locality_name"),
        F.lit(state).alias("state"), (cast("POSTCODE") if postcode is None else postcode).alias("postcode"), F.col("LONGITUDE").try_cast("double").alias("longitude"), F.col("LATITUDE").try_cast("double").alias("latitude"),
        F.lit(SOURCE).alias("source"), alias.alias("alias_type"),
    ]


def _base(t: dict[str, DataFrame]) -> DataFrame:
    """Active details with their street, locality and one geocode."""
    place = F.min(F.struct(F.col("LONGITUDE"), F.col("LATITUDE"))).alias("g")
    geo = _active(t["ADDRESS_DEFAULT_GEOCODE"]).groupBy("ADDRESS_DETAIL_PID").agg(place).select("ADDRESS_DETAIL_PID", "g.*")
    street, locality = _active(t["STREET_LOCALITY"]).drop("DATE_RETIRED"), _active(t["LOCALITY"]).drop("DATE_RETIRED")
    return _active(t["ADDRESS_DETAIL"]).drop("DATE_RETIRED").join(street, "STREET_LOCALITY_PID").join(locality, "LOCALITY_PID").join(geo, "ADDRESS_DETAIL_PID", "left")


def standard_records(t: dict[str, DataFrame], state: str) -> DataFrame:
    alias = _active(t["ADDRESS_ALIAS"]).groupBy(F.col("ALIAS_PID").alias("ADDRESS_DETAIL_PID")).agg(F.max("ALIAS_TYPE_CODE").alias("_alias"))
    kind = F.when(F.col("ALIAS_PRINCIPAL") == "A", F.concat(F.lit("ADDRESS:"), F.coalesce("_alias", F.lit("ALIAS"))))
    return aligned(_base(t).join(alias, "ADDRESS_DETAIL_PID", "left").select(*_record(state, F.col("ADDRESS_DETAIL_PID"), label(state), kind)), ADDRESS)


def locality_alias_records(t: dict[str, DataFrame], state: str) -> DataFrame:
    other = _active(t["LOCALITY_ALIAS"]).select("LOCALITY_ALIAS_PID", "LOCALITY_PID", F.col("NAME").alias("_name"), F.col("POSTCODE").alias("_code"), F.col("ALIAS_TYPE_CODE").alias("_alias"))
    rows = _base(t).where("ALIAS_PRINCIPAL = 'P'").join(other, "LOCALITY_PID")
    pid = F.concat("ADDRESS_DETAIL_PID", F.lit("_LA"), "LOCALITY_ALIAS_PID")
    code = F.coalesce(F.col("_code").try_cast("int"), F.col("POSTCODE").try_cast("int"))
    return aligned(rows.select(*_record(state, pid, label(state, locality="_name", postcode=F.coalesce("_code", "POSTCODE")), F.concat(F.lit("LOCALITY:"), "_alias"), locality="_name", postcode=code)), ADDRESS)


def street_alias_records(t: dict[str, DataFrame], state: str) -> DataFrame:
    other = _active(t["STREET_LOCALITY_ALIAS"]).select("STREET_LOCALITY_ALIAS_PID", "STREET_LOCALITY_PID", F.col("STREET_NAME").alias("_name"), F.col("STREET_TYPE_CODE").alias("_kind"), F.col("STREET_SUFFIX_CODE").alias("_suffix"), F.col("ALIAS_TYPE_CODE").alias("_alias"))
    rows = _base(t).where("ALIAS_PRINCIPAL = 'P'").join(other, "STREET_LOCALITY_PID")
    pid = F.concat("ADDRESS_DETAIL_PID", F.lit("_SA"), "STREET_LOCALITY_ALIAS_PID")
    names = {"street": "_name", "kind": "_kind", "suffix": "_suffix"}
    return aligned(rows.select(*_record(state, pid, label(state, **names), F.concat(F.lit("STREET:"), "_alias"), **names)), ADDRESS)


def read_set(spark: SparkSession, folder: str, aliases: bool = True) -> list[tuple[str, dict[str, DataFrame]]]:
    """For each state in the folder (files <STATE>_<TABLE>_psv.psv or <STATE>_<TABLE>.psv): its tables."""
    out = []
    for path in matching_files(spark, f"{folder}/*_ADDRESS_DETAIL*.psv"):
        name = path.rsplit("/", 1)[1]
        state = name.split("_", 1)[0]
        tables = {}
        for t in TABLES:
            if t in FOR_ALIASES and not aliases:
                continue
            found = matching_files(spark, f"{folder}/{state}_{t}_psv.psv") or matching_files(spark, f"{folder}/{state}_{t}.psv")
            if not found:
                raise FileNotFoundError(f"{state}_{t}")
            got = read_delimited(spark, found[0], "|")
            tables[t] = got.select(*[F.col(c) if c in got.columns else F.lit(None).cast("string").alias(c) for c in TABLES[t]])
        out.append((state, tables))
    if not out:
        raise FileNotFoundError(f"{folder}/*_ADDRESS_DETAIL*.psv")
    return out


def set_addresses(spark: SparkSession, folder: str, aliases: bool = True) -> DataFrame:
    """All records of a set: standard ones, and those under other names of locality and street."""
    parts = []
    for state, tables in read_set(spark, folder, aliases):
        parts.append(standard_records(tables, state))
        if aliases:
            parts += [locality_alias_records(tables, state), street_alias_records(tables, state)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
