"""Table changes as relations: each takes tables and returns the table as it is after."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx

#: The address record and the cache entry: name and type, in order. Fixed values.
ADDRESS = {
    "address_detail_pid": "string", "address_label": "string", "address_site_name": "string", "building_name": "string", "flat_type": "string",
    "flat_number": "string", "level_type": "string", "level_number": "string", "number_first": "int", "number_last": "int",
    "lot_number": "string", "street_name": "string", "street_type": "string", "street_suffix": "string", "locality_name": "string",
    "state": "string", "postcode": "int", "longitude": "double", "latitude": "double", "source": "string",
    "alias_type": "string", "date_created": "date", "legal_parcel_id": "string", "mb_code": "string", "alias_principal": "string",
    "principal_pid": "string", "primary_secondary": "string", "primary_pid": "string", "geocode_type": "string",
}
CACHE = {
    "input_standardised": "string", "address_detail_pid": "string", "total_score": "int", "score_postcode": "int", "score_suburb": "int",
    "score_street_name": "int", "score_street_type": "int", "score_number": "int", "score_flat": "int", "cached_at": "timestamp",
}
#: Source of records that were loaded from files; others are custom.
CORE = "core"
LOCALITY = {"locality_name": "string", "postcode": "int", "state": "string"}
REQUIRED = ["number_first", "street_name", "street_type", "locality_name", "state", "postcode"]
_UPPER = [
    "address_label", "building_name", "flat_type", "flat_number", "street_name", "street_type", "street_suffix",
    "locality_name", "state", "legal_parcel_id", "mb_code", "alias_principal", "principal_pid", "primary_secondary",
    "primary_pid", "geocode_type",
]
#: Columns that an upsert leaves as they were.
KEPT = {"address_detail_pid", "address_site_name", "level_type", "level_number", "lot_number", "source", "alias_type"}


def aligned(df: DataFrame, schema: dict[str, str]) -> DataFrame:
    """The schema's columns, cast; those that are missing are null, others go."""
    return df.select(*[(F.col(c).try_cast(t) if c in df.columns else F.lit(None).cast(t)).alias(c) for c, t in schema.items()])


def new_rows(table: DataFrame, rows: DataFrame, key: str | list[str], order: list[Column] | None = None) -> DataFrame:
    """The rows whose key the table lacks; of equal new keys the first by ``order``, or the
    first as the rows lie (in the file they come from). A null key equals no other."""
    keys = [key] if isinstance(key, str) else key
    if order is None:
        rows, order = rows.withColumn("_at", F.monotonically_increasing_id()), [F.col("_at")]
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    once = rows.withColumn("_n", first).where(~whole | (F.col("_n") == 1)).drop("_n", "_at")
    return once.join(table.select(*keys), keys, "left_anti").select(*table.columns)


def insert_ignore(table: DataFrame, rows: DataFrame, key: str | list[str], order: list[Column] | None = None) -> DataFrame:
    """The table with its new_rows()."""
    return table.unionByName(new_rows(table, rows, key, order))


def upsert(table: DataFrame, rows: DataFrame, key: str = "address_detail_pid", kept: set[str] = KEPT) -> DataFrame:
    """New keys are added; of those that exist all columns change but the kept ones.
    Of equal new keys the last by all columns counts."""
    last = F.row_number().over(Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in rows.columns if c != key]))
    once = rows.withColumn("_n", last).where("_n = 1").drop("_n")
    new = once.select(*[F.col(c).alias(f"_new_{c}") for c in once.columns])
    both = table.join(new, table[key] == new[f"_new_{key}"], "full_outer")
    had, has = F.col(key).isNotNull(), F.col(f"_new_{key}").isNotNull()
    return both.select(*[F.when(~has | (had & F.lit(c in kept)), F.col(c)).otherwise(F.col(f"_new_{c}")).alias(c) for c in table.columns])


def delete_where(table: DataFrame, condition: Column) -> DataFrame:
    """Without the rows for which the condition is true; null keeps a row."""
    return table.where(~F.coalesce(condition, F.lit(False)))


def delete_keys(table: DataFrame, keys: DataFrame, key: str = "address_detail_pid") -> DataFrame:
    return table.join(keys.select(key), key, "left_anti").select(*table.columns)


def canonical_type() -> Column:
    return tx.canonical(F.col("street_type"))


def canonical_street_types(table: DataFrame) -> DataFrame:
    return table.withColumn("street_type", canonical_type())


def numbered(df: DataFrame, name: str) -> DataFrame:
    """Adds a number from 0, without gaps, in the order of the rows as they lie. Only a
    row for each partition is brought together. The caller releases what is persisted:
    it is in the result's ``held``."""
    marked = df.withColumn("_m", F.monotonically_increasing_id()).persist()
    sizes = marked.groupBy(F.shiftright("_m", 33).alias("_p")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_p", before.alias("_start"))
    out = marked.withColumn("_p", F.shiftright("_m", 33)).join(F.broadcast(starts), "_p")
    out = out.select(*df.columns, (F.col("_start") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).alias(name))
    out.held = [marked]
    return out


def custom_texts(rows: DataFrame) -> DataFrame:
    """User rows with their texts upper and trimmed; required columns are checked."""
    if missing := [c for c in REQUIRED if c not in rows.columns]:
        raise ValueError(f"Missing required columns: {', '.join(missing)}")
    return rows.withColumns({c: F.upper(tx.trim_all(F.col(c).cast("string"))) for c in _UPPER if c in rows.columns})


def custom_rows(rows: DataFrame, existing: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Address records of user rows: required columns checked, texts upper and trimmed,
    the rest null, ids numbered on from the largest CUSTOM_ id in use, in the order of the
    rows' columns. The caller releases what is persisted for numbering: the result's ``held``."""
    out, held = custom_texts(rows), []
    if "address_detail_pid" not in rows.columns:
        at = F.coalesce(F.max(F.regexp_extract("address_detail_pid", r"^CUSTOM_(\d+)$", 1).try_cast("long")), F.lit(0))
        n = existing.agg(at.alias("n")).first()["n"]
        by = order or rows.columns
        places = numbered(rows.repartitionByRange(*by).sortWithinPartitions(*by), "_place")
        held = places.held
        out = custom_texts(places).withColumn("address_detail_pid", F.concat(F.lit("CUSTOM_"), (F.col("_place") + 1 + n).cast("string")))
    out = aligned(out.withColumn("source", F.lit("custom")), ADDRESS)
    out.held = held
    return out


def street_aliases(addresses: DataFrame) -> DataFrame:
    """A record for each different street of core records, without numbers. Its id is a
    digest of its six parts; prefix, order of the parts and separator are fixed values."""
    parts = ["street_name", "street_type", "street_suffix", "locality_name", "state", "postcode"]
    core = addresses.where("source = 'core' and alias_type is null and street_name is not null and locality_name is not null and postcode is not null and state is not null")
    digest = F.md5(F.concat_ws("|", *[F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts]))
    label = F.concat(F.concat_ws(" ", *parts[:3]), F.lit(", "), F.concat_ws(" ", "locality_name", "state", F.col("postcode").cast("string")))
    out = core.select(*parts).distinct().withColumn("address_detail_pid", F.concat(F.lit("SO_"), digest)).withColumn("address_label", label)
    return aligned(out.withColumn("source", F.lit(CORE)).withColumn("alias_type", F.lit("street_only")), ADDRESS)


def status(tables: dict[str, DataFrame | None]) -> DataFrame:
    """table_name, row_count; null where a table is missing."""
    out = None
    for name, t in tables.items():
        one = t.agg(F.count("*").alias("n")) if t is not None else None
        row = one.select(F.lit(name).alias("table_name"), F.col("n").alias("row_count")) if one is not None else None
        if row is not None:
            out = row if out is None else out.union(row)
    missing = [n for n, t in tables.items() if t is None]
    if missing:
        spark = next(t for t in tables.values() if t is not None).sparkSession
        none = spark.createDataFrame([(n, None) for n in missing], "table_name string, row_count long")
        out = none if out is None else out.union(none)
    return out


def drawn(rows: DataFrame, n: int, seed: int | None, key: list[str]) -> DataFrame:
    """n random rows (a limit is what it is for). With a seed those whose keys have the least
    digests, so the same on any engine and layout; rows of equal keys are drawn as they come."""
    if n < 1:
        raise ValueError("n must be a positive whole number")
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key]))
    return rows.orderBy(F.rand() if seed is None else digest, *([] if seed is None else key)).limit(n)


def sample_rows(table: DataFrame, n: int, seed: int | None = None, key: str | list[str] | None = None) -> DataFrame:
    """drawn() rows; the key is the record's id, or all columns where there is none."""
    default = ["address_detail_pid"] if "address_detail_pid" in table.columns else table.columns
    return drawn(table, n, seed, [key] if isinstance(key, str) else key or default)
