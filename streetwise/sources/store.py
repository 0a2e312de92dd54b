"""The address store: versioned tables in a folder (see versions.py), or tables in memory.

Address tables are laid out by postcode, number and id: a file has few postcodes, so
that inputs of some postcodes read a few files, and of these the row groups that hold
them. Records without a postcode are many files like others, as the id deals them out.
"""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cache as ca
from ..operators import matching, parser, tables
from ..operators.tables import ADDRESS, CACHE, LOCALITY
from . import ingest
from .versions import MemoryTable, VersionedTable

log = logging.getLogger(__name__)
#: Each table's columns, key, and the columns it is laid out by.
SCHEMAS = {"addresses": ADDRESS, "custom_addresses": ADDRESS, "locality_index": LOCALITY, "match_cache": CACHE}
KEYS = {"addresses": "address_detail_pid", "custom_addresses": "address_detail_pid", "locality_index": None, "match_cache": "input_standardised"}
LAYOUT = ["postcode", "number_first", "address_detail_pid"]


class AddressStore:
    def __init__(self, spark: SparkSession, path: str | None = None, read_only: bool = False):
        self.spark, self.path, self.read_only = spark, path.rstrip("/") if path else None, read_only
        self.tables = {name: self._opened(name) for name in SCHEMAS}
        if not read_only:
            self.init()

    # -- tables -------------------------------------------------------------

    def _opened(self, name: str) -> VersionedTable | MemoryTable:
        if self.path is None:
            return MemoryTable(self.spark, SCHEMAS[name], KEYS[name])
        return VersionedTable(self.spark, f"{self.path}/{name}", SCHEMAS[name], KEYS[name], LAYOUT if SCHEMAS[name] is ADDRESS else [KEYS[name]] if KEYS[name] else [])

    def _writable(self, name: str) -> VersionedTable | MemoryTable:
        if self.read_only:
            raise PermissionError("the store is read-only")
        return self.tables[name]

    def exists(self, name: str) -> bool:
        return self.tables[name].exists()

    def list_tables(self) -> list[str]:
        return sorted(n for n in SCHEMAS if self.exists(n))

    def table(self, name: str, version: int | None = None, within: dict[str, list] | None = None) -> DataFrame:
        """The table as it is now, or was in a version; columns that an older file lacks are null. ``within`` has
        values of columns: files that hold none of them are not read."""
        if not self.exists(name):
            raise LookupError(f"no table {name}")
        return self.tables[name].read(version, within)

    def history(self, name: str) -> DataFrame:
        return self.tables[name].history()

    def compact(self) -> int:
        """Files that were put together or written anew, in all tables of a store in a folder."""
        return sum(self._writable(n).compact() for n in self.list_tables())

    def vacuum(self, versions: int = 2, older_than_s: float = 86_400) -> int:
        return sum(self._writable(n).vacuum(versions, older_than_s) for n in self.list_tables())

    def init(self) -> None:
        """Creates what is missing; fills the index of localities if there are addresses."""
        for name in SCHEMAS:
            self.tables[name].create()
        if self.table("locality_index").isEmpty() and not self.table("addresses").isEmpty():
            self.rebuild_locality_index()

    def close(self) -> None:
        if self.path is None:
            for t in self.tables.values():
                t.close()

    # -- loading ------------------------------------------------------------

    def _load(self, rows: DataFrame, overwrite: bool) -> int:
        if overwrite:
            self._writable("addresses").delete(condition=F.col("source") == tables.CORE)
        self._writable("addresses").append(lambda t: tables.new_rows(t, rows, "address_detail_pid"), "load")
        self.rebuild_locality_index()
        return self.table("addresses").count()

    def load_core(self, paths: str | list[str], overwrite: bool = False) -> int:
        return self._load(ingest.core_addresses(self.spark, paths), overwrite)

    def load_set(self, folder: str, overwrite: bool = False, aliases: bool = True) -> int:
        return self._load(ingest.set_addresses(self.spark, folder, aliases), overwrite)

    def rebuild_locality_index(self) -> int:
        self._writable("locality_index").replace(lambda _: matching.locality_index(self.table("addresses"), self.table("custom_addresses")))
        return self.table("locality_index").count()

    def build_street_aliases(self, overwrite: bool = False) -> int:
        if overwrite:
            self._writable("addresses").delete(condition=F.col("alias_type") == "street_only")
        self._writable("addresses").append(lambda t: tables.new_rows(t, tables.street_aliases(t), "address_detail_pid"), "aliases")
        return self.table("addresses").where("alias_type = 'street_only'").count()

    def canonicalise_street_types(self) -> int:
        """Rows of both tables with a street type, which is canonical afterwards. Only those that were not are written."""
        n, other = 0, F.col("street_type") != tables.canonical_type()
        for name in ("addresses", "custom_addresses"):
            self._writable(name).update(other, tables.canonical_street_types)
            n += self.table(name).where("street_type is not null").count()
        return n

    def status(self) -> DataFrame:
        return tables.status({n: self.table(n) if self.exists(n) else None for n in ("addresses", "custom_addresses")})

    def sample(self, n: int = 10, seed: int | None = None, names: list[str] | None = None) -> dict[str, DataFrame]:
        return {name: tables.sample_rows(self.table(name), n, seed) for name in names or self.list_tables()}

    # -- custom records -----------------------------------------------------

    def add_custom(self, rows: DataFrame, upsert: bool = False) -> tuple[int, int]:
        """Counts of rows inserted and updated."""
        table, held = self._writable("custom_addresses"), []

        def made(t: DataFrame) -> DataFrame:
            out = tables.custom_rows(rows, t)
            held.extend(out.held)
            return out if upsert else tables.new_rows(t, out, "address_detail_pid")

        counts = table.upsert(made, tables.KEPT) if upsert else (table.append(made, "add"), 0)
        for df in held:
            df.unpersist()
        new = tables.aligned(tables.custom_texts(rows), LOCALITY)
        self._writable("locality_index").append(lambda t: matching.locality_index(new).exceptAll(t))
        return counts

    def remove_custom(self, pids: list[str]) -> int:
        return self._writable("custom_addresses").delete(self.spark.createDataFrame([(p,) for p in pids], "address_detail_pid string"))

    # -- cache --------------------------------------------------------------

    def cache_status(self) -> DataFrame:
        return ca.status(self.table("match_cache") if self.exists("match_cache") else None, self.spark)

    def cache_clear(self, confirm: bool = False) -> int:
        if not confirm:
            raise ValueError("confirm=True clears the cache")
        return self._writable("match_cache").delete(condition=F.lit(True))

    def cache_rollback(self, after: str, confirm: bool = False) -> int:
        """Deletes the entries from a time (UTC) on."""
        if not confirm:
            raise ValueError("confirm=True deletes the entries")
        return self._writable("match_cache").delete(condition=ca.window(since=after))

    def cache_history(self, by: str = "day") -> DataFrame:
        return ca.history(self.table("match_cache"), by)

    def cache_sample(self, n: int = 10, include_custom: bool = True, seed: int | None = None, **when) -> DataFrame:
        return ca.sample(self.table("match_cache"), ca.source_of(self.table("addresses"), self.table("custom_addresses") if include_custom else None), n, seed, **when)

    # -- matching -----------------------------------------------------------

    def match(self, inputs: DataFrame | list[str], now: Column | None = None, with_diagnostics: bool = False, **options) -> DataFrame:
        """Matches rows of input_id, input_raw, or a list of texts, which are numbered from
        1. Options are those of matching.Settings. matching.release() frees what is kept
        for the result; it is in order (see matching.ordered)."""
        s = matching.Settings(**options)
        if s.max_results < 1:
            raise ValueError("max_results must be at least 1")
        matching.check_weights(s.weights)
        if not isinstance(inputs, DataFrame):
            texts = list(inputs)
            if not texts or not all(t is None or isinstance(t, str) for t in texts):
                raise ValueError("inputs must be rows or a list of texts that is not empty")
            inputs = self.spark.createDataFrame(list(enumerate(texts, 1)), "input_id int, input_raw string")
        if missing := [c for c in ("input_id", "input_raw") if c not in inputs.columns]:
            raise ValueError(f"inputs lack {', '.join(missing)}")
        parsed = parser.parse_addresses(inputs, normalised=s.normalise).withColumn("input_standardised", parser.standardised())
        core, custom = self.table("addresses"), self.table("custom_addresses") if s.include_custom else None
        within = lambda c, values: tuple(self.table(n, within={c: values}) if n else None for n in ("addresses", "custom_addresses" if s.include_custom else None))
        use = s.cache and ca.usable(s.weights) and self.exists("match_cache")
        hits = (lambda p: ca.probe(p, self.table("match_cache"), ca.source_of(core, custom), s.alias_types)) if use else None
        out = matching.match_parsed(parsed, core, custom, self.table("locality_index"), s, hits, with_diagnostics, within)
        if use and not self.read_only and ca.usable(s.weights, s.alias_types, store=True):
            self._writable("match_cache").append(lambda t: ca.new_entries(t, out, s.cache_threshold, now), "match")
        kept, out = out.kept, matching.ordered(out)
        out.kept = kept
        return out


def write_csv(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").option("header", True).csv(path)
