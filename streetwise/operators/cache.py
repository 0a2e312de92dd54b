"""The store of earlier matches: what is kept, found again, and reported."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .matching import CANDIDATE, alias_filter, candidates_of
from .scoring import SCORES, WEIGHTS
from .tables import CACHE, aligned, drawn, new_rows


def usable(weights: dict | None, alias_types=None, store: bool = False) -> bool:
    """Scores are kept under the default weights only; stored only without an alias filter."""
    return (weights is None or dict(weights) == WEIGHTS) and not (store and alias_types is not None)


def storable(results: DataFrame, threshold: int = 95, now: Column | None = None) -> DataFrame:
    """Entries for the best matches that reach the threshold."""
    rows = results.where((F.col("match_rank") == 1) & (F.col("total_score") >= threshold) & F.col("input_standardised").isNotNull() & F.col("address_detail_pid").isNotNull())
    return aligned(rows.withColumn("cached_at", now if now is not None else F.current_timestamp()), CACHE)


def new_entries(cache: DataFrame, results: DataFrame, threshold: int = 95, now: Column | None = None) -> DataFrame:
    """The entries that the cache lacks."""
    return new_rows(cache, storable(results, threshold, now), "input_standardised", [F.desc("total_score"), F.asc("address_detail_pid")])


def store(cache: DataFrame, results: DataFrame, threshold: int = 95, now: Column | None = None) -> DataFrame:
    return cache.unionByName(new_entries(cache, results, threshold, now))


def source_of(core: DataFrame, custom: DataFrame | None) -> DataFrame:
    out = candidates_of(core)
    return out if custom is None else out.unionByName(candidates_of(custom))


def probe(parsed: DataFrame, cache: DataFrame, addresses: DataFrame, alias_types=None) -> DataFrame:
    """Hits of inputs by their standard text: one row each, with the record and scores kept."""
    keys = parsed.where(F.col("input_standardised").isNotNull()).select("input_id", "input_standardised")
    held = cache.join(keys.select("input_standardised").distinct(), "input_standardised", "left_semi").drop("cached_at")
    found = held.join(addresses.where(alias_filter(alias_types)), "address_detail_pid")
    return keys.join(found, "input_standardised").select("input_id", *CANDIDATE, *SCORES, "total_score", F.lit(1).alias("match_rank"))


def status(cache: DataFrame | None, spark=None) -> DataFrame:
    if cache is None:
        return spark.createDataFrame([(0, None, None)], "cached_rows long, oldest timestamp, newest timestamp")
    return cache.agg(F.count("*").alias("cached_rows"), F.min("cached_at").alias("oldest"), F.max("cached_at").alias("newest"))


def history(cache: DataFrame, by: str = "day") -> DataFrame:
    if by not in ("day", "hour"):
        raise ValueError("by must be 'day' or 'hour'")
    bucket = F.to_date("cached_at") if by == "day" else F.date_trunc("hour", "cached_at")
    return cache.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("entries"), F.min("total_score").alias("min_score"), F.round(F.avg("total_score"), 6).alias("avg_score"), F.max("total_score").alias("max_score")).orderBy("bucket")


def window(cached_on: date | str | None = None, since: datetime | str | None = None, until: datetime | str | None = None) -> Column:
    """Entries of a day, or from and until a time, both inclusive, in UTC."""
    if cached_on is not None and (since is not None or until is not None):
        raise ValueError("give either cached_on, or since and until")
    at, out = F.col("cached_at"), F.lit(True)
    if cached_on is not None:
        return F.to_date(at) == F.lit(str(cached_on)).cast("date")
    if since is not None:
        out = out & (at >= F.lit(str(since)).cast("timestamp"))
    if until is not None:
        out = out & (at <= F.lit(str(until)).cast("timestamp"))
    return out


def sample(cache: DataFrame, addresses: DataFrame, n: int = 10, seed: int | None = None, **when) -> DataFrame:
    """Random entries with their records; entries whose record is gone are left out."""
    return drawn(cache.where(window(**when)).join(addresses, "address_detail_pid"), n, seed, ["input_standardised"])
