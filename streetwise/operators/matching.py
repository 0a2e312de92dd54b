"""Matching of parsed inputs against the address tables.

A path joins inputs with candidates of one block, lets the number gate and a coarse
street similarity pass, scores, and keeps the best of each input. Inputs go from
path to path only as far as they need to: exact label, cache, postcode, state,
fuzzy locality, street alone.
"""

from __future__ import annotations

import logging
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import jw
from ..scratch import Scratch, held
from . import parser
from .fuzzy import near_names
from .pairing import best_pairs
from .scoring import SCORES, WEIGHTS, check_weights, number_gate, with_scores

log = logging.getLogger(__name__)

#: Columns of a candidate, and of a parsed input, that matching needs.
CANDIDATE = [
    "address_detail_pid", "address_label", "building_name", "flat_type", "flat_number", "number_first", "number_last", "street_name", "street_type", "street_suffix",
    "locality_name", "state", "postcode", "longitude", "latitude", "source", "alias_type", "date_created", "legal_parcel_id", "mb_code",
    "alias_principal", "principal_pid", "primary_secondary", "primary_pid", "geocode_type",
]
#: Result columns that come first, in this order (a fixed value).
FIRST = ["input_id", "input_raw", "input_standardised", "address_label", "match_rank", "matched", "match_status", "total_score", *SCORES]
INPUT = ["input_id", *parser.FIELDS]
LEAST_STREET, LEAST_LOCALITY = 0.3, 0.85
OFFSETS = [-3, -2, -1, 1, 2, 3]
#: Inputs that take so few bytes, with all their keys, are sent to the address table's partitions instead of shuffling it.
BROADCAST_BYTES, KEYS = 64_000_000, 4
#: Pairs of an input that are compared first, beside as many as it may have results.
FIRST_TRIES = 8
#: From so many inputs on, the paths of a run look at pairs in bounded groups; fewer are broadcast instead of moving the records.
BOUNDED_INPUTS = 20_000
#: So many different postcodes of inputs are looked up in the address table's layout.
FEW_BLOCKS = 1_000
ANY = "any"
#: A record with a range of up to NEAR numbers offers each of them; one of up to WIDE
#: numbers the blocks of 2 ** BLOCK_BITS numbers that it touches; a wider one (no street
#: has such numbers) the whole block of the path.
NEAR, WIDE, BLOCK_BITS = 32, 4096, 5


def alias_filter(alias_types: list[str | None] | None) -> Column:
    """None: no filter; a None inside: core records; strings: those types; an empty list: nothing."""
    if alias_types is None:
        return F.lit(True)
    named = [a for a in alias_types if a is not None]
    out = F.col("alias_type").isin(named) if named else F.lit(False)
    return F.coalesce(out, F.lit(False)) | F.col("alias_type").isNull() if None in alias_types else F.coalesce(out, F.lit(False))


def candidates_of(addresses: DataFrame) -> DataFrame:
    """The candidate columns; those that a table lacks are null."""
    types = {"number_first": "int", "number_last": "int", "postcode": "int", "longitude": "double", "latitude": "double", "date_created": "date"}
    return addresses.select(*[F.col(c) if c in addresses.columns else F.lit(None).cast(types.get(c, "string")).alias(c) for c in CANDIDATE])


def inputs_of(parsed: DataFrame) -> DataFrame:
    return parsed.select(*[F.col(c) if c in parsed.columns else F.lit(None).cast(parser.FIELDS.get(c, "int")).alias(c) for c in INPUT])


def measured(inputs: DataFrame) -> tuple[int, bool]:
    """How many inputs there are, and whether they, once for each of their keys, may be sent to all tasks. They should be kept somewhere."""
    width = sum((F.coalesce(F.length(c), F.lit(0)) if t == "string" else F.lit(0)) + 16 for c, t in inputs.dtypes)
    n, size = inputs.agg(F.count("*"), F.coalesce(F.sum(width), F.lit(0))).first()
    return n, size * KEYS <= BROADCAST_BYTES


def gate_keys(gate: bool = True) -> tuple[Column, Column]:
    """The keys, beside the block, by which an input and a candidate that pass the number gate meet, as block() has them."""
    no = F.lit(None).cast("int")
    key = lambda kind, number=no: F.struct(F.lit(kind).alias("kind"), number.cast("int").alias("n"))
    n, first, last = F.col("in_number_first"), F.col("number_first"), F.col("number_last")
    wants, offers = F.array(key(ANY)), F.array(key(ANY))
    if gate:
        none = F.array().cast("array<struct<kind:string,n:int>>")
        wants = F.when(n.isNull(), wants).otherwise(F.filter(F.array(key("number", n), key("blocks", F.shiftright(n, BLOCK_BITS)), key("wide"), F.when(F.col("in_number_suffix").isNotNull(), key("letter"))), lambda k: k.isNotNull()))
        span = last.cast("long") - first.cast("long")
        inside = F.transform(F.sequence(first + 1, last), lambda i: key("number", i))
        blocks = F.transform(F.sequence(F.shiftright(first, BLOCK_BITS), F.shiftright(last, BLOCK_BITS)), lambda i: key("blocks", i))
        ranged = F.when(last.isNull() | (span <= 0), none).when(span < NEAR, inside).when(span < WIDE, blocks).when(span >= WIDE, F.array(key("wide"))).otherwise(none)
        offers = F.concat(offers, F.when(first.isNull(), F.array(key("letter"))).otherwise(F.array(key("number", first))), F.coalesce(ranged, none))
    return wants, offers


def block(inputs: DataFrame, addresses: DataFrame, left: str, right: str, gate: bool = True, small: bool = False, least_street: float | None = None) -> DataFrame:
    """Pairs of an input and a candidate with equal block values that pass the number
    gate. The gate is an OR, so it is split into disjoint keys of one equi-join: block
    and number (the first one, or one inside a range); block of the path and block of
    numbers, for wide ranges; block of records without a number (for inputs with a
    letter); the block alone for inputs without a number. Rows never meet rows that no
    key lets pass, and a range meets only the numbers near it.

    With ``least_street``, inputs without a number that have a street meet the block's
    different street names first, and records only of those that are as alike; their
    similarity is in ``_known``."""
    wants, offers = gate_keys(gate)
    n, first = F.col("in_number_first"), F.col("number_first")
    a, b = inputs.where(F.col(left).isNotNull()), addresses.where(F.col(right).isNotNull())
    a = a if "_known" in a.columns else a.withColumn("_known", F.lit(None).cast("double"))
    by_street = None
    if gate and least_street is not None:
        named = n.isNull() & F.col("in_street_name").isNotNull()
        asked, a = a.where(named), a.where(~named)
        names = b.where("street_name is not null").select(F.col(right).alias("_block"), "street_name").distinct()
        asked_names = asked.select(F.col(left).alias("_block"), "in_street_name").distinct()
        asked_names = F.broadcast(asked_names) if small else asked_names
        near = names.join(asked_names, "_block").withColumn("_jw", jw(F.col("in_street_name"), F.col("street_name"))).where(F.col("_jw") >= least_street)
        near = near.select("_block", F.col("in_street_name").alias("_asked"), F.col("street_name").alias("_street"), "_jw")
        asked = asked.drop("_known")
        chosen = near.join(F.broadcast(asked) if small else asked, (F.col("_block") == asked[left]) & (F.col("_asked") == asked["in_street_name"]))
        by_street = b.join(chosen, (b[right] == F.col("_block")) & (b["street_name"] == F.col("_street"))).select(*[b[c] for c in b.columns], *[F.col("_jw").alias("_known") if c == "_known" else F.col(c) for c in a.columns])
    a = a.withColumn("k", F.explode(wants)).select("*", F.col("k.kind").alias("k_kind"), F.coalesce("k.n", F.lit(-1)).alias("k_n")).drop("k")
    offered = b.withColumn("k", F.explode(offers)).select("*", F.col("k.kind").alias("o_kind"), F.coalesce("k.n", F.lit(-1)).alias("o_n")).drop("k")
    a = F.broadcast(a) if small else a
    pairs = offered.join(a, (a[left] == offered[right]) & (F.col("k_kind") == F.col("o_kind")) & (F.col("k_n") == F.col("o_n")))
    if gate:
        col = {c: F.col(c) for c in ("in_number_first", "in_number_suffix", "number_first", "number_last", "address_label")}
        pairs = pairs.where(number_gate(col) & (~F.col("k_kind").isin("blocks", "wide") | (F.col("in_number_first") != first)))
    pairs = pairs.drop("k_kind", "k_n", "o_kind", "o_n")
    return pairs if by_street is None else pairs.unionByName(by_street)


def best(scored: DataFrame, max_results: int, dedupe: bool = False) -> DataFrame:
    """Adds match_rank and keeps the best of each input: by total score, then pid."""
    order = [F.desc("total_score"), F.asc("address_detail_pid")]
    if dedupe:
        scored = scored.withColumn("_n", F.row_number().over(Window.partitionBy("input_id", "address_detail_pid").orderBy(F.desc("total_score")))).where("_n = 1").drop("_n")
    return scored.withColumn("match_rank", F.row_number().over(Window.partitionBy("input_id").orderBy(*order))).where(F.col("match_rank") <= max_results)


def least_similarity(min_score: int, weights: dict, postcode_known: bool = True) -> float:
    """The street similarity below which no pair can reach the floor, whatever its other
    parts; never below the coarse one."""
    others = sum(weights.values()) - weights["street"] - (0 if postcode_known else weights["postcode"])
    return max(LEAST_STREET, (min_score - 0.5 - 3 - others) / weights["street"]) if weights["street"] else LEAST_STREET


def _exactly(pairs: DataFrame, weights: dict, min_score: int) -> DataFrame:
    """Scores of pairs, and whether they count: ``_fine``. Names that are equal, or compared already, are not compared."""

    def alike(a: str, b: str, known: Column) -> Column:
        known = F.coalesce(known, F.when((F.col(a) == F.col(b)) & (F.col(a) != ""), 1.0))
        return F.coalesce(known, jw(F.when(known.isNull(), F.col(a)), F.col(b)))

    pairs = pairs.withColumns({"jw_street": alike("in_street_name", "street_name", F.col("_known")), "jw_suburb": alike("in_locality", "locality_name", F.lit(None).cast("double"))})
    fine = F.coalesce(F.col("in_street_name").isNull() | (F.col("jw_street") >= LEAST_STREET), F.lit(False)) & (F.col("total_score") >= min_score)
    return with_scores(pairs, weights).withColumn("_fine", fine)


def score_path(inputs: DataFrame, addresses: DataFrame, left: str, right: str, max_results: int, min_score: int, weights: dict | None = None, small: bool = False, bounded: bool = True, scratch: Scratch | None = None, gate: bool = True, least_street: float | None = None) -> DataFrame:
    """The best pairs of each input and the records of its block that reach the floor.

    If ``bounded``, pairs meet in bounded groups, where arrays of them are bounded by what
    is known, and names are compared only of those that might be among an input's best
    (pairing). Else each pair is a row; ``small`` inputs are broadcast, and names are
    compared in all pairs. Both give the same."""
    w = check_weights(weights)
    if bounded:
        wants, offers = gate_keys(gate)
        found = best_pairs(inputs, addresses, wants, offers, left, right, max_results, max_results + FIRST_TRIES, min_score, w, gate, LEAST_STREET, CANDIDATE, scratch)
    else:
        pairs = block(inputs, addresses, left, right, gate, small, least_street)
        found = _exactly(pairs, w, min_score).where("_fine").select("input_id", *CANDIDATE, *SCORES, "total_score")
    return best(found, max_results)


def postcode_path(inputs: DataFrame, addresses: DataFrame, max_results: int = 1, min_score: int = 60, weights: dict | None = None, alias_types=None, small: bool = False, bounded: bool = True, scratch: Scratch | None = None) -> DataFrame:
    return score_path(inputs, addresses.where(alias_filter(alias_types)), "in_postcode", "postcode", max_results, min_score, weights, small, bounded, scratch)


def state_path(inputs: DataFrame, addresses: DataFrame, max_results: int = 1, min_score: int = 60, weights: dict | None = None, alias_types=None, small: bool = False, bounded: bool = True, scratch: Scratch | None = None) -> DataFrame:
    """A state has very many records: unless ``bounded``, inputs without a number meet its street names first."""
    least = least_similarity(min_score, check_weights(weights))
    return score_path(inputs, addresses.where(alias_filter(alias_types)), "in_state", "state", max_results, min_score, weights, small, bounded, scratch, least_street=least)


def locality_index(*tables: DataFrame) -> DataFrame:
    """Distinct locality, postcode, state of all tables, where the locality is not null."""
    out = tables[0].select("locality_name", "postcode", "state")
    for t in tables[1:]:
        out = out.union(t.select("locality_name", "postcode", "state"))
    return out.where("locality_name is not null").distinct()


def near_postcodes(inputs: DataFrame, localities: DataFrame) -> DataFrame:
    """input_id, alt_postcode: those of localities spelt like the input's (in its state,
    if it has one), and those next to the input's own. Different names meet the different
    names of the index by their letters; a locality's postcodes serve every input that has
    its name."""
    names = inputs.where("in_locality is not null").select("in_state", F.col("in_locality").alias("asked")).distinct()
    index = localities.where("locality_name is not null").withColumnRenamed("locality_name", "name")
    of_state = near_names(names.where("in_state is not null").withColumnRenamed("in_state", "block"), index.select(F.col("state").alias("block"), "name").distinct(), LEAST_LOCALITY)
    every = F.lit("").alias("block")
    anywhere = near_names(names.where("in_state is null").select(every, "asked"), index.select(every, "name").distinct(), LEAST_LOCALITY)
    like = of_state.withColumnRenamed("block", "state").join(index, ["state", "name"]).select("asked", "postcode").union(anywhere.join(index, "name").select("asked", "postcode"))
    like = like.select(F.col("asked").alias("in_locality"), F.col("postcode").alias("alt_postcode")).where("alt_postcode is not null").distinct()
    by_name = inputs.select("input_id", "in_locality").join(like, "in_locality").select("input_id", "alt_postcode")
    by_offset = inputs.where("in_postcode is not null").select("input_id", F.explode(F.array(*[F.col("in_postcode") + o for o in OFFSETS])).alias("alt_postcode"))
    return by_name.union(by_offset).distinct()


def locality_path(inputs: DataFrame, addresses: DataFrame | Callable[[DataFrame], DataFrame], localities: DataFrame, max_results: int = 1, min_score: int = 60, weights: dict | None = None, alias_types=None, small: bool = False, bounded: bool = True, scratch: Scratch | None = None) -> DataFrame:
    """``addresses`` may be made from the inputs with their alt_postcode."""
    wide = held(inputs.join(near_postcodes(inputs, localities), "input_id"), scratch)
    of = (addresses(wide) if callable(addresses) else addresses).where(alias_filter(alias_types))
    small = small and measured(wide)[1]
    return score_path(wide, of, "alt_postcode", "postcode", max_results, min_score, weights, small, bounded, scratch)


def street_only_path(inputs: DataFrame, addresses: DataFrame, max_results: int = 1, min_score: int = 60, weights: dict | None = None, small: bool = False, bounded: bool = True, scratch: Scratch | None = None) -> DataFrame:
    aliases = addresses.where("alias_type = 'street_only'")
    return score_path(inputs, aliases, "in_postcode", "postcode", max_results, min_score, weights, small, bounded, scratch, gate=False)


def exact_path(inputs: DataFrame, addresses: DataFrame, weights: dict | None = None, alias_types=None) -> DataFrame:
    """Records whose label is the raw input, but for case and outer blanks. No floor."""
    keyed = inputs.withColumn("label_key", F.upper(F.trim("input_raw"))).where("label_key <> ''")
    labels = keyed.select("label_key").distinct()
    hit = addresses.where(alias_filter(alias_types)).withColumn("label_key", F.upper(F.trim("address_label"))).join(labels, "label_key", "left_semi")
    pairs = keyed.join(hit, "label_key")
    return with_scores(pairs, weights, strict=False).select("input_id", *CANDIDATE, *SCORES, "total_score", F.lit(1).alias("match_rank"))


def combine(paths: list[DataFrame], max_results: int) -> DataFrame:
    """All paths together: an input's record once, with its best score; ranked anew."""
    out = paths[0]
    for p in paths[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return best(out.drop("match_rank"), max_results, dedupe=True)


def diagnostics(path: DataFrame) -> DataFrame:
    """By input: rows a path kept and their best score."""
    return path.groupBy("input_id").agg(F.count("*").alias("retained_count"), F.max("total_score").alias("best_score"))


def merged_diagnostics(parts: list[DataFrame]) -> DataFrame:
    """Diagnostics of several paths together: counts add up, the best score counts."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("input_id").agg(F.coalesce(F.sum("retained_count"), F.lit(0)).alias("retained_count"), F.max("best_score").alias("best_score"))


def attach(parsed: DataFrame, results: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """Every input with its matches, or once without any, and why; with ``found`` also the
    paths' diagnostics. Columns that say most come first."""
    own = [c for c in results.columns if c == "input_id" or c not in parsed.columns]
    out = parsed.join(results.select(*own), "input_id", "left").withColumn("matched", F.col("address_detail_pid").isNotNull())
    lost = F.col("in_street_name").isNull() | (F.col("in_postcode").isNull() & F.col("in_state").isNull() & F.col("in_locality").isNull())
    out = out.withColumn("match_status", F.when(F.col("matched"), "matched").when(lost, "insufficient_parse").otherwise("no_candidate"))
    if found is not None:
        out = out.join(found, "input_id", "left").withColumn("retained_count", F.coalesce("retained_count", F.lit(0)))
    first = [c for c in FIRST if c in out.columns]
    return out.select(*first, *[c for c in out.columns if c not in first])


def ordered(results: DataFrame) -> DataFrame:
    """By input, matched rows first, then by rank."""
    return results.orderBy("input_id", F.desc("matched"), "match_rank")


def summary(results: DataFrame) -> DataFrame:
    """One row: inputs, matched inputs, rate in percent, rows, mean best score."""
    one = results.agg(
        F.countDistinct("input_id").alias("inputs"), F.countDistinct(F.when(F.col("matched"), F.col("input_id"))).alias("matched_inputs"),
        F.sum(F.col("matched").cast("long")).alias("result_rows"), F.round(F.avg(F.when(F.col("match_rank") == 1, F.col("total_score"))), 1).alias("avg_top_score"),
    )
    return one.withColumn("match_rate", F.round(100 * F.col("matched_inputs") / F.nullif("inputs", F.lit(0)), 1))


@dataclass
class Settings:
    max_results: int = 1
    min_score: int = 60
    include_custom: bool = True
    alias_types: list | None = None
    locality_fallback: bool = True
    street_only_fallback: bool = False
    fallback_threshold: int = 90
    weights: dict = field(default_factory=lambda: dict(WEIGHTS))
    normalise: bool = True
    cache: bool = True
    cache_threshold: int = 95
    bounded: bool | None = None  # None: from BOUNDED_INPUTS inputs on


def release(results: DataFrame) -> None:
    """Removes the tables that match_parsed() keeps for its result."""
    for scratch in getattr(results, "kept", []):
        scratch.close()


def match_parsed(parsed: DataFrame, core: DataFrame, custom: DataFrame | None, localities: DataFrame, settings: Settings, cached: Callable[[DataFrame], DataFrame] | DataFrame | None = None, with_diagnostics: bool = False, within: Callable[[str, list], tuple[DataFrame | None, DataFrame | None]] | None = None) -> DataFrame:
    """Runs the paths over parsed inputs (with input_raw and input_standardised).

    Each path's result is written and read again: later paths take only the inputs that
    it left over, and their plans stay short. In the end only the parsed inputs and the
    combined results are kept, until release(). ``cached`` has input_id, candidate
    columns and scores of cache hits, or makes them from the parsed inputs. The result
    has no order; ordered() gives the reports' one.

    ``within`` gives both tables with the rows that have one of some values in a column,
    from the files that may hold them: inputs of few postcodes or states read no others."""
    s, began = settings, time.monotonic()
    weights = check_weights(s.weights)
    result, between = Scratch(parsed.sparkSession), Scratch(parsed.sparkSession)
    parsed = result.keep(parsed)
    inputs = parsed.select(*[F.col(c) for c in [*INPUT, "input_raw"] if c in parsed.columns])
    n, small = measured(parsed)
    both = lambda a, b: candidates_of(a).unionByName(candidates_of(b)) if s.include_custom and b is not None else candidates_of(a)
    addresses = both(core, custom)

    def of(rows: DataFrame, name: str, column: str) -> DataFrame:
        """The addresses that can meet these inputs."""
        if within is None:
            return addresses
        values = [r[0] for r in rows.where(F.col(name).isNotNull()).select(name).distinct().limit(FEW_BLOCKS + 1).collect()]
        return addresses if len(values) > FEW_BLOCKS else both(*within(column, values))

    steps: list[tuple[str, DataFrame]] = []

    def run(name: str, found: DataFrame) -> DataFrame:
        steps.append((name, between.keep(found)))
        if log.isEnabledFor(logging.INFO):
            log.info("%s: %d rows of %d inputs, %.1f s", name, *steps[-1][1].agg(F.count("*"), F.countDistinct("input_id")).first(), time.monotonic() - began)
        return steps[-1][1]

    # A record may stand in both tables, which are one relation here: twice the results
    # are enough to have the best different ones.
    common = {"max_results": s.max_results * (2 if custom is not None else 1), "min_score": s.min_score, "weights": weights, "small": small, "bounded": s.bounded if s.bounded is not None else n >= BOUNDED_INPUTS, "scratch": between}
    aliased = common | {"alias_types": s.alias_types}
    ids = lambda df: df.select("input_id").distinct()
    done = run("exact", exact_path(inputs, addresses, weights, s.alias_types))
    rest = inputs.join(ids(done), "input_id", "left_anti")
    if cached is not None:
        hits = cached(parsed) if callable(cached) else cached
        hits = run("cache", hits.join(ids(done), "input_id", "left_anti"))
        rest = rest.join(ids(hits), "input_id", "left_anti")
    rest = between.keep(rest.drop("input_raw"))
    with_code, without = rest.where("in_postcode is not null"), rest.where("in_postcode is null")
    by_code = run("postcode", postcode_path(with_code, of(with_code, "in_postcode", "postcode"), **aliased))
    run("state", state_path(without, of(without, "in_state", "state"), **aliased))
    if s.locality_fallback:
        strong = by_code.where(F.col("total_score") > s.fallback_threshold)
        weak = between.keep(with_code.join(ids(strong), "input_id", "left_anti").unionByName(without).where("in_locality is not null"))
        run("locality", locality_path(weak, lambda wide: of(wide, "alt_postcode", "postcode"), localities, **aliased))
    if s.street_only_fallback:
        seen = steps[0][1].select("input_id")
        for _, p in steps[1:]:
            seen = seen.union(p.select("input_id"))
        open_inputs = between.keep(rest.where("in_postcode is not null and in_street_name is not null").join(seen.distinct(), "input_id", "left_anti"))
        run("street", street_only_path(open_inputs, of(open_inputs, "in_postcode", "postcode"), **common))
    combined = result.keep(combine([p for _, p in steps], s.max_results))
    found = result.keep(merged_diagnostics([diagnostics(p) for _, p in steps])) if with_diagnostics else None
    between.close()
    log.info("matched in %.1f s", time.monotonic() - began)
    out = attach(parsed, combined, found)
    out.kept = [result]
    return out
