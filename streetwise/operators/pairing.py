"""The best candidates of each input, found by array operations over bounded groups of pairs.

Inputs and candidates meet by the keys of the number gate. Keys with few pairs share a
group, keys with many are dealt over several, so that no group holds more than some
thousand rows of either side. In a group, inputs that differ in no scored part count
once, and so do candidates, but for the first ones by pid. Inputs that agree in street,
place and postcode are one head, such candidates one cell: a head meets cells, by scores
of the three parts. Where there are very many names, a head looks first at the cells next
to it by name; what they give leaves few stretches of cells, then cells, whose bounds from
letters may still reach an input's best. Candidates of a cell are looked at likewise.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import Names, Runs, named
from ..scratch import Scratch, held
from .scoring import SCORES

#: Rows of one key that meet in one group, at most, of inputs and of candidates; rows and pairs of a group that several keys share.
IN_ROWS, OF_ROWS, GROUP_ROWS, GROUP_PAIRS = 4096, 8192, 8192, 1 << 24
#: Pairs that are looked at together; of heads and cells by bounds alone, so that they stay in the processor's cache.
CHUNK, BOUNDS = 1 << 19, 1 << 15
#: Entries of a table of names' similarities, at most.
TABLE = 1 << 16
#: Cells next to each other by name that have one bound.
RUN = 32
#: Cells that are looked at together if bounds leave them all, by how many are looked at together otherwise.
PRUNED = 4
#: Bytes of the table of keys that may be broadcast.
KEY_BYTES, KEY_WIDTH = 32_000_000, 100
#: A score that no floor lets pass; more than the difference of any two bounds of a total.
_NONE, _NEVER, _SPAN = -(1 << 40), -1000, 4096
_KEY = ["_block", "_kind", "_n"]
#: Scores in the order in which they are found.
_PARTS = ["score_postcode", "score_suburb", "score_street_name", "score_street_type", "score_number", "score_flat"]


def _numbers(c: pa.ChunkedArray) -> np.ndarray:
    return pc.fill_null(c.cast(pa.int64()), _NONE).to_numpy()


def _half_up(x: np.ndarray) -> np.ndarray:
    whole = np.floor(x)
    return (whole + (x - whole >= 0.5)).astype(np.int64)


def _by_rank(row: np.ndarray, *order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places sorted by row, then by the given columns; and the rank of each within its row, from 0."""
    at = np.lexsort((*reversed(order), row))
    new = np.flatnonzero(np.diff(row[at], prepend=-1))
    return at, np.arange(len(at)) - np.repeat(new, np.diff(new, append=len(at)))


def _spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as counted, one after the other."""
    return np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(start, count)


def _stretches(sizes: np.ndarray, chunk: int = CHUNK) -> list[np.ndarray]:
    """Places in stretches of about ``chunk`` in all, without those of size 0."""
    at = np.flatnonzero(sizes > 0)
    return np.split(at, np.flatnonzero(np.diff((np.cumsum(sizes[at]) - 1) // chunk)) + 1) if len(at) else []


def _by_name(names: list[str], *places: np.ndarray) -> tuple[list[str], ...]:
    """Names in order, and places among them (from 1; 0 is null) accordingly."""
    order = sorted(range(len(names)), key=names.__getitem__)
    at = np.zeros(len(names) + 1, dtype=np.int64)
    at[np.array(order, dtype=np.int64) + 1] = np.arange(1, len(names) + 1)
    return [names[i] for i in order], *(at[p] for p in places)


class _Likeness:
    """Scores of inputs' names with records' names, by their places among the names (0 is null); _NEVER for less than ``least``."""

    def __init__(self, names: Names, weight: float, least: float | None, of_in: np.ndarray, of: np.ndarray, pairs: int):
        self.names, self.weight, self.least = names, weight, least
        a, b = (np.unique(x[x > 0]) for x in (of_in, of))
        self.exact = len(a) * len(b) <= min(TABLE, max(pairs, 1 << 12))
        if self.exact:
            self.row, self.column = (np.zeros(len(names.names) + 1, dtype=np.int64) for _ in range(2))
            self.row[a], self.column[b] = np.arange(1, len(a) + 1), np.arange(1, len(b) + 1)
            self.table = np.full((len(a) + 1, len(b) + 1), 0 if least is None else _NEVER, dtype=np.int64)
            self.table[0] = 0
            self.table[1:, 1:] = self._scores(names.alike(np.repeat(a - 1, len(b)), np.tile(b - 1, len(a)))).reshape(len(a), len(b))

    def _scores(self, similarity: np.ndarray) -> np.ndarray:
        out = _half_up(self.weight * similarity)
        return out if self.least is None else np.where(similarity >= self.least, out, _NEVER)

    def _of_pairs(self, a: np.ndarray, b: np.ndarray, similarity) -> np.ndarray:
        out, both = np.where(a == 0, 0, 0 if self.least is None else _NEVER), np.flatnonzero((a > 0) & (b > 0))
        out[both] = self._scores(similarity(a[both] - 1, b[both] - 1))
        return out

    def at_most(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.table[self.row[a], self.column[b]] if self.exact else self._of_pairs(a, b, self.names.at_most)

    def runs_at_most(self, a: np.ndarray, runs: Runs, run: np.ndarray) -> np.ndarray:
        """As at_most(), for any of a run's names."""
        out, some = np.zeros(len(a), dtype=np.int64), np.flatnonzero(a > 0)
        out[some] = self._scores(self.names.at_most(a[some] - 1, run[some], of=runs))
        return out

    def scores(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Each different pair of names is compared once."""
        if self.exact:
            return self.at_most(a, b)

        def alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            pairs, of = np.unique(a * len(self.names.names) + b, return_inverse=True)
            return self.names.alike(pairs // len(self.names.names), pairs % len(self.names.names))[of] if len(pairs) else np.zeros(0)

        return self._of_pairs(a, b, alike)


class _Group:
    """One group's different inputs and candidates in numbers."""

    def __init__(self, asked: pa.Table, of: pa.Table, k: int, gate: bool, weights: dict, least_street: float, streetless: bool = False):
        self.w = weights
        of = of.take(pc.sort_indices(of, sort_keys=[("_sub", "ascending"), ("address_detail_pid", "ascending")], null_placement="at_start"))
        _, sub_in, sub_of = named(asked["_sub"], of["_sub"])
        streets, street_in, street_of = named(asked["in_street_name"], of["street_name"])
        streets, street_in, street_of = _by_name(streets, street_in, street_of)
        if streetless:
            street_of[:] = 0
        places, place_in, place_of = named(asked["in_locality"], of["locality_name"])
        _, type_in, type_of = named(asked["in_street_type"], of["street_type"])
        flat = lambda c: pc.utf8_trim(pc.fill_null(c.cast(pa.string()), ""), " ")
        _, flat_in, flat_of = named(flat(asked["in_flat_number"]), flat(of["flat_number"]))
        n, code_in, code_of = _numbers(asked["in_number_first"]), _numbers(asked["in_postcode"]), _numbers(of["postcode"])
        kind_of = of["_kind"].to_numpy(zero_copy_only=False)
        first, last = _numbers(of["number_first"]), _numbers(of["number_last"])
        suffix = asked["in_number_suffix"].to_pylist()
        begins = [f"{n[i]}{s} " if s is not None and n[i] != _NONE else None for i, s in enumerate(suffix)]
        lettered = np.array([s is not None for s in suffix], dtype=np.int64)
        wanted = {b: i + 1 for i, b in enumerate(dict.fromkeys(b for b in begins if b is not None))}
        begin_in = np.array([wanted.get(b, 0) for b in begins], dtype=np.int64)
        label_of = np.zeros(len(of), dtype=np.int64)
        if wanted:
            label = of["address_label"]
            if not any(s and " " in s for s in suffix):
                label = pc.replace_substring_regex(label.cast(pa.string()), r"(?s) .*", " ")
            label_of = named(label, label.slice(0, 0))[1]
        if gate:  # without a number of the input, those of a record say nothing
            first, last, label_of = (np.where(kind_of == "any", none, c) for c, none in ((first, _NONE), (last, _NONE), (label_of, 0)))
        # Inputs are in the order of their heads: what comes first here.
        inputs = np.column_stack([sub_in, street_in, place_in, code_in, type_in, flat_in, n, lettered, begin_in])
        inputs, at, self.of_input = np.unique(inputs, axis=0, return_index=True, return_inverse=True)
        self.of_input = self.of_input.ravel()
        self.type, self.flat, self.n, self.lettered, self.begin = inputs[:, 4:].T.copy()
        kind = asked["_kind"].to_numpy(zero_copy_only=False)[at]
        self.ranged, self.letter = gate & np.isin(kind, ["blocks", "wide"]), gate & (kind == "letter")
        records = np.column_stack([sub_of, street_of, place_of, type_of, flat_of, code_of, first, last, label_of])
        _, alike = np.unique(records, axis=0, return_inverse=True)
        order, rank = _by_rank(alike.ravel())
        keep = np.sort(order[rank < k])
        self.records = of.take(pa.array(keep))
        self.c_type, self.c_flat, self.c_first, self.c_last = records[keep][:, [3, 4, 6, 7]].T.copy()
        self.begins = np.zeros((len(wanted) + 1, len(keep)), dtype=bool)
        for text, i in wanted.items():
            self.begins[i] = pc.fill_null(pc.starts_with(self.records["address_label"], text), False).to_numpy(zero_copy_only=False)
        cells, of_cell = np.unique(records[keep][:, [0, 1, 2, 5]], axis=0, return_inverse=True)
        self.in_cell, self.cell_size = np.argsort(of_cell.ravel(), kind="stable"), np.bincount(of_cell.ravel(), minlength=len(cells))
        self.cell_start = np.cumsum(self.cell_size) - self.cell_size
        heads, self.head_start, self.head_of, self.head_size = np.unique(inputs[:, :4], axis=0, return_index=True, return_inverse=True, return_counts=True)
        self.head_of = self.head_of.ravel()
        sub, self.street, self.place, self.code = heads.T.copy()
        c_sub, self.c_street, self.c_place, self.c_code = cells.T.copy()
        self.start = np.searchsorted(c_sub, sub)
        self.count = np.searchsorted(c_sub, sub, "right") - self.start
        self.tier = np.array([int(self._const("postcode") * share + 0.5 + 1e-9) for share in (1.0, 0.7, 0.4, 0.2)] + [0])
        #: What the other three scores of an input are at most.
        self.rest = self._const("type") + self._const("flat") + np.where(self.n == _NONE, 0, self._const("number"))
        pairs = int(self.count.sum())
        self.streets = _Likeness(Names(streets), weights["street"], least_street, self.street, self.c_street, pairs)
        self.places = _Likeness(Names(places), weights["suburb"], None, self.place, self.c_place, pairs)
        #: Heads whose cells are looked at together have so many of them.
        self.effort = self.count
        if not self.streets.exact:
            self.effort = -(-self.count // PRUNED)
            self._in_runs(sub, c_sub)

    def _in_runs(self, sub: np.ndarray, c_sub: np.ndarray) -> None:
        """Runs of cells of a key that are next to each other by name; at most what total of place and postcode a head has with its key's cells."""
        keys, start, size = np.unique(c_sub, return_index=True, return_counts=True)
        runs = -(-size // RUN)
        self.run_start = _spread(np.zeros_like(start), runs) * RUN + np.repeat(start, runs)
        self.run_size = np.minimum(self.run_start + RUN, np.repeat(start + size, runs)) - self.run_start
        self.runs = Runs(self.streets.names, self.c_street - 1, self.run_start)
        first = np.cumsum(runs) - runs
        at = np.minimum(np.searchsorted(keys, sub), len(keys) - 1)
        self.runs_of, self.run_count = first[at], np.where(self.count > 0, runs[at], 0)
        wide = len(streets) + 1 if (streets := self.streets.names.names) else 1
        self.near_to = np.searchsorted(c_sub * wide + self.c_street, sub * wide + self.street)
        # Places and postcodes of a key are few beside its cells; bounds are made only if they are.
        kinds, kind = np.unique(np.column_stack([c_sub, self.c_place, self.c_code]), axis=0, return_index=True)
        begin, end = np.searchsorted(kinds[:, 0], sub), np.searchsorted(kinds[:, 0], sub, "right")
        self.others = np.full(len(sub), int(self.tier[0]) + self._const("suburb") + 1)
        some = np.flatnonzero((end > begin) & ((end - begin) * 4 <= self.count + 4))
        count = (end - begin)[some]
        h, cell = np.repeat(some, count), kind[_spread(begin[some], count)]
        best = self._tiers(h, cell) + self.places.at_most(self.place[h], self.c_place[cell])
        if len(some):
            self.others[some] = np.maximum.reduceat(best, np.cumsum(count) - count)

    def near(self, heads: np.ndarray, tries: int) -> tuple[np.ndarray, np.ndarray]:
        """From which to before which cell of its key are next to a head by name: with very many names only."""
        if self.streets.exact:
            return self.start[heads], self.start[heads]
        begin = np.maximum(self.near_to[heads] - tries // 2, self.start[heads])
        return begin, np.minimum(begin + 2 * tries, self.start[heads] + self.count[heads])

    def _const(self, part: str, share: float = 1.0) -> int:
        return int(round(self.w[part] * share))

    def _tiers(self, h: np.ndarray, cell: np.ndarray) -> np.ndarray:
        a, b = self.code[h], self.c_code[cell]
        return self.tier[np.where((a != _NONE) & (b != _NONE), np.minimum(np.abs(a - b), 4), 4)]

    def cells(self, heads: np.ndarray, least: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Heads with cells, but for those from ``begin`` on, by which three scores may reach ``least`` in all, and at most what
        these are; by head, most first."""
        if self.streets.exact:
            count, start = self.count[heads], self.start[heads]
            of = np.arange(len(heads))
        else:
            count = self.run_count[heads]
            of, run = np.repeat(np.arange(len(heads)), count), _spread(self.runs_of[heads], count)
            h = heads[of]
            good = np.flatnonzero(self.streets.runs_at_most(self.street[h], self.runs, run) + self.others[h] >= least[of])
            of, start, count = of[good], self.run_start[run[good]], self.run_size[run[good]]
        found = [(np.zeros(0, dtype=np.int64),) * 3]
        for some in _stretches(count, CHUNK if self.streets.exact else BOUNDS):
            each, cell = np.repeat(of[some], count[some]), _spread(start[some], count[some])
            if not self.streets.exact:
                new = np.flatnonzero((cell < begin[each]) | (cell >= end[each]))
                each, cell = each[new], cell[new]
            h = heads[each]
            upper = self.streets.at_most(self.street[h], self.c_street[cell])
            if not self.streets.exact:
                good = np.flatnonzero(upper + self.others[h] >= least[each])
                each, h, cell, upper = each[good], h[good], cell[good], upper[good]
            upper = upper + self._tiers(h, cell) + self.places.at_most(self.place[h], self.c_place[cell])
            good = np.flatnonzero(upper >= least[each])
            found.append((h[good], cell[good], upper[good]))
        h, cell, upper = (np.concatenate(x) for x in zip(*found, strict=True))
        at = np.argsort(h * _SPAN - upper, kind="stable")
        return h[at], cell[at], upper[at]

    def parts(self, h: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """Scores of postcode, place and street."""
        return np.stack([self._tiers(h, cell), self.places.scores(self.place[h], self.c_place[cell]), self.streets.scores(self.street[h], self.c_street[cell])])

    def pairs(self, row: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Records of these inputs' cells that pass the gate: which of the cells, the record, scores of type, number and flat."""
        size = self.cell_size[cell]
        at, c = np.repeat(np.arange(len(row)), size), self.in_cell[_spread(self.cell_start[cell], size)]
        row = row[at]
        if self.ranged.any() or self.letter.any():
            n = self.n[row]
            fine = ~self.ranged[row] | ((self.c_first[c] < n) & (n <= self.c_last[c]))
            fine &= ~self.letter[row] | self.begins[self.begin[row], c]
            at, row, c = at[fine], row[fine], c[fine]
        n, first, last = self.n[row], self.c_first[c], self.c_last[c]
        a, b = self.type[row], self.c_type[c]
        kind = np.where(a == b, self._const("type"), np.where((a == 0) | (b == 0), self._const("type", 0.5), self._const("type", 0.4)))
        same = (n == first) | (first == _NONE)
        plain = np.where(n == first, self._const("number"), np.where((last != _NONE) & (first != _NONE) & (first <= n) & (n <= last), self._const("number", 0.7), 0))
        letter = np.where(same & self.begins[self.begin[row], c], self._const("number"), 0) if self.lettered.any() else 0
        number = np.where(n == _NONE, 0, np.where(self.lettered[row] == 1, letter, plain))
        return at, c, np.stack([kind, number, np.where(self.flat[row] == self.c_flat[c], self._const("flat"), 0)])


def _best_of_heads(g: _Group, heads: np.ndarray, k: int, tries: int, floor: int) -> tuple | None:
    """Of some heads next to each other: inputs in order, records, scores, totals of the best."""
    rows = _spread(g.head_start[heads], g.head_size[heads])
    mine = np.searchsorted(heads, g.head_of[rows])
    found: list[tuple] = []
    least = np.full(len(rows), floor)

    def look(cell: np.ndarray, parts: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> None:
        """Compares each input with the records of a range of its cells; raises its least total to that of its k-th best."""
        upto = np.concatenate([[0], np.cumsum(g.cell_size[cell])])
        for some in _stretches(upto[stop] - upto[begin]):
            count = stop[some] - begin[some]
            i, at = np.repeat(some, count), _spread(begin[some], count)
            known = parts[:, at].sum(axis=0)
            able = np.flatnonzero(known + g.rest[rows[i]] >= least[i])
            i, at, known = i[able], at[able], known[able]
            of, c, more = g.pairs(rows[i], cell[at])
            total = known[of] + more.sum(axis=0)
            fine = np.flatnonzero(total >= least[i[of]])
            of, c, more, total = of[fine], c[fine], more[:, fine], total[fine]
            order, rank = _by_rank(i[of], -total, c)
            keep = order[rank < k]
            found.append((i[of[keep]], c[keep], np.concatenate([parts[:, at[of[keep]]], more[:, keep]]), total[keep]))
            kth = order[rank == k - 1]
            least[i[of[kth]]] = total[kth]

    begin, end = g.near(heads, tries)
    if (end > begin).any():
        count = end - begin
        h, cell = np.repeat(heads, count), _spread(begin, count)
        upto = np.concatenate([[0], np.cumsum(count)])
        look(cell, g.parts(h, cell), upto[mine], upto[mine + 1])
    wanted = np.full(len(heads), _SPAN)
    np.minimum.at(wanted, mine, least - g.rest[rows])
    h, cell, upper = g.cells(heads, wanted, begin, end)
    upto = np.concatenate([[0], np.cumsum(g.cell_size[cell])])
    start, end = np.searchsorted(h, heads), np.searchsorted(h, heads, "right")
    lead = np.minimum(np.searchsorted(upto, upto[start] + tries), end)
    parts = np.full((3, len(h)), _NEVER)
    place = np.arange(len(h))
    head = np.searchsorted(heads, h)
    first = np.flatnonzero(place < lead[head])
    parts[:, first] = g.parts(h[first], cell[first])
    look(cell, parts, start[mine], lead[mine])
    # Bounds fall within a head: the cells that may reach an input's least total come first.
    far = np.maximum(np.searchsorted(h * _SPAN - upper, heads[mine] * _SPAN - (least - g.rest[rows]), "right"), lead[mine])
    furthest = lead.copy()
    np.maximum.at(furthest, mine, far)
    more = np.flatnonzero((place >= lead[head]) & (place < furthest[head]))
    parts[:, more] = g.parts(h[more], cell[more])
    look(cell, parts, lead[mine], far)
    if not found:
        return None
    i, c, total = (np.concatenate([x[j] for x in found]) for j in (0, 1, 3))
    scores = np.concatenate([x[2] for x in found], axis=1)
    order, rank = _by_rank(i, -total, c)
    keep = order[rank < k]
    return rows[i[keep]], c[keep], scores[:, keep], total[keep]


def _best_of_group(asked: pa.Table, of: pa.Table, k: int, tries: int, floor: int, weights: dict, gate: bool, least_street: float, schema: pa.Schema, streetless: bool | None = None) -> pa.Table:
    if not len(asked) or not len(of):
        return schema.empty_table()
    # To inputs without a street, records that differ in their streets alone are alike.
    named_ = asked["in_street_name"].is_valid()
    if streetless is None and not pc.all(named_).as_py():
        both = ((asked.filter(some), without) for some, without in ((named_, False), (pc.invert(named_), True)))
        return pa.concat_tables([_best_of_group(a, of, k, tries, floor, weights, gate, least_street, schema, without) for a, without in both])
    g = _Group(asked, of, k, gate, weights, least_street, bool(streetless))
    found = [x for heads in _stretches(g.effort) if (x := _best_of_heads(g, heads, k, tries, floor)) is not None]
    if not found:
        return schema.empty_table()
    row, c, total = (np.concatenate([x[j] for x in found]) for j in (0, 1, 3))
    parts = dict(zip(_PARTS, np.concatenate([x[2] for x in found], axis=1), strict=True)) | {"total_score": total}
    # Each result serves every input that has these parts.
    start, count = np.searchsorted(row, np.arange(len(g.n))), np.bincount(row, minlength=len(g.n))
    times = count[g.of_input]
    each = _spread(start[g.of_input], times)
    records = g.records.take(pa.array(c[each]))
    ids = asked["input_id"].take(pa.array(np.repeat(np.arange(len(asked)), times)))
    columns = {"input_id": ids, **{x: records[x] for x in schema.names if x in records.column_names}, **{x: pa.array(p[each]) for x, p in parts.items()}}
    return pa.table([columns[f.name].cast(f.type) for f in schema], schema=schema)


def best_pairs(asked: DataFrame, of: DataFrame, wants: Column, offers: Column, left: str, right: str, k: int, tries: int, floor: int, weights: dict, gate: bool, least_street: float, columns: list[str], scratch: Scratch | None = None) -> DataFrame:
    """input_id, the candidates' ``columns``, scores and total_score: of each input's block at least the ``k`` best pairs that
    reach the floor. ``wants`` and ``offers`` are arrays of keys (kind, n); an input and a record meet by at most one."""
    # A record has many keys, made of nested values: records of few files are dealt over tasks first.
    of = of.select(*columns).repartition("address_detail_pid", "address_label")
    key = lambda df, c, keys: df.where(F.col(c).isNotNull()).withColumn("_k", F.explode(keys)).select("*", F.col(c).alias("_block"), F.col("_k.kind").alias("_kind"), F.coalesce("_k.n", F.lit(-1)).alias("_n")).drop("_k")
    needs = ["input_id", "in_street_name", "in_locality", "in_street_type", "in_flat_number", "in_postcode", "in_number_first", "in_number_suffix"]
    a, b = key(asked, left, wants).select(*needs, *_KEY), key(of, right, offers).select(*columns, *_KEY)
    sizes = a.groupBy(*_KEY).agg(F.count("*").alias("_na")).join(b.groupBy(*_KEY).agg(F.count("*").alias("_nb")), _KEY)
    sizes = held(sizes.select(*_KEY, F.ceil(F.col("_na") / IN_ROWS).cast("int").alias("_pa"), F.ceil(F.col("_nb") / OF_ROWS).cast("int").alias("_pb"), (F.col("_na") * F.col("_pb") + F.col("_nb") * F.col("_pa")).alias("_rows"), (F.col("_na") * F.col("_nb")).alias("_pairs"), F.monotonically_increasing_id().alias("_id")), scratch)
    keys, rows, pairs = sizes.agg(F.count("*"), F.coalesce(F.sum("_rows"), F.lit(0)), F.coalesce(F.sum("_pairs"), F.lit(0))).first()
    groups = int(max(1, -(-rows // GROUP_ROWS), -(-pairs // GROUP_PAIRS)))
    sizes = sizes.drop("_rows", "_pairs")
    sizes = F.broadcast(sizes) if keys * KEY_WIDTH <= KEY_BYTES else sizes
    sub = [F.concat_ws(":", "_id", "_ca", "_cb").alias("_sub"), F.pmod(F.xxhash64("_id", "_ca", "_cb"), F.lit(groups)).alias("_group"), "_kind"]
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    a = a.join(sizes, _KEY).withColumn("_ca", F.pmod(F.xxhash64("input_id"), "_pa").cast("int")).withColumn("_cb", every("_pb")).select(*needs, *sub)
    b = b.join(sizes, _KEY).withColumn("_cb", F.pmod(F.xxhash64("address_detail_pid", "address_label"), "_pb").cast("int")).withColumn("_ca", every("_pa")).select(*columns, *sub)
    kinds = {f.name: f.dataType.simpleString() for f in [*asked.select("input_id").schema.fields, *of.select(*columns).schema.fields]}
    schema = ", ".join([*[f"`{c}` {t}" for c, t in kinds.items()], *[f"{s} int" for s in SCORES], "total_score int"])
    arrow = _arrow_schema(asked, of, columns)
    w = dict(weights)

    def best(x: pa.Table, y: pa.Table) -> pa.Table:
        return _best_of_group(x, y, k, tries, floor, w, gate, least_street, arrow)

    return a.groupBy("_group").cogroup(b.groupBy("_group")).applyInArrow(best, schema)


def _arrow_schema(asked: DataFrame, of: DataFrame, columns: list[str]) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_type

    fields = [*asked.select("input_id").schema.fields, *of.select(*columns).schema.fields]
    return pa.schema([*[pa.field(f.name, to_arrow_type(f.dataType)) for f in fields], *[pa.field(s, pa.int32()) for s in [*SCORES, "total_score"]]])
