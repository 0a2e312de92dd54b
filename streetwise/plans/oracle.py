"""SQL pieces from which the queries' oracles are put together."""

from __future__ import annotations

from ..operators.scoring import WEIGHTS

#: By the kind of record: one without a number has its number and letter in the label, others have one number or a range.
_LABELLED = "starts_with(g.address_label, concat(i.in_number_first, i.in_number_suffix, ' '))"
GATE = f"""coalesce(CASE WHEN i.in_number_first IS NULL THEN TRUE WHEN g.number_first IS NULL THEN i.in_number_suffix IS NOT NULL AND {_LABELLED}
  ELSE i.in_number_first BETWEEN g.number_first AND greatest(g.number_first, coalesce(g.number_last, g.number_first)) END, FALSE)"""
STREET = "(i.in_street_name IS NULL OR jaro_winkler_similarity(g.street_name, i.in_street_name) >= 0.3)"


def scores(w: dict[str, float] = WEIGHTS) -> str:
    tier = lambda share: int(w["postcode"] * share + 0.5 + 1e-9)
    return f"""
  CASE abs(i.in_postcode - g.postcode) WHEN 0 THEN {tier(1)} WHEN 1 THEN {tier(0.7)} WHEN 2 THEN {tier(0.4)} WHEN 3 THEN {tier(0.2)} ELSE 0 END AS score_postcode,
  coalesce(CAST(round({w["suburb"]:g} * jaro_winkler_similarity(i.in_locality, g.locality_name)) AS INT), 0) AS score_suburb,
  coalesce(CAST(round({w["street"]:g} * jaro_winkler_similarity(i.in_street_name, g.street_name)) AS INT), 0) AS score_street_name,
  CASE WHEN i.in_street_type IS NOT DISTINCT FROM g.street_type THEN {round(w["type"])} WHEN i.in_street_type IS NULL OR g.street_type IS NULL THEN {round(w["type"] * 0.5)} ELSE {round(w["type"] * 0.4)} END AS score_street_type,
  CASE WHEN i.in_number_suffix IS NOT NULL THEN CASE WHEN coalesce(g.number_first, i.in_number_first) = i.in_number_first AND {_LABELLED} THEN {round(w["number"])} ELSE 0 END
    ELSE CASE WHEN i.in_number_first = g.number_first THEN {round(w["number"])} WHEN i.in_number_first BETWEEN g.number_first AND g.number_last THEN {round(w["number"] * 0.7)} ELSE 0 END END AS score_number,
  CASE WHEN trim(coalesce(i.in_flat_number, '')) = trim(coalesce(g.flat_number, '')) THEN {round(w["flat"])} ELSE 0 END AS score_flat"""


TOTAL = "score_postcode + score_suburb + score_street_name + score_street_type + score_number + score_flat"
OUT = "input_id, address_detail_pid, score_postcode, score_suburb, score_street_name, score_street_type, score_number, score_flat, total_score, match_rank"


def path(inputs: str, addresses: str, on: str, k: int = 1, floor: int = 60, where: str = "TRUE", gate: bool = True, w: dict[str, float] = WEIGHTS, out: str = OUT) -> str:
    return f"""SELECT {out} FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY input_id ORDER BY total_score DESC, address_detail_pid) AS INT) AS match_rank FROM (
    SELECT *, CAST({TOTAL} AS INT) AS total_score FROM (
      SELECT i.input_id, g.address_detail_pid, {scores(w)}
      FROM {inputs} i JOIN {addresses} g ON {on} WHERE {GATE if gate else "TRUE"} AND {STREET} AND {where}))
  WHERE total_score >= {floor}) WHERE match_rank <= {k}"""


#: Index of localities, and the inputs widened to other postcodes.
INDEX = "SELECT DISTINCT locality_name, postcode, state FROM (SELECT locality_name, postcode, state FROM addr UNION ALL SELECT locality_name, postcode, state FROM cust)"


def widened(inputs: str, index: str) -> str:
    return f"""SELECT i.*, m.postcode AS alt_postcode FROM {inputs} i JOIN (
    SELECT DISTINCT u.in_locality, x.postcode FROM (SELECT DISTINCT in_locality, in_state FROM {inputs} WHERE in_locality IS NOT NULL) u
    JOIN {index} x ON jaro_winkler_similarity(x.locality_name, u.in_locality) >= 0.85 AND (u.in_state IS NULL OR x.state = u.in_state)) m ON m.in_locality = i.in_locality
  UNION SELECT i.*, i.in_postcode + o.d FROM {inputs} i CROSS JOIN (VALUES (-3), (-2), (-1), (1), (2), (3)) AS o(d) WHERE i.in_postcode IS NOT NULL"""


def best_of(parts: list[str], k: int, out: str = OUT) -> str:
    """Union of path results: a record once an input, ranked anew."""
    union = " UNION ALL ".join(f"SELECT * FROM ({p})" for p in parts)
    return f"""SELECT {out} FROM (SELECT * EXCLUDE (n, match_rank), CAST(row_number() OVER (PARTITION BY input_id ORDER BY total_score DESC, address_detail_pid) AS INT) AS match_rank
  FROM (SELECT *, row_number() OVER (PARTITION BY input_id, address_detail_pid ORDER BY total_score DESC) AS n FROM ({union})) WHERE n = 1) WHERE match_rank <= {k}"""
