"""Word lists of Australian addresses. All of these are fixed values."""

from __future__ import annotations

STATES = ["QLD", "NSW", "VIC", "SA", "WA", "TAS", "NT", "ACT"]
DIRECTIONS = ["NORTH", "SOUTH", "EAST", "WEST", "UPPER", "LOWER", "INNER", "OUTER"]

#: Spelling of a street type to its canonical form. Fixed values.
STREET_TYPES = {
    "ALLEY": "ALLEY", "ALLY": "ALLEY", "AL": "ALLEY",
    "ARCADE": "ARCADE", "ARC": "ARCADE",
    "AVENUE": "AVENUE", "AVE": "AVENUE", "AV": "AVENUE",
    "BOULEVARD": "BOULEVARD", "BLVD": "BOULEVARD", "BVD": "BOULEVARD",
    "BYPASS": "BYPASS", "BYPA": "BYPASS", "BYP": "BYPASS",
    "CIRCUIT": "CIRCUIT", "CCT": "CIRCUIT",
    "CLOSE": "CLOSE", "CL": "CLOSE",
    "CORNER": "CORNER", "CNR": "CORNER",
    "COURT": "COURT", "CT": "COURT", "CRT": "COURT",
    "CRESCENT": "CRESCENT", "CRES": "CRESCENT", "CR": "CRESCENT",
    "CDS": "CUL-DE-SAC",
    "DRIVE": "DRIVE", "DR": "DRIVE", "DV": "DRIVE",
    "ESPLANADE": "ESPLANADE", "ESP": "ESPLANADE",
    "EXPRESSWAY": "EXPRESSWAY", "EXPY": "EXPRESSWAY",
    "FREEWAY": "FREEWAY", "FWY": "FREEWAY",
    "GROVE": "GROVE", "GR": "GROVE", "GRV": "GROVE",
    "HIGHWAY": "HIGHWAY", "HWY": "HIGHWAY", "HY": "HIGHWAY",
    "JUNCTION": "JUNCTION", "JNC": "JUNCTION",
    "LANE": "LANE", "LN": "LANE", "LA": "LANE",
    "LINK": "LINK",
    "LOOP": "LOOP",
    "MEWS": "MEWS", "MWS": "MEWS",
    "MOTORWAY": "MOTORWAY", "MWY": "MOTORWAY",
    "PARADE": "PARADE", "PDE": "PARADE",
    "PARKWAY": "PARKWAY", "PKWY": "PARKWAY", "PWY": "PARKWAY", "PKY": "PARKWAY",
    "PLACE": "PLACE", "PL": "PLACE", "PLC": "PLACE",
    "PROMENADE": "PROMENADE", "PROM": "PROMENADE",
    "RESERVE": "RESERVE", "RES": "RESERVE",
    "RISE": "RISE", "RI": "RISE",
    "ROAD": "ROAD", "RD": "ROAD", "RDS": "ROAD",
    "ROW": "ROW", "RW": "ROW",
    "RUN": "RUN", "RN": "RUN",
    "SQUARE": "SQUARE", "SQ": "SQUARE",
    "STREET": "STREET", "ST": "STREET", "STR": "STREET",
    "TERRACE": "TERRACE", "TCE": "TERRACE", "TER": "TERRACE", "TERR": "TERRACE",
    "TRACK": "TRACK", "TRK": "TRACK", "TR": "TRACK",
    "VIEW": "VIEW", "VW": "VIEW",
    "VISTA": "VISTA", "VIS": "VISTA",
    "WALK": "WALK", "WK": "WALK",
    "WAY": "WAY", "WY": "WAY",
    "WHARF": "WHARF", "WHRF": "WHARF",
    "ACCESS": "ACCESS",
    "ANNEX": "ANNEX",
    "ARTERIAL": "ARTERIAL",
    "BOULEVARDE": "BOULEVARDE",
    "BRACE": "BRACE",
    "BREAK": "BREAK",
    "BROADWAY": "BROADWAY",
    "BUSWAY": "BUSWAY",
    "CHASE": "CHASE",
    "CIRCLE": "CIRCLE",
    "CORSO": "CORSO",
    "COURSE": "COURSE",
    "CROSSING": "CROSSING",
    "DEVIATION": "DEVIATION",
    "DRIVEWAY": "DRIVEWAY",
    "EASEMENT": "EASEMENT",
    "ELBOW": "ELBOW",
    "ENTRANCE": "ENTRANCE", "ENT": "ENTRANCE",
    "FAIRWAY": "FAIRWAY",
    "FIRELINE": "FIRELINE",
    "LINKWAY": "LINKWAY",
    "LYNNE": "LYNNE",
    "MALL": "MALL",
    "PASS": "PASS",
    "PATHWAY": "PATHWAY",
    "PLAZA": "PLAZA",
    "PRECINCT": "PRECINCT",
    "QUAY": "QUAY",
    "RAMP": "RAMP",
    "ROADS": "ROADS",
    "ROUND": "ROUND",
    "ROUTE": "ROUTE",
    "STRAIGHT": "STRAIGHT",
    "STRAIT": "STRAIT",
    "STRIP": "STRIP",
    "TRAIL": "TRAIL",
}
#: Spelling of a flat type to its canonical form. Fixed values.
FLAT_TYPES = {
    "UNIT": "UNIT", "UN": "UNIT",
    "APARTMENT": "APARTMENT", "APT": "APARTMENT", "APP": "APARTMENT",
    "FLAT": "FLAT", "FL": "FLAT", "FLT": "FLAT",
    "LEVEL": "LEVEL", "LVL": "LEVEL",
    "SUITE": "SUITE", "STE": "SUITE",
    "SHOP": "SHOP", "SH": "SHOP", "SHP": "SHOP",
    "VILLA": "VILLA", "VLA": "VILLA",
    "LOT": "LOT",
    "TENANCY": "TENANCY", "TNY": "TENANCY",
}
#: Single letters stuck to a flat number.
ATTACHED = {"U": "UNIT", "F": "FLAT", "A": "APARTMENT"}
#: Expansions of words in localities and street names, in this order.
EXPANSIONS = [
    (r"\bMNT\b", "MOUNT"), (r"\bMT\b", "MOUNT"), (r"\bST\b", "SAINT"), (r"\bNTH\b", "NORTH"), (r"\bSTH\b", "SOUTH"), (r"^N\b", "NORTH"),
    (r"^S\b", "SOUTH"), (r"^E\b", "EAST"), (r"^W\b", "WEST"), (r"\bCK\b", "CREEK"), (r"\s+&\s+", " AND "),
]
#: Ordinals 1 to 20 as words, for street names.
ORDINALS = [
    "FIRST", "SECOND", "THIRD", "FOURTH", "FIFTH", "SIXTH", "SEVENTH", "EIGHTH", "NINTH", "TENTH",
    "ELEVENTH", "TWELFTH", "THIRTEENTH", "FOURTEENTH", "FIFTEENTH", "SIXTEENTH", "SEVENTEENTH", "EIGHTEENTH", "NINETEENTH", "TWENTIETH",
]


def ordinal_suffix(n: int) -> str:
    """ST, ND, RD or TH, as English writes the number."""
    return "TH" if n % 100 in (11, 12, 13) else {1: "ST", 2: "ND", 3: "RD"}.get(n % 10, "TH")


def alternation(keys) -> str:
    """Longest key first, so that no key hides a longer one."""
    return "|".join(sorted(keys, key=len, reverse=True))


def shortest_spelling() -> dict[str, str]:
    """Canonical street type: its shortest spelling, the first one on ties."""
    out: dict[str, str] = {}
    for key, canonical in STREET_TYPES.items():
        if canonical not in out or len(key) < len(out[canonical]):
            out[canonical] = key
    return out
