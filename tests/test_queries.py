"""Every query with an oracle against DuckDB on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from streetwise.plans.catalogue import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="the driver's tables are not here")


def rows(df: pd.DataFrame) -> list[str]:
    plain = lambda v: None if pd.isna(v) else int(v) if isinstance(v, float) and v == int(v) else str(v)[:10] if hasattr(v, "year") else v
    return sorted(str(tuple(plain(v) for v in r)) for r in df.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_oracle(spark, name):
    con = duckdb.connect()
    for t in ("customer", "supplier", "part", "nation", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    want, got = con.execute(ORACLES[name]).df(), QUERIES[name](spark, DIR).toPandas()
    assert sorted(want.columns) == sorted(got.columns)
    columns = sorted(want.columns)
    assert rows(got[columns]) == rows(want[columns])


def test_cache_probe_stores_all_events(spark, tmp_path):
    """Events whose ids begin beyond the first 500 are entries too."""
    for t in ("customer", "supplier", "part", "nation", "events"):
        df = spark.read.parquet(f"{DIR}/{t}.parquet")
        (df.selectExpr("event_id + 2000 AS event_id", "* EXCEPT (event_id)") if t == "events" else df).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert QUERIES["cache_probe"](spark, str(tmp_path)).count() > 0
