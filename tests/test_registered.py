"""Every registered query of the library's own operators runs, and gives what its SQL twin gives."""

import os
from numbers import Number

import duckdb
import numpy as np
import pytest

from loomrank.plans import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        if f.endswith(".parquet"):
            con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


def plain(frame):
    names = sorted(frame.columns)
    tidy = lambda v: None if v is None or v != v else round(float(v), 6) if isinstance(v, Number) and not isinstance(v, (bool, np.bool_)) else str(v)
    return names, sorted((tuple(tidy(v) for v in row) for row in frame[names].astype(object).where(frame[names].notna(), None).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sql, name):
    query, twin = catalog.QUERIES[name]
    got = query(spark, DATA)
    assert len(set(got.columns)) == len(got.columns)
    got = got.toPandas()
    if twin:
        have, want = plain(got), plain(sql.sql(twin).df())
        assert have[0] == want[0] and len(have[1]) == len(want[1])
        assert [[str(v) for v in r] for r in have[1]] == [[str(v) for v in r] for r in want[1]]


def test_job_cache_with_large_numbers(spark, tmp_path):
    import datetime as dt

    rows = [(k, k % 3, "view", dt.datetime(2024, 1, 31, 0, 0, 1)) for k in (2, 100_000, 250_001, 1_234_567, 6_000_006)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, ts timestamp_ntz").write.parquet(str(tmp_path / "events.parquet"))
    query, twin = catalog.QUERIES["job_cache"]
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    got = query(spark, str(tmp_path)).toPandas()
    assert len(got) == 3 and plain(got) == plain(con.sql(twin).df())
