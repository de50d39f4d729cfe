"""Every query of the library against its SQL in DuckDB, and the driver's contract."""

import datetime
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tidemill.plans import ORACLE_SQL, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v.isoformat() if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(name, spark, duck):
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in names]) for r in df.collect())
    if name not in ORACLE_SQL:
        assert got
        return
    cur = duck.execute(ORACLE_SQL[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == names
    want = sorted(repr([plain(r[cols.index(c)]) for c in names]) for r in cur.fetchall())
    assert got == want


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_contract_covers_registry():
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE_SQL) <= set(entry.oracle_sql())


def test_prepared_rows_of_missing_values(spark, duck, tmp_path):
    duck.execute(f"copy (select * replace (case when event_id % 3 = 1 then null else value end as value) from events) to '{tmp_path}/events.parquet'")
    got = sorted(repr([plain(v) for v in r]) for r in QUERIES["prepared_rows"](spark, str(tmp_path)).collect())
    sql = ORACLE_SQL["prepared_rows"].replace("from events", f"from '{tmp_path}/events.parquet'")
    assert got == sorted(repr([plain(v) for v in r]) for r in duck.execute(sql).fetchall())
