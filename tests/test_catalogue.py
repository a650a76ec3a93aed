import math

import duckdb
import pytest

from skarn.plans import registry
from skarn.session import DRIVER_TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    with duckdb.connect() as db:
        for name in DRIVER_TABLES:
            db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
        yield db


def _plain(value):
    return "nan" if isinstance(value, float) and math.isnan(value) else value


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_against_oracle(spark, oracle, name):
    frame = registry.queries()[name](spark, SF)
    columns = sorted(frame.columns)
    got = sorted((tuple(_plain(r[c]) for c in columns) for r in frame.collect()), key=repr)
    result = oracle.execute(registry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted((tuple(_plain(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=repr)
    assert got == want
    assert got


def test_group_concat_order_covers_all_customers(spark, oracle):
    want = oracle.execute("SELECT count(DISTINCT o_custkey), count(*) FROM orders").fetchone()
    rows = registry.queries()["group_concat_order"](spark, SF).collect()
    assert (len(rows), sum(len(r.ks.split(",")) for r in rows)) == want


@pytest.mark.parametrize("name, of", [("order_multi", "customer"), ("order_nulls_default", "documents"), ("order_nulls_explicit", "documents"), ("order_expr", "part")])
def test_order_queries_return_the_whole_table_in_order(spark, oracle, name, of):
    got = registry.queries()[name](spark, SF)
    result = oracle.execute(registry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    rows = [tuple(r[c] for c in names) for r in got.collect()]
    assert rows == result.fetchall()
    assert len(rows) >= oracle.execute(f"SELECT count(*) FROM {of}").fetchone()[0]
    if "nulls" in name:
        assert {q is None for _, q in rows} == {True, False}
