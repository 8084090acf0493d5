from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from cloakframe.plans import catalogue


@pytest.fixture(scope="module")
def oracle(sf_dir):
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_equals_sql(spark, sf_dir, oracle, name):
    got = catalogue.QUERIES[name](spark, sf_dir)
    want = oracle.execute(catalogue.ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    order = lambda r: tuple(str(x) for x in r)
    assert sorted(map(order, got.select(*columns).collect())) == sorted(map(order, want.fetchall()))
