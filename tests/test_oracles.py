"""Every registered query against its DuckDB equivalent on the smallest tables."""

import glob
import os
from decimal import Decimal

import duckdb
import numpy as np
import pytest

from scrivener.plans import catalog


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def plain(v):
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(plain(x) for x in v)
    if isinstance(v, (float, Decimal)):
        return None if v != v else round(float(v), 9)
    return v


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, sf_dir, name):
    df = catalog.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    found = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    r = duck.sql(catalog.oracle_sql()[name])
    assert sorted(r.columns) == columns
    at = [list(r.columns).index(c) for c in columns]
    assert found == sorted((tuple(plain(x[i]) for i in at) for x in r.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_has_rows(spark, sf_dir, name):
    assert catalog.queries()[name](spark, sf_dir).count() > 0


def test_entry(spark, sf_dir):
    assert catalog.entry(spark, sf_dir).count() == 20
