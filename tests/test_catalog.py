"""Every core query that has SQL gives the same rows as DuckDB at the smallest scale."""

import glob
import math
import os
from collections import Counter

import pytest

from touchline.plans import catalog

DATA = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
NAMES = sorted(set(catalog.queries()) & set(catalog.oracle_sql()))


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 4)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    want = con.sql(catalog.oracle_sql()[name])
    df = catalog.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    at = [want.columns.index(c) for c in cols]
    assert Counter(plain(tuple(r[c] for c in cols)) for r in df.collect()) == Counter(plain(tuple(r[i] for i in at)) for r in want.fetchall())
