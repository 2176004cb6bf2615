"""Every query with SQL against DuckDB on the smallest tables."""

import math
from pathlib import Path

import pytest

from probity.plans import catalogue

duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        c.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 8)
    return v


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(name, spark, sf_dir, duck):
    df = catalogue.QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    assert got, "an empty result shows nothing"
    if name in catalogue.ORACLES:
        rel = duck.sql(catalogue.ORACLES[name])
        at = [list(rel.columns).index(c) for c in cols]
        assert got == sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)
