"""Every query against its DuckDB oracle on the smallest tables, compared as sorted values."""

import math

import duckdb
import pytest

from tessera import registry

registry.load()
DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def norm(v):
    if isinstance(v, float):
        return 0.0 if v == 0 or math.isnan(v) else round(v, 6)
    return v


@pytest.mark.parametrize("name", sorted(registry.QUERIES | registry.EXAMPLES))
def test_query(spark, duck, name):
    df = (registry.QUERIES | registry.EXAMPLES)[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=str)
    if name not in registry.ORACLES:
        assert got
        return
    rel = duck.execute(registry.ORACLES[name])
    names = [x[0] for x in rel.description]
    want = sorted((tuple(norm(dict(zip(names, r))[c]) for c in cols) for r in rel.fetchall()), key=str)
    assert sorted(names) == cols
    assert len(got) == len(want)
    assert got == want
