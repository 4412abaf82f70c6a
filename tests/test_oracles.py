"""Every memory query with an oracle gives DuckDB's rows at the smallest size."""

import math

import duckdb
import pytest

from recallspark.plans.oracles import ORACLES
from recallspark.plans.queries import REGISTRY

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations", "events"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, int | float):
        return "nan" if math.isnan(x) else x if math.isinf(x) else round(float(x), 9)
    return float(x) if type(x).__name__ == "Decimal" else x


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, name):
    df = REGISTRY[name](spark, DATA)
    columns = sorted(df.columns)
    found = duck.execute(ORACLES[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    theirs = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr) == theirs
