"""Every query with an oracle, against DuckDB on the smallest tables."""

import os
from decimal import Decimal

import duckdb
import pytest

from brindle.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def rows(values, columns):
    def plain(x):
        if isinstance(x, (float, Decimal)):
            return repr(round(float(x), 6) + 0.0)
        return x.isoformat() if hasattr(x, "isoformat") else repr(x)

    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(plain(v[k]) for k in order) for v in values)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_oracle(spark, duck, name):
    ours = registry.queries()[name](spark, SF)
    theirs = duck.sql(registry.oracle_sql()[name])
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows([tuple(r) for r in ours.collect()], ours.columns) == rows(theirs.fetchall(), theirs.columns)
