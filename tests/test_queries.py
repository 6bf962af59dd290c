import glob
import os

import duckdb
import pytest

from photonlake.plans.registry import ORACLE_SQL, QUERIES
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLE_SQL.keys()


@pytest.mark.parametrize("name", QUERIES)
def test_query_matches_sql(spark, duck, name):
    mine, other = QUERIES[name](spark, SMALL).toPandas(), duck.execute(ORACLE_SQL[name]).df()
    columns = sorted(mine.columns)
    assert columns == sorted(other.columns)
    mine, other = (d[columns].sort_values(columns).reset_index(drop=True) for d in (mine, other))
    assert len(mine) == len(other) > 0
    for c in columns:
        assert ((mine[c] == other[c]) | (mine[c].isna() & other[c].isna())).all(), c
