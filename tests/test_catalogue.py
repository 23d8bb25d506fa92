"""Every query of the catalogue against its SQL in DuckDB, on the smallest whole tables."""

from pathlib import Path

import duckdb
import pytest

from glyphgrid.plans.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(map(tuple, df.astype(object).where(df.notna(), None).values.tolist()), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    mine = QUERIES[name](spark, SF).toPandas()
    assert len(mine)
    if name in ORACLES:
        other = db.sql(ORACLES[name]).df()
        assert sorted(mine.columns) == sorted(other.columns)
        assert rows(mine) == rows(other)
