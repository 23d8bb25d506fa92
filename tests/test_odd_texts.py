"""Queries against their SQL in DuckDB on null, empty and odd texts."""

import duckdb
import pytest

from glyphgrid.plans.catalogue import ORACLES, QUERIES

from test_catalogue import rows

TEXTS = ["banana bandana " * 3, "", None, "a", "aaaa", "the nation of the ion", "é漢😀é é", "a\r\nb\x01", "anan" * 20, "the nation of the ion"]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """A folder with documents and conversations of odd texts, and DuckDB views on them."""
    folder = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    turns = [(i // 3, i % 3, t) for i, t in enumerate(TEXTS) if t]
    spark.createDataFrame(turns, "conv_id long, turn long, text string").write.parquet(f"{folder}/conversations.parquet")
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    return folder, con


def same(spark, odd, name):
    folder, con = odd
    mine, other = QUERIES[name](spark, folder).toPandas(), con.sql(ORACLES[name]).df()
    assert sorted(mine.columns) == sorted(other.columns)
    assert [[x if x == x else None for x in r] for r in rows(mine)] == [[x if x == x else None for x in r] for r in rows(other)]


@pytest.mark.parametrize("name", ["text_params_n_sigma", "effective_width"])
def test_params(spark, odd, name):
    same(spark, odd, name)


def planned(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["range_count_2d", "wt_quantile", "wt_interval_symbols", "wt_lex_count", "wt_intersect", "wt_unique_range"])
def test_middle_rows(spark, odd, name):
    same(spark, odd, name)
    if name != "wt_intersect":  # which joins its two sides
        assert "Join" not in planned(QUERIES[name](spark, odd[0]))


def test_run_table(spark, odd):
    same(spark, odd, "bwt_run_table")
    assert "Window" not in planned(QUERIES["bwt_run_table"](spark, odd[0]))
