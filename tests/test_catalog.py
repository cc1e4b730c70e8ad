"""Every query with SQL against DuckDB on the smallest tables, and the rest against brute force."""

import os

import duckdb
import pytest

from lodeline.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


#: Queries over words, which the smallest tables hardly test: these are compared on the next larger ones too.
WORDY = "alias_containment event_kinds folded_keys movement_outcomes passage_overlap place_inventory relevance_labels travel_modes turn_continuation".split()


def views(folder):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


@pytest.fixture(scope="module")
def duck(sf_dir):
    return views(sf_dir)


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted("|".join(f"{v:.6f}" if isinstance(v, float) else str(v) for v in r) for r in frame[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_equals_sql(spark, sf_dir, duck, name):
    assert rows(catalog.queries()[name](spark, sf_dir).toPandas()) == rows(duck.execute(catalog.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", WORDY)
def test_words_equal_sql(spark, sf_dir, name):
    folder = sf_dir.replace("0.001", "0.01")
    found = rows(catalog.queries()[name](spark, folder).toPandas())
    assert found[1] and found == rows(views(folder).execute(catalog.oracle_sql()[name]).df())


def test_points_equal_sql_to_the_last_bit(spark, sf_dir, duck):
    found = sorted(map(tuple, catalog._points(spark, sf_dir, "customer", "c_custkey").collect()))
    assert found == sorted(duck.execute(f"SELECT * FROM {catalog._points_sql('customer', 'c_custkey')}").fetchall())


@pytest.mark.parametrize("name", ["points_in_polygons", "segments_on_land"])
def test_borders_equal_sql(spark, sf_dir, name):
    """Points on borders, of which the smaller tables have few."""
    folder = sf_dir.replace("0.001", "0.1")
    assert rows(catalog.queries()[name](spark, folder).toPandas()) == rows(views(folder).execute(catalog.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, sf_dir, name):
    assert catalog.queries()[name](spark, sf_dir).count() > 0


def test_entry_and_registry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
