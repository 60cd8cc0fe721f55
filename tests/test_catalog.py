"""Every query of the reference's own operators against its DuckDB twin."""

import os

import duckdb
import pytest

from lorekeep.plans import catalog
from lorekeep.plans.oracle import TABLES, with_tables
from lorekeep.sources.tables import Tables

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
RAW = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    found = duckdb.connect()
    for name in RAW:
        found.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return found


def plain(v):
    if type(v).__name__ == "Decimal":
        return float(v)
    return tuple(v) if isinstance(v, list) else v


def rows(found, cols):
    return sorted((tuple(map(plain, r)) for r in found), key=str)


@pytest.mark.parametrize("name", sorted(TABLES))
def test_table(spark, con, name):
    ours = getattr(Tables(spark, SF), name)
    cols = sorted(ours.columns)
    assert rows(ours.select(*cols).collect(), cols) == rows(con.sql(with_tables(f"SELECT {', '.join(cols)} FROM {name}")).fetchall(), cols)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    ours = catalog.QUERIES[name](spark, SF)
    cols = sorted(ours.columns)
    got = rows(ours.select(*cols).collect(), cols)
    if name in catalog.ORACLE_SQL:
        theirs = con.sql(catalog.ORACLE_SQL[name])
        assert sorted(theirs.columns) == cols
        want = rows(theirs.select(*cols).fetchall(), cols)
        assert len(got) == len(want)
        assert got == want
