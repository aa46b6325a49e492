"""Every registered query that has SQL gives the same rows as the SQL, over the smallest tables."""

import duckdb
import pytest

from quarrystone import file_queries  # noqa: F401  registers its queries
from quarrystone.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages labels conversations benchmark".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS FROM '{SF}/{name}.parquet'")
    return con


def canonical(frame):
    columns = sorted(frame.columns)
    return columns, sorted(map(repr, frame[columns].astype(object).where(frame[columns].notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    found = QUERIES[name](spark, SF).toPandas()
    assert len(found)
    if name in ORACLES:
        assert canonical(found) == canonical(duck.sql(ORACLES[name]).df())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
