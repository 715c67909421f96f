"""The corpus queries that SQL can express, against it on the smallest tables."""

import duckdb
import pytest

from itemforge.llm.queries import ORACLE_SQL, QUERIES
from tests.test_queries import DATA, TABLES, rows


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, name):
    duck = duckdb.connect()
    for t in TABLES:
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = QUERIES[name](spark, DATA)
    q = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in q.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(names, q.fetchall())
