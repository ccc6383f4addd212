import duckdb
import pytest

from lexirun.llm.queries import ORACLES, QUERIES
from test_queries import rows_of


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_against_sql(spark, sf_dir, name):
    connection = duckdb.connect()
    for t in ("documents", "benchmark"):
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = QUERIES[name](spark, sf_dir)
    found = connection.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(names, found.fetchall())
