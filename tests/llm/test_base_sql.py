"""What rules fix of operators 2, 3, 5 and 9, against DuckDB."""

import duckdb
import pytest

from tessella.llm.base_sql import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_its_oracle(spark, name):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(map(tuple, df.select(*columns).collect()))
    assert got == sorted(c.sql(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall()) and got
