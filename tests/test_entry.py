import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from strataview.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def normal(df: pd.DataFrame) -> list:
    def text(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return "NULL"
        return repr(round(float(v), 6)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(map(text, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    assert normal(QUERIES[name](spark, SF).toPandas()) == normal(duck.sql(ORACLE_SQL[name]).df())


def test_entry(spark):
    assert entry.entry(spark).count() > 10
    assert set(entry.oracle_sql()) <= set(entry.queries())
