"""Queries against their SQL, over the smallest tables and over awkward documents."""

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strataview.llm.jaccard_join import jaccard_join
from strataview.llm.queries import ORACLE_SQL, QUERIES
from strataview.llm.spelling import group_variants
from strataview.llm.warc import round_trip
from tests.llm.cases import DOC, frame, rows

SF = "/root/testdata/sf0.001"


def normal(df):
    text = lambda v: "NULL" if pd.isna(v) else str(int(v)) if isinstance(v, float) else str(v)
    return sorted(tuple(map(text, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


def solved(name, **tables):
    con = duckdb.connect()
    for table, data in tables.items():
        if isinstance(data, str):
            con.sql(f"create view {table} as select * from '{data}'")
        else:
            con.register(table, data)
    return normal(con.sql(ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    tables = {t: f"{SF}/{t}.parquet" for t in ("documents", "pages", "conversations")}
    assert normal(QUERIES[name](spark, SF).toPandas()) == solved(name, **tables)


def unique_rows():
    """The awkward rows once each, as the SQL knows documents by their ids."""
    return list({r[0]: r for r in rows()}.values())


def test_join_of_awkward_documents(spark):
    docs = frame(spark, unique_rows())
    assert normal(jaccard_join(docs).toPandas()) == solved("op7_jaccard_join", documents=docs.toArrow())


def test_spelling_of_awkward_documents(spark):
    chain = ["kettles", "kettlez", "mettlez"]
    text = " ".join([chain[0]] * 300 + [chain[1]] * 25 + [chain[2]] * 2 + ["kettlesx"] * 3 + ["ÀÉÎõüÿß", "àéîõüÿß"] * 2)
    docs = frame(spark, [*unique_rows(), *((100 + k, text, None, None, 0, "", "", "") for k in range(9))])
    assert normal(group_variants(docs, damage=31).toPandas()) == solved("op12_spelling", documents=docs.toArrow())


def test_archives_of_awkward_pages(spark):
    pages = frame(spark, unique_rows()).select(F.col("doc_id").alias("page_id"), F.lit("http://a b/").alias("url"), F.col("text").alias("html"))
    found = round_trip(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert normal(found.toPandas()) == solved("op10_warc", pages=pages.toArrow())


def test_no_documents(spark):
    none = spark.createDataFrame([], DOC)
    for name, run in (("op7_jaccard_join", jaccard_join), ("op12_spelling", group_variants)):
        assert run(none).count() == 0 and solved(name, documents=none.toArrow()) == []
