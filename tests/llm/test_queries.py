"""The registered queries on the small tables: contracts, SQL where there is any, and the pipeline."""

import duckdb
import pandas as pd
import pytest

import corpus_pipeline
from pagespan.llm import queries

D = "/root/testdata/sf0.001"


def rows(df, cols):
    return sorted(tuple("None" if pd.isna(v) else str(int(v) if isinstance(v, float) and v == int(v) else v) for v in r) for r in df[cols].astype(object).values.tolist())


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    their = con.execute(queries.oracle_sql()[name]).fetchdf()
    cols = sorted(their.columns)
    own = queries.queries()[name](spark, D).toPandas()
    assert sorted(own.columns) == cols and rows(own, cols) == rows(their, cols)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, D)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), out.schema)
        sizes.append(docs.count())
    assert sizes[1] < sizes[0] and sizes[2] == sizes[1] and sizes[3] < sizes[2] and sizes[4] <= sizes[3] and docs.columns[-1] == "copy"
