"""I2 with rectified E9 filter outputs."""

import duckdb

import __spark_entry__ as entry
from telemetrix.operators import score as sc
from tests.test_queries import _norm


def test_pooled_filters_match_sql_twin(spark, sf_small):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{sf_small}/events.parquet')")
    got = entry.queries()["i_pooled_filters"](spark, sf_small).toPandas()
    want = con.execute(entry.oracle_sql()["i_pooled_filters"]).df()
    assert len(got) and "value_d128" in got.columns
    assert _norm(got).equals(_norm(want))


def test_rectified_means(spark):
    rows = spark.createDataFrame([(1, -2.0, -2.0), (1, 4.0, 4.0), (1, None, None), (2, None, None)], "flight_id long, a double, b double")
    got = {r.flight_id: r for r in sc.pooled_features(rows, ["a", "b"], rectify=["b"]).collect()}
    assert (got[1].n_steps, got[1].a, got[1].b) == (3, 1.0, 2.0)
    assert (got[2].a, got[2].b) == (None, None)
