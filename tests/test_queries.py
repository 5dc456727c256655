"""Registered queries: every one runs at sf0.001; a subset is compared with its DuckDB twin."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

CHECKED = ["d_anomaly_score", "d_baseline_fit", "f_top_anomalies", "b_header_clean", "d_step_audit",
           "e_cut_pad", "e_ffill_bfill", "f_stratified_split", "d_local_flight_score", "e_anomaly_segments",
           "d_classification_metrics", "i_promotion_decision", "d_psi_drift", "i_plain_explanation"]


def _norm(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if pd.api.types.is_float_dtype(df[c]):
            df[c] = df[c].round(6)
        df[c] = df[c].map(lambda v: None if v is None or (isinstance(v, float) and pd.isna(v)) else str(v))
    return df.sort_values(list(df.columns), na_position="first").reset_index(drop=True)


@pytest.fixture(scope="module")
def duck(sf_small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_small}/{t}.parquet')")
    return con


def test_registry_is_consistent():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 60


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["flight_id", "anomaly_score"] and df.count() > 0


@pytest.mark.parametrize("name", CHECKED)
def test_matches_sql_twin(spark, duck, sf_small, name):
    sp = entry.queries()[name](spark, sf_small).toPandas()
    dk = duck.execute(entry.oracle_sql()[name]).df()
    assert sorted(sp.columns) == sorted(dk.columns)
    assert len(sp) == len(dk)
    assert _norm(sp).equals(_norm(dk))
