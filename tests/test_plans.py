"""Plan regressions: the plans that ran keep the properties the design relies on at scale."""

import re

import __spark_entry__ as entry
from telemetrix.operators import timeseries as ts
from telemetrix.session import executed_plan
from telemetrix.sources import tables as tb


def _plan(spark, name, sf):
    return executed_plan(entry.queries()[name](spark, sf))


def test_preparation_windows_are_chunked_and_scan_is_pruned(spark, sf_small):
    # flights longer than the bound on a chunk's rows
    plan = executed_plan(ts.prepare_flights(tb.lineitem_sensor(spark, sf_small, inject_gaps=True), tb.LINEITEM_CHANNELS, tb.LINEITEM_ORDER,
                                            None, tb.LINEITEM_CLIP, tb.LINEITEM_DERIVE, n_steps=tb.LINEITEM_N, max_rows=100))
    windows = [ln for ln in plan.splitlines() if re.search(r"\bWindow \[", ln)]
    assert windows, plan
    # row-level windows partition by (flight, chunk); only the chunk-summary windows use the flight alone
    assert any("_chunk" in ln for ln in windows)
    scans = [ln for ln in plan.splitlines() if "FileScan parquet" in ln and "lineitem" in ln]
    assert scans and all("l_returnflag" not in ln and "l_linestatus" not in ln for ln in scans)


def test_no_shrinking_frames(spark, sf_small):
    # "current row (or an offset) .. unbounded following" is recomputed per row (O(n^2));
    # whole-partition frames (unbounded preceding .. unbounded following) are computed once.
    bad = re.compile(r"rowframe, (currentrow\$\(\)|-?\d+), unboundedfollowing")
    for name in ("e_cut_pad", "e_ffill_bfill", "e_anomaly_segments", "f_stratified_split"):
        assert not bad.search(_plan(spark, name, sf_small).lower()), name


def test_detection_has_no_pairwise_joins(spark, sf_small):
    for name in ("d_anomaly_score", "d_phase_channel_stats", "d_anomaly_timeline", "f_top_anomalies"):
        plan = _plan(spark, name, sf_small)
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_psi_counts_are_combined_map_side(spark, sf_small):
    plan = _plan(spark, "d_psi_drift", sf_small)
    assert "partial_count" in plan


def test_semi_join_uses_checked_broadcast(spark, sf_small):
    plan = _plan(spark, "c_semi_join_sensor", sf_small)
    assert "BroadcastHashJoin" in plan and "LeftSemi" in plan


def test_baseline_aggregate_is_shuffled_once(spark, sf_small):
    # both steps of the fit read one exchange of the per-(flight, phase) moments
    plan = _plan(spark, "d_baseline_fit", sf_small)
    assert "ReusedExchange" in plan
