"""Property checks with random inputs: chunked ordering and filling equal pandas for any chunk width."""

import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from telemetrix.operators import chunked

series = st.lists(st.one_of(st.none(), st.floats(min_value=-1e3, max_value=1e3, allow_nan=False)),
                  min_size=1, max_size=60)


@settings(max_examples=6, deadline=None)
@given(a=series, b=series, width=st.integers(min_value=1, max_value=50))
def test_ordered_fill_equals_pandas(spark, a, b, width):
    rows = [(1, i * 2, v) for i, v in enumerate(a)] + [(2, i * 3, v) for i, v in enumerate(b)]
    df = spark.createDataFrame(rows, "k long, ts long, v double")
    got, lengths = chunked.ordered_fill(df, "k", ["ts"], F.floor(F.col("ts") / width), ["v"])
    out = {(r.k, r.t): (r.v, r.n_rows, r.ts) for r in got.collect()}
    for k, vals, step in ((1, a, 2), (2, b, 3)):
        want = pd.Series(vals, dtype="float64").ffill().bfill().fillna(0.0).tolist()
        for i, w in enumerate(want):
            v, n, ts = out[(k, i)]
            assert v == w and n == len(vals) and ts == i * step
    assert {r.k: r.n_rows for r in lengths.collect()} == {1: len(a), 2: len(b)}


def _segments_loop(points, gap=15, cap=15):
    if not points:
        return []
    segs, start, end = [], points[0], points[0]
    for p in points[1:]:
        if p - end <= gap:
            end = p
        else:
            segs.append((start, end))
            start = end = p
    segs.append((start, end))
    return segs[:cap]


@settings(max_examples=6, deadline=None)
@given(points=st.sets(st.integers(min_value=0, max_value=400), max_size=60),
       width=st.integers(min_value=2, max_value=120))
def test_segments_equal_loop(spark, points, width):
    from telemetrix.operators import local as lc
    rows = [(1, t, 1 if t in points else 0) for t in range(401)]
    df = spark.createDataFrame(rows, "flight_id long, t int, flag int")
    got = [(r.seg_start, r.seg_end) for r in lc.anomaly_segments(df, chunk_steps=width).orderBy("segment").collect()]
    assert got == _segments_loop(sorted(points))
