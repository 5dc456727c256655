import math

import pytest

from telemetrix.llm import topk
from telemetrix.llm.topk import top_k


def brute(rows, queries, k):
    def ints(v):
        if v is None or any(x is None or not math.isfinite(x) for x in v):
            return None
        return [math.floor(256 * x) for x in v]

    base = [(i, ints(v)) for i, v in rows if i is not None and ints(v) is not None]
    out = []
    for q, v in {(i, tuple(v)): (i, v) for i, v in [(i, ints(v)) for i, v in queries if i is not None] if v is not None}.values():
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in base if i != q)
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def check(spark, rows, queries, **options):
    schema = "vec_id long, embedding array<float>, vec_id2 string"
    a = spark.createDataFrame([(*r, "x") for r in rows], schema)
    b = spark.createDataFrame([(*r, "x") for r in queries], schema)
    got = sorted(tuple(r) for r in top_k(a, b, **options).collect())
    assert got == brute(rows, queries, options.get("k", 5))


def test_like_brute_force_in_small_blocks(spark):
    rows = [(i, [((i * 7 + d * 13) % 17 - 8) / 16 for d in range(6)]) for i in range(90)]
    check(spark, rows, [r for r in rows if r[0] % 10 == 0], vector_block=16, query_block=2)
    check(spark, rows, [r for r in rows if r[0] % 10 == 0], k=3)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, 0.25]), (2, [0.5, 0.25]), (3, [0.5, 0.25]), (3, [0.5, 0.25]), (4, None), (5, [nan, 1.0]), (6, [inf, 1.0]),
            (7, [None, 1.0]), (None, [1.0, 1.0]), (8, []), (9, [0.0, 0.0]), (10, [-0.001, 3.0, 2.0]), (1, [0.1, 0.1])]
    check(spark, rows, rows, vector_block=4)
    check(spark, rows[:1], rows[:1])
    check(spark, [], [])


def test_a_task_holds_one_block_of_each_side(spark, monkeypatch):
    rows = [(i, [((i * 7 + d * 13) % 17 - 8) / 16 for d in range(6)]) for i in range(400)]
    made = topk._scorer

    def bounded(k, query_block):
        run = made(k, query_block)

        def held(base, asked):
            assert base.num_rows <= 80 and asked.num_rows <= 20, (base.num_rows, asked.num_rows)
            return run(base, asked)

        return held

    monkeypatch.setattr(topk, "_scorer", bounded)
    check(spark, rows, rows[::4], vector_block=40, query_block=10)
    monkeypatch.setattr(topk, "COMPONENTS", 60)  # blocks of ten vectors
    check(spark, rows[:100], rows[:100:2], k=3)


def test_large_weights_are_exact_or_raise(spark):
    rows = [(1, [2.0 ** 36, 1.0]), (2, [2.0 ** 35, -1.0]), (3, [-(2.0 ** 50), 3.0]), (4, [1.5, 2.0]), (5, [0.25, 0.0]), (6, [0.0, 2.0 ** 70])]
    check(spark, rows, [(4, [1.5, 0.0]), (5, [0.25, 0.0])], k=4)  # that of row 3 fits no long
    check(spark, rows[:3], [(8, [2.0 ** 10, 1.0])], k=2)
    with pytest.raises(Exception, match="(?i)too large|overflow|convert"):
        check(spark, rows[:2], [(9, [2.0 ** 36, 0.0])])
