import zlib

import numpy as np
from pyspark.sql import functions as F

from telemetrix.llm import quality
from telemetrix.llm.queries import op3_quality


def auc(score, y):
    rank = np.argsort(np.argsort(score))
    n1 = y.sum()
    return (rank[y == 1].sum() - n1 * (n1 - 1) / 2) / (n1 * (len(y) - n1))


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in op3_quality(spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    held = [(got[r.doc_id], r.quality) for r in labels if got[r.doc_id].held_out]
    assert all(g.held_out == (zlib.crc32(str(g.doc_id).encode()) % 5 == 0) and g.predicted == (g.score >= 0.3) for g in got.values())
    score, y = np.array([g.score for g, _ in held]), np.array([q for _, q in held])
    assert auc(score, y) > 0.98
    assert np.mean((score >= 0.3) == y) > 0.95
    assert all(0 <= g.score <= 1 for g in got.values())
    # calibrated: the mean score is near the share of good documents
    assert abs(score.mean() - y.mean()) < 0.03


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (2, "", 0.1), (None, "abc", 0.0), (2, "", 0.1)], "doc_id long, text string, score double")
    none = spark.createDataFrame([(1, 1), (2, 1), (2, 0), (None, 0), (3, None), (4, 7)], "doc_id long, quality int")
    model = quality.fit(docs, none, F.lit(True))
    rows = quality.score(docs, model).collect()
    assert len(rows) == 4 and {round(r.score, 6) for r in rows} == {round(2 / 3, 6)}
    assert quality.score(docs.limit(0), model).count() == 0
    one = quality.fit(docs.limit(0), none.limit(0), F.lit(True))
    assert [r.score for r in quality.score(docs.limit(1), one).collect()] == [0.5]
