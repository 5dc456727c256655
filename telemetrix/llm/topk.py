"""Exact top-k inner products by term-at-a-time accumulation.

Vectors become sparse rows of integer weights (component x -> floor(256 * x)). A block of vectors is
held as an inverted index: for each dimension the places and weights of the non-zero components. A
query row walks its non-zero dimensions and scatters weight x posting into a dense array of scores, one
slot a vector; partition selection keeps the best k of the block (ties to the smaller id), and
the blocks' lists are merged by rank.

Scale: vectors and queries are dealt into blocks of bounded size; each vector block meets each query
block once, keyed by the numbers of both, so a task holds one of each at a time. Vectors are sent once to each query
block and queries once to each vector block; so blocks grow with the tables, up to ``COMPONENTS`` weights. Only k
rows a query and block are shuffled to the merge. No side is broadcast or collected.

Edge cases: vectors that are null or hold a null, NaN or infinite component, and rows with a null id, take
no part. Vectors of different lengths meet on their common dimensions. Empty vectors score 0. Rows that
repeat an id are candidates each; a query never meets rows of its own id; queries that repeat an id
with the same vector count once, with different vectors each gets its own ranks. Weights of any size are exact: where
sums could leave a long they are made of Python's integers, and a score among the k best that does not fit a long raises,
as does a component above 7e305, of which 256 times is no double. No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from telemetrix.llm.common import pick

VECTORS = 4096
QUERIES = 512
COMPONENTS = 1 << 22  # weights of a block: 32 MB
TASKS = 64  # blocks of vectors beyond which they grow
EXACT = 2.0 ** 53  # doubles from here on are integers
LONG = 2.0 ** 62


def weights(df: DataFrame, id_col: str, vector: str, scale: int) -> DataFrame:
    """id and integer weights (as doubles, which hold each exactly) of the rows that take part."""
    real = F.transform("v", lambda a: a.cast("double"))
    return (pick(df, id=id_col, v=vector)
            .where("id is not null and v is not null")
            .select(F.col("id").cast("long").alias("id"), real.alias("v"))
            .where(~F.exists("v", lambda a: a.isNull() | F.isnan(a) | (F.abs(a) == float("inf"))))
            .select("id", F.transform("v", lambda a: F.when(
                F.abs(a * scale) < EXACT, F.floor(a * scale).cast("double")).otherwise(a * scale)).alias("w")))


def sized(df: DataFrame, given: int | None, least: int, blocks: int) -> int:
    """Number of blocks of a side: of ``given`` rows, or of ``least`` and more, up to ``COMPONENTS`` weights."""
    n, weighed = df.agg(F.count("*"), F.sum(F.size("w"))).first()
    rows = given or max(1, min(max(least, -(-n // blocks)), COMPONENTS * n // max(1, weighed or 0)))
    return max(1, -(-n // rows))


def top_k(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector: str = "embedding",
          k: int = 5, scale: int = 256, vector_block: int | None = None, query_block: int | None = None) -> DataFrame:
    """query_id, rank, vec_id and score of the k best vectors for each row of ``queries``."""
    base, asked = weights(vectors, id_col, vector, scale), weights(queries, id_col, vector, scale).distinct()
    blocks, parts = sized(base, vector_block, VECTORS, TASKS), sized(asked, query_block, QUERIES, 1)

    def each(n: int):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

    # each vector block meets each query block: every row goes once to each block of the other side
    base = base.withColumn("block", F.pmod(F.xxhash64("id", "w"), F.lit(blocks))).withColumn("part", each(parts))
    asked = asked.withColumn("part", F.pmod(F.xxhash64("id", "w"), F.lit(parts))).withColumn("block", each(blocks))
    found = (base.groupBy("block", "part").cogroup(asked.groupBy("block", "part"))
             .applyInArrow(_scorer(k, query_block or QUERIES), "query_id long, query string, vec_id long, score long"))
    best = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def sparse(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, dimension and weight of the non-zero components of a column of lists."""
    lists = column.combine_chunks()
    sizes = np.asarray(pa.compute.list_value_length(lists)).astype(np.int64)
    values = np.asarray(lists.flatten())
    row = np.repeat(np.arange(len(sizes)), sizes)
    dim = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = values != 0
    return row[at], dim[at], values[at]


def postings(column: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The inverted index: places and weights by dimension."""
    row, dim, value = sparse(column)
    order = np.argsort(dim, kind="stable")
    row, dim, value = row[order], dim[order], value[order]
    cuts = np.flatnonzero(np.diff(dim)) + 1
    return {int(d[0]): (r, v) for d, r, v in zip(np.split(dim, cuts), np.split(row, cuts), np.split(value, cuts)) if len(d)}


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id, by partition selection."""
    if len(scores) > k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= kth)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def integers(values: np.ndarray, exact: bool) -> np.ndarray:
    """Weights as longs, or as Python's integers."""
    return np.array([int(v) for v in values.tolist()], object) if exact else values.astype(np.int64)


def _scorer(k: int, query_block: int):
    def run(base: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        if base.num_rows and asked.num_rows:
            ids, index = np.asarray(base.column("id")), postings(base.column("w"))
            largest = max((float(np.abs(v).max()) for _, v in index.values()), default=0.0)
            longs = {d: (r, integers(v, False)) for d, (r, v) in index.items()} if largest < LONG else {}
            for first in range(0, asked.num_rows, query_block):
                some = asked.slice(first, query_block)
                own, digests = some.column("id").to_pylist(), [repr(w) for w in some.column("w").to_pylist()]
                row, dim, value = sparse(some.column("w"))
                cuts = np.searchsorted(row, np.arange(len(own) + 1))
                for q, query in enumerate(own):
                    own_value = value[cuts[q]:cuts[q + 1]]
                    exact = not max(largest, 1.0) * float(np.abs(own_value).sum()) < LONG or not largest < LONG
                    scores = np.zeros(len(ids), object if exact else np.int64)
                    for d, w in zip(dim[cuts[q]:cuts[q + 1]].tolist(), integers(own_value, exact).tolist()):
                        if d in index:
                            places, posting = index[d] if exact else longs[d]
                            scores[places] += w * (integers(posting, True) if exact else posting)
                    mine = ids != query
                    if exact:
                        ranked = sorted(zip((-scores[mine]).tolist(), ids[mine].tolist(), range(int(mine.sum()))))
                        at = np.array([i for _, _, i in ranked[:k]], np.int64)
                    else:
                        at = best(scores[mine], ids[mine], k)
                    out[0] += [query] * len(at)
                    out[1] += [digests[q]] * len(at)
                    out[2] += ids[mine][at].tolist()
                    out[3] += scores[mine][at].tolist()
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()),
                         pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64())],
                        ["query_id", "query", "vec_id", "score"])

    return run
