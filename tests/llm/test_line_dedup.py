import random
import uuid

from pyspark.sql import functions as F

from telemetrix.llm import line_dedup
from telemetrix.llm.common import shared_folder
from telemetrix.session import executed_plan

BLANKS = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=10):
    """(id, text without lines held by a smaller id, lines, dropped); ids of None come first."""
    rank = lambda i: (i is not None, i or 0)
    first = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            key = line.strip(BLANKS).translate(LOWER)
            if len(key) >= least and (key not in first or rank(i) < rank(first[key])):
                first[key] = i
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        keep = [x for x in lines if first.get(x.strip(BLANKS).translate(LOWER), i) == i]
        out.append((i, text if len(keep) == len(lines) else "\n".join(keep), len(lines), len(lines) - len(keep)))
    return sorted(out, key=repr)


def got(frame):
    return sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in frame.collect()), key=repr)


def some_rows(rnd, ids):
    shared = ["".join(rnd.choice("aBcDé ß\t") for _ in range(rnd.randint(5, 25))) for _ in range(40)]
    for i in ids:
        lines = [rnd.choice(shared) if rnd.random() < 0.6 else f"own line {rnd.random()}" for _ in range(rnd.randint(0, 12))]
        lines = [x.upper() if rnd.random() < 0.2 else "  " + x + "\r" if rnd.random() < 0.2 else x for x in lines]
        yield i, "\n".join(lines)


def test_like_brute_force_with_any_batches(spark):
    rnd = random.Random(3)
    rows = list(some_rows(rnd, rnd.sample(range(-500, 500), 150)))
    rows += [(None, rows[0][1]), (None, "short\n" + rows[1][1]), (rows[5][0], rows[6][1]), (rows[5][0], rows[5][1]), (7000, None),
             (7001, ""), (7002, "\n\n"), (7003, "a line that repeats\n" * 3000), (7004, "A Line That Repeats"),
             (7005, "ÉÉÉÉÉÉÉÉÉÉ"), (7006, "éééééééééé"), (7007, "123456789"), (7008, " 123456789\x0b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert sum(r[3] for r in want) > 100
    for batches, fanout in ((1, 4), (5, 2), (9, 3)):
        assert got(line_dedup.dedup(docs, batches=batches, fanout=fanout)) == want
    assert got(line_dedup.dedup(docs, min_chars=1, batches=3)) == brute(rows, 1)


def test_runs_take_batches_compact_and_reopen(spark):
    rnd = random.Random(4)
    folder = f"{shared_folder(spark)}/runs-{uuid.uuid4().hex}"
    rows, found = [], []
    runs = line_dedup.LineRuns(spark, folder, buckets=3, fanout=2)
    for k in range(7):
        batch = list(some_rows(rnd, range(100 * k, 100 * k + 20)))
        rows += batch
        docs = spark.createDataFrame(batch, "doc_id long, text string")
        if k == 4:  # another session goes on with the files; what a broken compaction or write left behind goes
            runs.close()
            runs._write(spark.createDataFrame([(1, 2, 3)], "h1 long, h2 long, id long"), 0, 0)
            runs.close()
            line_dedup._files(spark, folder)[0].mkdirs(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/run-000004-000004-3"))
            runs = line_dedup.LineRuns(spark, folder, fanout=2)
            assert runs.batches == 4 and (0, 1) in runs.tables and (0, 0) not in runs.tables and runs.buckets == 3
        found += got(line_dedup.dedup_batch(docs, runs))
        spans = sorted(runs.tables)
        assert [a for a, _ in spans] == [0, *(b + 1 for _, b in spans[:-1])] and len(spans) <= 4
    assert sorted(found, key=repr) == brute(rows)
    held = runs.held()
    assert held.count() == held.select("h1", "h2").distinct().count()


def test_runs_meet_a_batch_without_shuffle(spark):
    runs = line_dedup.LineRuns(spark, f"{shared_folder(spark)}/runs-{uuid.uuid4().hex}")
    rows = spark.range(1000).select(F.col("id").alias("h1"), (F.col("id") * 7).alias("h2"), "id")
    runs.add(rows)
    fresh = rows.groupBy("h1", "h2").agg(F.min("id").alias("id")).join(
        runs.run((0, 0)).select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
    plan = executed_plan(fresh)
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1


def test_clashing_names_other_ids_and_no_rows(spark):
    rows = [("b", "the same line here", 1, 2, 3, [4]), ("a", "The same line here \nx", 1, 2, 3, None), (None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, row long, Text long, h1 long, batch array<long>")
    out = line_dedup.dedup(docs)
    assert out.columns == [*docs.columns, "n_lines", "n_dropped"]
    assert sorted((tuple(r) for r in out.collect()), key=repr) == sorted(
        [("b", "", 1, 2, 3, [4], 1, 1), (*rows[1], 2, 0), (*rows[2], 1, 0)], key=repr)
    assert line_dedup.dedup(docs.limit(0)).count() == 0
