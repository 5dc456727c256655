"""Line dedup by levelled sorted runs of line hashes.

Every line that occurs in more than one document stays only in the document of the smallest id. A line's key is the line
without white space at its ends and with A-Z lower-cased; keys of fewer than ``min_chars`` code points always stay.

Documents are taken in batches of rising id. The state is a set of runs: tables of the keys' hashes (128 bits) with the
document that holds each first, bucketed and sorted by hash. A batch aggregates its lines to one row a hash (combined
before the shuffle, so a line of a third of all documents is one row a task), merge-anti-joins the runs, which
need no shuffle, and what is left becomes its own run of level 0. Before the next batch, ``fanout`` runs of one level
that stand side by side are compacted into one run of the next level, so a level holds at most fanout runs. Runs are
disjoint: a hash stands in the run of the batch that brought it first.

A line stays if its hash and its document stand together in a run: an anti-join on (hash, document), where no frequent line
is a hot key, finds the others. Their places are gathered per document, and documents drop them by place.
Only hashes and places travel by line; texts are read twice and shuffled once, to meet their places.

Everything is DataFrame operations. Runs and places are tables in the shared folder, so a lost executor reads them again;
``LineRuns`` opened on a folder goes on with the runs that lie there: a run counts once its _SUCCESS exists, and one that
lies inside a wider run (a compaction that was cut off before its inputs were deleted) is deleted.

Edge cases: null and empty texts are one empty line. Rows without an id are one document that comes before
all others; rows of one id are one document, and all of them keep the lines that it holds first. Repeated lines within
a document stay together or go together. Texts of any length are taken whole. Columns of any names and types pass
through, and no rows give no rows.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from telemetrix.llm.common import shared_folder, unwrap, wrap

# White space, capital letters, and the least key that counts.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_CHARS = 10
HASH = ["h1", "h2"]


def line_key(line: Column) -> Column:
    """The line as it is compared; plain ASCII, the common case, takes the quicker way to lower case."""
    bare = F.btrim(line, F.lit(BLANKS))
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def hashed_lines(frame: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """id, mark (of the text), place and hash of the lines that count, from id, text and any other columns but row."""
    keep = [c for c in frame.columns if c not in ("row", "text")]
    lines = frame.select(*keep, F.xxhash64("text").alias("mark"), F.posexplode(split_lines(F.col("text"))).alias("place", "line"))
    keys = lines.select(*keep, "mark", "place", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    return keys.select(*keep, "mark", "place", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("2"), "key").alias("h2"))


def _files(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def delete(spark: SparkSession, folder: str) -> None:
    """Delete a folder of the shared storage."""
    files, path = _files(spark, folder)
    files.delete(path, True)


class LineRuns:
    """The levelled runs in ``folder``: sorted, bucketed tables of hash and first document."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int | None = None, fanout: int = 3):
        self.spark, self.folder, self.fanout = spark, folder.rstrip("/"), fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.tables: dict[tuple[int, int], str] = {}  # (first batch, last batch) -> table
        found = {}
        for first, last, buckets_, columns in self._stored():
            found[first, last] = (buckets_, columns)
        for span, (buckets_, columns) in found.items():
            if any(a <= span[0] and span[1] <= b and (a, b) != span for a, b in found):
                delete(spark, self._path(*span, buckets_))
                continue
            self.buckets = buckets_
            self.tables[span] = name = f"line_run_{uuid.uuid4().hex}"
            spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (h1, h2) SORTED BY (h1, h2) "
                      f"INTO {buckets_} BUCKETS LOCATION '{self._path(*span, buckets_)}'")

    def _path(self, first: int, last: int, buckets: int) -> str:
        return f"{self.folder}/run-{first:06d}-{last:06d}-{buckets}"

    def _stored(self) -> Iterator[tuple[int, int, int, str]]:
        files, path = _files(self.spark, self.folder)
        for status in files.listStatus(path) if files.exists(path) else []:
            m = re.fullmatch(r"run-(\d+)-(\d+)-(\d+)", status.getPath().getName())
            if not m:
                continue
            at = status.getPath().toString()
            if not files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{at}/_SUCCESS")):
                files.delete(status.getPath(), True)
                continue
            fields = self.spark.read.parquet(at).schema.fields
            yield *map(int, m.groups()), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)

    @property
    def batches(self) -> int:
        """Batches that the runs hold."""
        return max((last + 1 for _, last in self.tables), default=0)

    def _write(self, rows: DataFrame, first: int, last: int) -> None:
        name = f"line_run_{uuid.uuid4().hex}"
        (rows.select("h1", "h2", "id").write.format("parquet").bucketBy(self.buckets, *HASH).sortBy(*HASH)
         .option("path", self._path(first, last, self.buckets)).saveAsTable(name))
        self.tables[first, last] = name

    def run(self, span: tuple[int, int]) -> DataFrame:
        return self.spark.table(self.tables[span])

    def held(self) -> DataFrame | None:
        """h1, h2 and id of all runs."""
        out = None
        for span in sorted(self.tables):
            out = self.run(span) if out is None else out.unionByName(self.run(span))
        return out

    def add(self, lines: DataFrame) -> DataFrame:
        """Take a batch of (h1, h2, id); its run: the hashes that no earlier batch holds, with the smallest id of each."""
        self._compact()
        fresh = lines.groupBy(*HASH).agg(F.min("id").alias("id"))
        for span in sorted(self.tables, reverse=True):
            fresh = fresh.join(self.run(span).select(*HASH).hint("merge"), HASH, "left_anti")
        at = self.batches
        self._write(fresh, at, at)
        return self.run((at, at))

    def _compact(self) -> None:
        """Merge the last runs while ``fanout`` of one level stand side by side."""
        while len(self.tables) >= self.fanout:
            last = sorted(self.tables)[-self.fanout:]
            if len({b - a for a, b in last}) > 1:
                return
            merged = self.run(last[0])
            for span in last[1:]:
                merged = merged.unionByName(self.run(span))
            self._write(merged.repartition(self.buckets, *HASH), last[0][0], last[-1][1])
            for span in last:
                self._drop(span)

    def _drop(self, span: tuple[int, int]) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.tables.pop(span)}")
        delete(self.spark, self._path(*span, self.buckets))

    def close(self) -> None:
        """Forget the tables; the files stay for the next ``LineRuns`` on the folder."""
        for name in self.tables.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.tables = {}


def _edges(frame: DataFrame, batches: int) -> tuple[list, bool]:
    """Ids that cut the table into about equal batches, and whether there are rows without an id.

    The edges are quantiles of some hundred ids a batch, drawn by hash: they only decide which rows share a batch, and
    results do not depend on them.
    """
    total, known = frame.agg(F.count(F.lit(1)), F.count("id")).first()
    step = max(1, known // (200 * batches))
    drawn = (frame.where(F.col("id").isNotNull() & (F.pmod(F.xxhash64("id"), F.lit(step)) == 0))
             .select("id").distinct().orderBy("id").collect())
    edges = list(dict.fromkeys(drawn[len(drawn) * k // batches][0] for k in range(1, batches))) if drawn else []
    return edges, known < total


def _places(lines: DataFrame, held: DataFrame) -> DataFrame:
    """id, mark and places of the lines that go: those whose document does not hold their hash first."""
    own = held.select(F.col("h1").alias("o1"), F.col("h2").alias("o2"), F.col("id").alias("own"))
    gone = lines.join(own, (F.col("h1") == F.col("o1")) & (F.col("h2") == F.col("o2")) & F.col("id").eqNullSafe(F.col("own")),
                      "left_anti")
    return gone.groupBy("id", "mark").agg(F.collect_set("place").alias("places"))


def _without(frame: DataFrame, names: list[str], text: str, places: DataFrame) -> DataFrame:
    """The wrapped rows without the lines at their places; a row travels once, its text inside."""
    here = f"row._c{names.index(text)}"
    p = places.select(F.col("id").alias("p_id"), F.col("mark").alias("p_mark"), "places")
    met = frame.select("row", "id", F.xxhash64("text").alias("mark")).join(
        p, F.col("id").eqNullSafe(F.col("p_id")) & (F.col("mark") == F.col("p_mark")), "left")
    # the lines are bound to a name first, so that a text is split once; array_except looks places up by hash
    kept = F.transform(F.array(split_lines(F.col(here))), lambda lines: F.array_join(F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("places")), lambda i: lines[i]), "\n"))[0]
    return met.select(
        *((F.when(F.col("places").isNull(), F.col(here)).otherwise(kept) if n == text else F.col(f"row._c{i}")).alias(f"_c{i}")
          for i, n in enumerate(names)),
        F.size(split_lines(F.col(here))).cast("long"),
        F.coalesce(F.size("places"), F.lit(0)).cast("long")).toDF(*names, "n_lines", "n_dropped")


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, batches: int = 4,
          buckets: int | None = None, fanout: int = 3) -> DataFrame:
    """The rows of ``docs`` without lines that a document of a smaller id holds; adds n_lines (before) and n_dropped."""
    spark, names = docs.sparkSession, docs.columns
    frame = wrap(docs, id=doc_id, text=text)
    folder = f"{shared_folder(spark)}/lines-{uuid.uuid4().hex}"
    edges, unnamed = _edges(frame, batches)
    batch = sum(((F.col("id") >= F.lit(e)).cast("int") for e in edges), F.lit(1))
    lines = hashed_lines(frame.withColumn("batch", F.when(F.col("id").isNull(), 0).otherwise(batch)), min_chars)
    lines.write.partitionBy("batch").parquet(f"{folder}/lines")
    stored = spark.read.schema(lines.schema).parquet(f"{folder}/lines")
    runs = LineRuns(spark, f"{folder}/runs", buckets, fanout)
    for k in range(0 if unnamed else 1, len(edges) + 2):
        runs.add(stored.where(F.col("batch") == k))
    _places(stored, runs.held()).write.parquet(f"{folder}/places")
    runs.close()
    delete(spark, f"{folder}/lines")
    delete(spark, f"{folder}/runs")
    return _without(frame, names, text, spark.read.parquet(f"{folder}/places"))


def dedup_batch(docs: DataFrame, runs: LineRuns, doc_id: str = "doc_id", text: str = "text",
                min_chars: int = MIN_CHARS) -> DataFrame:
    """One more batch against the runs of all earlier ones, which it joins: its rows without lines that they, or a smaller
    id of the batch, hold. Its ids must not stand in earlier batches."""
    spark, names = docs.sparkSession, docs.columns
    frame = wrap(docs, id=doc_id, text=text)
    lines = hashed_lines(frame, min_chars)
    folder = f"{shared_folder(spark)}/lines-{uuid.uuid4().hex}"
    lines.write.parquet(f"{folder}/lines")
    stored = spark.read.schema(lines.schema).parquet(f"{folder}/lines")
    added = runs.add(stored)
    _places(stored, added).write.parquet(f"{folder}/places")
    delete(spark, f"{folder}/lines")
    return _without(frame, names, text, spark.read.parquet(f"{folder}/places"))
