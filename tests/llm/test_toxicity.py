import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from telemetrix.llm import toxicity
from telemetrix.llm.queries import op8_toxicity

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def model(spark):
    return toxicity.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"), F.lit(True))


def test_held_out_accuracy(spark):
    got = {r.doc_id: r for r in op8_toxicity(spark, SF).collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    held = [(got[r.doc_id], r.toxic) for r in labels if got[r.doc_id].held_out]
    assert all(g.held_out == (zlib.crc32(str(g.doc_id).encode()) % 3 == 1) and g.predicted == (g.score >= 0.7) for g in got.values())
    found, y = np.array([g.predicted for g, _ in held]), np.array([t for _, t in held])
    assert (found & y).sum() / y.sum() > 0.8  # about 6 % of the toxic labels are on texts without any toxic word
    assert (found & y).sum() / found.sum() > 0.95


@pytest.mark.parametrize("hidden, word", [
    ("1d10t", "idiot"), ("$tup1d", "stupid"), ("i d i o t", "idiot"), ("s.c.u.m", "scum"), ("idiooooot", "idiot"),
    ("m0r0n!!", "moron"), ("p4thetic", "pathetic"), ("L O S E R", "loser"), ("trash.", "trash"), ("cl-o-wn", "clown")])
def test_deobfuscation(model, hidden, word):
    evidence = toxicity.Evidence(model)
    assert word in evidence.restored(f"The on {hidden} thing")
    assert model.probability(np.array([evidence.raw(f"The on {hidden} thing of")]))[0] >= 0.7


def test_plain_text_is_its_only_path(model):
    letters = toxicity.Letters(model.letters)
    for word in ("thing", "esrrado", "balloon", "été"):
        assert toxicity.decode(word, letters) in ([word], [word.replace("rr", "r")], ["baloon"])
    assert toxicity.Evidence(model).restored("Thing the,\n(heat) 'of'") == {"thing", "the", "heat", "of"}


def test_edges(spark, model):
    rows = [(1, None, 1), (2, "", 2), (2, "", 2), (None, "idiot " * 50000, 3), (4, "x" * 100000 + "1" * 5000, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score long")
    got = toxicity.score(docs, model).collect()
    assert len(got) == 5 and [r.predicted for r in got if r.doc_id is None] == [1]
    assert len({r.score for r in got if r.doc_id in (1, 2)}) == 1
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 2, 4]
    assert toxicity.score(docs.limit(0), model).count() == 0
    none = toxicity.fit(docs, spark.createDataFrame([(1, 0), (9, 0)], "doc_id long, toxic int"), F.lit(True))
    assert {r.score for r in toxicity.score(docs, none).collect()} == {0.25}


@pytest.fixture(scope="module")
def small():
    words = Counter({"the": 40, "thing": 40, "and": 40, "on": 40, "idiot": 20, "stupid": 20, "bigot": 20, "ass": 20})
    return toxicity.Model(toxicity.letter_counts(words), {w: 1.0 for w in ("idiot", "stupid", "bigot", "ass")})


@pytest.mark.parametrize("before", range(24, 36))
def test_word_across_position_64(small, before):
    letters = toxicity.Letters(small.letters)
    hidden = ("thing" * 8)[-before:] + "idiot" + "thing" * 20
    for joined in (" ".join(hidden), ".".join(hidden)):
        assert "idiot" in toxicity.Evidence(small).restored(f"The {joined} on")
        assert "".join(toxicity.decode(joined, letters)) == hidden
    assert toxicity.Evidence(small).restored("The idi" + "o" * (before + 40) + "t") == {"the", "idiot"}


@pytest.mark.parametrize("hidden, word", [
    ("iddiot", "idiot"), ("idiiot", "idiot"), ("stuupid", "stupid"), ("(Stuppid)", "stupid"), ("81607", "bigot"), ("455", "ass"),
    ("8 1 6 0 7", "bigot"), ("i  d  i  o  t", "idiot"), ("i\nd\ni\no\nt", "idiot"), ("i\t d \r\ni   o t", "idiot"), ("i d i o t\nx y z", "idiot")])
def test_doubles_lookalikes_only_and_any_white_space(small, hidden, word):
    assert word in toxicity.Evidence(small).restored(f"The on {hidden} thing")


def test_doubled_letters_of_plain_words_stay(small):
    small = toxicity.Model(small.letters, {**small.lexicon, "asses": 1.0})
    assert toxicity.Evidence(small).restored("Asses thiing onn ass 12 455") >= {"asses", "thiing", "onn", "ass"}


def test_learns_from_all_labelled_documents(spark, monkeypatch):
    """A word of few toxic documents among many counts, wherever they lie; tasks may send their counts in parts."""
    n = 24_000
    rare = (F.col("doc_id") % 2400 == 1)
    docs = spark.range(n).toDF("doc_id").withColumn("text", F.concat(F.lit("the thing "), F.when(
        rare, "zonkish").when(F.col("doc_id") % 2 == 1, "idiot").otherwise("garden")))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    learnt = docs.where(F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("split")), F.lit(4)) > 0)
    seen = {r.text.split()[-1]: r["count"] for r in learnt.groupBy("text").count().collect()}
    model = toxicity.fit(docs, labels, F.lit(True))
    for word, times in seen.items():
        expected = 0.0 if word == "garden" else -np.log(1 - toxicity.lower_bound(times, 0))
        assert toxicity.Evidence(model).word(word) == pytest.approx(expected)
    assert model.letters["\0"] == sum(seen.values()) * len("the^thing^") + sum((len(w) + 1) * k for w, k in seen.items())
    monkeypatch.setattr(toxicity, "HELD", 20)
    again = toxicity.fit(docs, labels, F.lit(True))
    assert (again.letters, again.lexicon) == (model.letters, model.lexicon)
