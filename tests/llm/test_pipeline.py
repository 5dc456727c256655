import importlib
import sys

import public_tokenizers as P
import tiktoken

import corpus_pipeline
from telemetrix.llm import bpe
from telemetrix.llm.queries import op4_decontaminate
from tests.llm.test_simhash import brute_components, brute_fingerprint
from tests.llm.test_suffix_dedup import L


def test_stages_like_brute_force(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    inputs, out = [], docs
    for name, stage in corpus_pipeline.STAGES:
        inputs.append({r.doc_id: r for r in out.collect()})
        out = spark.createDataFrame(stage(spark, out, sf_small).toPandas(), out.schema) if name != corpus_pipeline.STAGES[-1][0] else stage(spark, out, sf_small)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
    last = {r.doc_id: r for r in out.collect()}

    def same(a, b):
        return a == b

    first, unique, cut, clean, kept = inputs
    assert set(unique) <= set(first) and len(unique) > 0.8 * len(first)
    groups = brute_components([(i, brute_fingerprint(r.text)) for i, r in unique.items()])
    assert set(cut) == set(groups.values()) and all(same(cut[i], unique[i]) for i in cut)
    seen = set()
    assert set(clean) == set(cut)
    for i in sorted(cut):
        data = cut[i].text.encode()
        gone = bytearray(len(data))
        for s in range(len(data) - L + 1):
            if data[s:s + L] in seen:
                gone[s:s + L] = b"\1" * L
            seen.add(data[s:s + L])
        left = bytes(b for b, g in zip(data, gone) if not g).decode("utf-8", "ignore")
        assert (clean[i].text, clean[i].n_chars, clean[i].lang) == (left, len(left), cut[i].lang)
    spark.createDataFrame(list(clean.values()), docs.schema).createOrReplaceTempView("left")
    from telemetrix.llm.decontamination import decontaminate
    found = decontaminate(spark.table("left"), spark.read.parquet(f"{sf_small}/benchmark.parquet"))
    assert set(kept) == {r.doc_id for r in found.collect() if not r.contaminated}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    assert {i: list(r.ids) for i, r in last.items()} == {i: library.encode_ordinary(r.text) for i, r in kept.items()}
    assert op4_decontaminate is not None
    whole = {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, sf_small).collect()}
    assert whole == {i: r.ids_sha256 for i, r in last.items()}


def test_stages_on_odd_rows(spark, sf_small):
    rows = [(None, None, None, None, None, 1), (1, "", "en", "s", 0, 2), (1, "", "en", "s", 0, 2), (2, None, None, "s", None, 3),
            (3, "word " * 40000, "en", None, 200000, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row long")
    for frame in (docs, docs.limit(0)):
        out = frame
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, out, sf_small)
        assert sorted((r.doc_id or 0 for r in out.collect())) == ([0, 1, 3] if frame is docs else [])


def test_entry_without_the_subpackage(monkeypatch):
    for name in [m for m in sys.modules if m.startswith(("telemetrix.llm", "corpus_pipeline", "__spark_entry__"))]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "telemetrix.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    entry = importlib.import_module("__spark_entry__")
    assert "pipeline" not in entry.queries() and "d_anomaly_score" in entry.queries()
    monkeypatch.delitem(sys.modules, "__spark_entry__")
