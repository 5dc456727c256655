import hashlib
import random

import pytest

from telemetrix.llm import suffix_dedup

L = suffix_dedup.LENGTH


def brute(rows):
    """(id, n_bytes, n_removed, n_spans, sha256) of rows in their order, by a table of all strings."""
    seen, out = set(), []
    for i, text in sorted(rows, key=lambda r: (r[0], (r[1] or "").encode())):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - L + 1):
            w = data[s:s + L]
            if w in seen:
                gone[s:s + L] = b"\1" * L
            seen.add(w)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and (not k or not gone[k - 1]))
        out.append((i, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def got(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(tuple(r) for r in suffix_dedup.digests(docs, **options).collect())


def test_documents_like_brute_force(spark, sf_small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()]
    want = brute(rows)
    assert any(r[2] for r in want)
    assert got(spark, rows) == want
    assert got(spark, rows, block_bytes=20_000) == want


@pytest.mark.parametrize("hot", [2, 10, 100_000])
def test_shared_passages_and_hot_grams(spark, hot):
    rnd = random.Random(hot)
    words = ["".join(rnd.choice("abcdeéß") for _ in range(rnd.randint(1, 9))) for _ in range(200)]
    passage = " ".join(rnd.choice(words) for _ in range(60))
    rows = []
    for i in range(60):
        parts = [" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 60)))]
        if i % 3:
            a = rnd.randint(0, 60)
            parts.append(passage[a:a + rnd.randint(80, 400)])
        parts.append(" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 30))))
        rows.append((rnd.randint(0, 10**6), "".join(parts)))
    rows += [(10**7 + i, t) for i, (_, t) in enumerate(rows[:10])]
    assert got(spark, rows, hot=hot, block_bytes=4000) == brute(rows)


def test_edges(spark):
    rows = [(3, None), (4, ""), (5, "x" * 99), (6, "x" * 100), (7, "x" * 5000), (8, "ab" * 300), (8, "ab" * 300), (8, "ab" * 299),
            (-9, "é" * 75 + "\x00" * 300), (10, "é" * 75), (11, "\x00" * 150)]
    for block_bytes in (1 << 20, 500):
        assert got(spark, rows, block_bytes=block_bytes) == brute(rows)
    assert got(spark, []) == []


def test_remove_repeats_keeps_rows(spark):
    rnd = random.Random(1)
    tail = "".join(rnd.choice("abcdefgh ") for _ in range(220))
    rows = [(None, tail, "a", 1), (1, tail, "b", 2), (2, "é" + tail[:150], "c", 3), (3, None, "d", 4), (None, tail, "e", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string, Text long")
    out = suffix_dedup.remove_repeats(docs)
    assert out.columns == docs.columns
    left = sorted((r[2] if r[0] is not None else "-", r[1]) for r in out.collect())
    assert left == [("-", ""), ("-", tail), ("b", ""), ("c", "é"), ("d", None)]
