import hashlib
import random
import zlib

import numpy as np
import pytest

from telemetrix.llm import periodic_runs as pr
from telemetrix.llm.queries import op12_periodic_runs


def brute(words, least=12):
    """(start, length, period) of all runs, each period on its own; a run of a multiple of its period is left out."""
    found = {}
    n = len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            k = i
            while k + q < n and words[k] == words[k + q]:
                k += 1
            if k > i and k + q - i >= max(least, 2 * q):
                found.setdefault((i, k + q), q)
            i = max(k, i) + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def codes(words):
    seen = {}
    return np.array([seen.setdefault(w, len(seen)) for w in words] + [len(seen)])


@pytest.mark.parametrize("letters,least", [(1, 2), (2, 2), (2, 12), (3, 2), (4, 12)])
def test_runs_like_brute_force(letters, least):
    rnd = random.Random(letters)
    for _ in range(150):
        words = [rnd.randrange(letters) for _ in range(rnd.randint(0, 60))]
        for _ in range(rnd.randint(0, 3)):
            a, q = rnd.randint(0, len(words)), rnd.randint(1, 9)
            words[a:a] = (words[a:a + q] or [0]) * rnd.randint(2, 6)
        assert [tuple(r) for r in pr.find_runs(codes(words), least).tolist()] == brute(words, least)
    fib = ["a", "b"]
    while len(fib[-1]) < 600:
        fib.append(fib[-1] + fib[-2])
    assert [tuple(r) for r in pr.find_runs(codes(fib[-1]), least).tolist()] == brute(fib[-1], least)


def test_pieces_of_questions_and_large_arrays(monkeypatch):
    monkeypatch.setattr(pr, "ASKED", 7)
    words = "abcabcabcabcabcab" * 3 + "aaaaaaaaaaaaaaaaaaaa"
    assert [tuple(r) for r in pr.find_runs(codes(words)).tolist()] == brute(words)
    monkeypatch.undo()
    found = pr.find_runs(np.append(np.tile(np.arange(7), 400_000), 7))  # pairs of ranks beyond 64 bits with the place
    assert found.tolist() == [[0, 2_800_000, 7]]


def expected(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    gone = set()
    for s, size, q in runs:
        gone |= set(range(s + q, s + size))
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            sha("".join("%d,%d,%d\n" % r for r in runs).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_query_like_brute_force(spark, sf_small):
    rows = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text").collect()
    want = sorted(expected(*r) for r in rows if len(r.text) < 8000)
    got = op12_periodic_runs(spark, sf_small)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    short = {w[0] for w in want}
    assert sorted((tuple(r) for r in got.collect() if r.doc_id in short), key=lambda r: r[0]) == want
    assert sum(w[1] > 0 for w in want) > 10 and len(want) > 0.9 * len(rows)


def test_edges(spark):
    rows = [(1, None, 5), (2, "", 6), (3, " \t\n", 7), (4, "a " * 11, 8), (5, "a\x0b" * 12, 9), (5, "a\x0b" * 12, 9),
            (6, "\x85é  é " * 8, 1), (7, "x y z w v u " * 2, 2), (8, "x y z w v u " * 2 + "x", 3), (None, "w " * 40_000 + "end", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs long")
    out = pr.periodic_runs(docs).collect()
    found = [(r.row._c0, r.row._c2, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in out]
    assert sorted(found, key=repr) == sorted([
        (1, 5, 0, [], ""), (2, 6, 0, [], ""), (3, 7, 0, [], ""), (4, 8, 11, [], " ".join("a" * 11)), (5, 9, 12, [(0, 12, 1)], "a"),
        (5, 9, 12, [(0, 12, 1)], "a"), (6, 1, 16, [(0, 16, 2)], "\x85é  é"), (7, 2, 12, [(0, 12, 6)], "x y z w v u"),
        (8, 3, 13, [(0, 13, 6)], "x y z w v u"), (None, 4, 40_001, [(0, 40_000, 1)], "w end")], key=repr)
    assert pr.periodic_runs(docs.limit(0)).count() == 0
