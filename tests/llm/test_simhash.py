import random
import re

import xxhash

from telemetrix.llm.simhash import DISTANCE, keep_first, links, meeting_sets, near_duplicates


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """id -> smallest id reachable, from (id, fingerprint) rows; all pairs."""
    parent = {i: i for i, _ in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in prints:
        for j, b in prints:
            if bin(a ^ b).count("1") <= DISTANCE:
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return {i: root(i) for i in parent}


def check(spark, rows, schema="doc_id long, text string"):
    got = near_duplicates(spark.createDataFrame(rows, schema)).collect()
    prints = [(r[0], brute_fingerprint(r[1])) for r in rows]
    want = brute_components([p for p in prints if p[0] is not None])
    assert sorted((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in got if r.doc_id is not None) == sorted(
        (i, f, want[i]) for i, f in prints if i is not None)
    return got


def test_any_four_positions_hold_a_meeting_set():
    from itertools import combinations
    for n in (3, 4):
        sets = meeting_sets(n)
        assert all(any(set(s) <= set(c) for s in sets) for c in combinations(range(8), 4))
    assert len(meeting_sets(3)) == 20


def test_documents_like_brute_force(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    check(spark, [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_edges(spark):
    rows = [(5, None), (9, ""), (3, " \t\n"), (4, "One"), (7, "one"), (8, "x " * 30000), (2, "a b c d e"), (2, "a b c d e"),
            (6, "ÄÖ ß A"), (11, "ÄÖ ß a"), (2, "one")]
    check(spark, rows)
    got = near_duplicates(spark.createDataFrame([(None, "a b"), (None, "a b"), (1, "a b")], "doc_id long, text string"))
    assert sorted((r.doc_id or -1, r.component_id) for r in got.collect()) == [(-1, None), (-1, None), (1, 1)]
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_links_of_dense_and_sparse_lists(spark):
    rnd = random.Random(3)
    centre = rnd.getrandbits(64)
    prints = [centre] + [centre ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(1, 5))) for _ in range(300)]
    prints = sorted({*prints, *(rnd.getrandbits(64) for _ in range(300))})
    rows = [(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(prints)]
    from telemetrix.llm.components import components
    for positions in (3, 4):
        got = links(spark.createDataFrame(rows, "id long, fp long"), positions=positions)
        assert all(bin(prints[r.a] ^ prints[r.b]).count("1") <= DISTANCE for r in got.collect())
        labels = {r.node: r.component for r in components(got).collect()}
        want = brute_components(list(enumerate(prints)))
        assert {i: labels.get(i, i) for i in want} == want


def test_keep_first_keeps_whole_rows_of_clashing_names(spark):
    rows = [(3, "a b c d e", "x", 1), (1, "A b c d e", "y", 2), (None, "a b c d e", "z", 3), (1, None, "w", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string, Text long")
    got = keep_first(docs)
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect()), key=lambda r: (r[0] is None, r[0])) == [(1, "A b c d e", "y", 2), (None, "a b c d e", "z", 3)]
