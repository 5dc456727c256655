import random
import re

import pytest

from telemetrix.llm.decontamination import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window=10):
    grams = {}
    for i, t in items:
        w = words(t)
        m = min(window, len(w))
        for a in range(len(w) - m + 1) if i is not None and w else ():
            grams.setdefault(tuple(w[a:a + m]), set()).add(str(i))
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for m in {len(g) for g in grams}:
            for a in range(len(w) - m + 1):
                if tuple(w[a:a + m]) in grams:
                    hit |= set(range(a, a + m))
                    found |= grams[tuple(w[a:a + m])]
        out.append((i, len(w), len(hit), tuple(sorted(found)), bool(hit)))
    return sorted(out, key=repr)


def check(spark, docs, items, **options):
    d = spark.createDataFrame([(*r, "z") for r in docs], "doc_id long, text string, hit string")
    b = spark.createDataFrame([(*r, "z") for r in items], "item_id long, text string, Text string")
    got = [(r.doc_id, r.n_words, r.n_hit, tuple(sorted(r["items"])), r.contaminated) for r in decontaminate(d, b, **options).collect()]
    assert sorted(got, key=repr) == brute(docs, items)


@pytest.mark.parametrize("block_bytes", [1 << 20, 600])
def test_spans_of_all_lengths(spark, block_bytes):
    rnd = random.Random(5)
    vocabulary = ["".join(rnd.choice("abcé1") for _ in range(rnd.randint(1, 3))) for _ in range(25)]
    text = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    items = [(k, text(rnd.choice([1, 2, 3, 5, 7, 9, 10, 11, 30]))) for k in range(30)]
    items += [(99, items[3][1]), (3, items[5][1])]
    docs = []
    for k in range(60):
        w = words(rnd.choice(items)[1])
        a = rnd.randint(0, len(w) - 1)
        docs.append((k, text(rnd.randint(0, 40)) + " , " + " - ".join(w[a:a + rnd.randint(1, 30)]).upper() + " " + text(rnd.randint(0, 40))))
    check(spark, docs, items, block_bytes=block_bytes)


def test_edges(spark):
    long = "one two three four five six seven eight nine ten eleven"
    items = [(1, long), (2, None), (3, ""), (4, "..."), (None, "alpha"), (5, "x"), (5, "beta gamma")]
    docs = [(1, None), (2, ""), (3, "?!"), (4, long), (4, long), (None, "X"), (6, "alpha beta\ngamma"),
            (7, "a " * 30000 + long + " a" * 1000), (8, (long + " ") * 50)]
    check(spark, docs, items)
    check(spark, docs, [])
    check(spark, [], items)
