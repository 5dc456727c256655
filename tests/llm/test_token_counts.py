import random

import public_tokenizers as P
import pytest
import tokenizers
from tokenizers import models, normalizers

from telemetrix.llm import token_counts as tc


def library(pieces, byte_fallback):
    vocabulary = [("<unk>", 0.0), *((f"<0x{b:02X}>", 0.0) for b in range(256) if byte_fallback), *pieces]
    t = tokenizers.Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=byte_fallback))
    t.normalizer = normalizers.Sequence([normalizers.Prepend(tc.SPACE), normalizers.Replace(" ", tc.SPACE)])
    return lambda text: len(t.encode(text, add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def pieces():
    return tc.read_pieces(P.path("piece_bpe_32k.model"))


def test_documents_like_the_library(spark, sf_small, pieces):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    want, texts = library(pieces, True), {r.doc_id: r.text for r in docs.collect()}
    got = tc.count_tokens(docs, pieces).collect()
    assert {r.doc_id: r.n_tokens for r in got} == {i: want(t) for i, t in texts.items()}


@pytest.mark.parametrize("byte_fallback", [True, False])
def test_ties_and_unknown_signs(byte_fallback):
    rnd = random.Random(4)
    for crossing in (False, True):
        signs = ["a", "b", "c", tc.SPACE]
        pieces = {s: -float(rnd.randint(1, 3)) for s in ("a", "b", tc.SPACE)}
        while len(pieces) < 25:
            p = "".join(rnd.choice(signs) for _ in range(rnd.randint(2, 4)))
            if crossing or tc.SPACE not in p[1:]:
                pieces[p] = -float(rnd.randint(1, 6))
        pieces = sorted(pieces.items())
        counter, want = tc.Counter(pieces, byte_fallback), library(pieces, byte_fallback)
        for _ in range(400):
            text = "".join(rnd.choice("aabbc d  é") for _ in range(rnd.randint(0, 25)))
            assert counter.text(text)[0] == want(text), text


def test_edges(spark, pieces):
    rows = [(1, None), (None, ""), (2, " "), (2, " "), (3, "x" * 30000), (4, "\n\n日本 é")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n_tokens", "text as TEXT2")
    got = tc.count_tokens(docs, pieces).collect()
    want = library(pieces, True)
    assert sorted(r.n_tokens for r in got) == sorted(want(t) if t else 0 for _, t in rows)
    assert tc.count_tokens(docs.limit(0), pieces).count() == 0
