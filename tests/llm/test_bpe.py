import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from telemetrix.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(PATH)


@pytest.fixture(scope="module")
def reference(ranks):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_documents_like_the_library(spark, reference):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    got = bpe.encode_rows(docs, PATH, P.PATTERN).collect()
    assert len(got) == len(rows)
    for r in got:
        ids = reference.encode_ordinary(rows[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(rows[r.doc_id].encode()).hexdigest()


def test_odd_texts(ranks, reference):
    encoder, rnd = bpe.Encoder(ranks, P.PATTERN), random.Random(1)
    texts = ["", "a" * 3000, " " * 500 + "x", "\n\n\t a", "<|endoftext|>", "日本語テキスト", "🙂👨‍👩‍👧 é́", "\x00\x01", "it's we'll  'S",
             *("".join(rnd.choice("ab cdeé1.\n") for _ in range(rnd.randint(1, 80))) for _ in range(300)),
             *("".join(chr(rnd.choice([rnd.randint(32, 126), rnd.randint(160, 0x2fff)])) for _ in range(60)) for _ in range(100))]
    for t in texts:
        ids = encoder.encode(t)
        assert ids == reference.encode_ordinary(t)
        assert encoder.decode(ids) == t.encode()


def test_every_prefix_append_and_edit(ranks):
    v, rnd = bpe.Vocabulary(ranks), random.Random(2)
    text = b"internationalisation of the thththe ererande" * 3
    grown = bpe.Prefixes(v)
    merged = lambda t: [ranks[x] for x in v.merged(t)]
    for i in range(len(text)):
        grown.append(text[i:i + 1])
        assert grown.encoding() == merged(text[:i + 1])
    for _ in range(60):
        a = rnd.randint(0, len(grown.text))
        b = min(len(grown.text), a + rnd.randint(0, 6))
        new = bytes(rnd.choice(b"abt hern") for _ in range(rnd.randint(0, 6)))
        want = grown.text[:a] + new + grown.text[b:]
        grown.replace(a, b, new)
        assert grown.text == want and grown.encoding() == merged(want)
        assert grown.last == bpe.Prefixes(v, want).last
    long = bpe.Prefixes(v, b"the thing and " * 200)
    assert long.replace(5, 6, b"x") < 400


def test_pairs_by_their_definition(ranks):
    v, rnd = bpe.Vocabulary(ranks), random.Random(3)
    common = [r for t, r in ranks.items() if len(t) < 4 and (len(t) == 1 or r in v.parts)]
    for a, b in [*((rnd.choice(common), rnd.choice(common)) for _ in range(6000)), *((r, r) for r in common[:2000]),
                 *((x, y) for r in rnd.sample(sorted(v.parts), 2000) for x, y in [v.parts[r]])]:
        assert v.apart(a, b) == (v.merged(v.tokens[a] + v.tokens[b]) == [v.tokens[a], v.tokens[b]])


def test_small_tables_of_pieces(ranks, reference):
    rnd = random.Random(4)
    encoder = bpe.Encoder(ranks, P.PATTERN, kept_bytes=5000)
    words = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 9))) for _ in range(300)]
    for _ in range(40):
        texts = [" ".join(rnd.choice(words) for _ in range(20)) for _ in range(3)]
        got = [[i for p in t for i in p] for t in encoder.pieces(texts)]
        assert got == [reference.encode_ordinary(t) for t in texts]
        assert encoder.size < 5000 + 80 * 600 and len(encoder.old) < 200


def test_one_encoder_a_worker(spark, ranks):
    """However often ``encode`` is called, a worker process holds one encoder."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(4)
    for _ in range(4):
        assert bpe.encode_rows(docs, PATH, P.PATTERN).count() == 200

    def held(batches):
        import gc

        import pyarrow as pa
        list(batches)
        n = sum(isinstance(o, bpe.Encoder) for o in gc.get_objects())
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    assert {r.n for r in docs.select("doc_id").mapInArrow(held, "n long").collect()} <= {0, 1}


def test_edges(spark):
    rows = [(1, None, 1), (None, "", 2), (1, None, 1), (3, "a" * 20000, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids long")
    got = bpe.encode(docs, PATH, P.PATTERN).collect()
    assert sorted(len(r.ids) for r in got)[:3] == [0, 0, 0] and len(got) == 4
    assert bytes(next(r.decoded for r in got if r.ids)) == b"a" * 20000
    assert bpe.encode_rows(docs.limit(0), PATH, P.PATTERN).count() == 0
