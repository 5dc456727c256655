"""Byte-level BPE by prefix dynamic programming.

For each prefix of a piece of text, BPE has one encoding, and so one last token. It is the only
token t that ends there, starts where some shorter prefix ends, and stays apart from that prefix's last
token u: the pair (u, t) is valid when encoding the bytes of u and t together gives [u, t]. The array
of last tokens thus grows by one entry a byte (exact appends), may be cut at any byte (truncation) and, after an
edit, is filled again only until it runs in step with the old one (re-encoding near edits).

A text is cut into pieces by the tokenizer's pattern. A piece that is itself a token is that token, as the tiktoken
library does; others go through the prefix table, where an automaton over the reachable tokens gives those that end at a
byte. New pieces are encoded in sorted order, so that neighbours share their prefixes' entries, and kept in two generations
of at most ``KEPT_BYTES`` each: what is met again moves to the younger one, and when that is full the older one goes.

Scale: one pass over the documents without a shuffle; the rank file is read by the driver and sent once to each
executor (its size is that of a vocabulary). A worker process holds one encoder, whatever the number of calls. Whole texts are
encoded; memory is bounded by the parts of about ``PART_BYTES`` of text that are in work, or one longer text.

Edge cases: null and empty texts have no tokens. Repeated rows are encoded each; extra columns are ignored or
carried; no rows give no rows. Texts of any length are taken whole. Texts are ordinary text throughout: no special tokens.
Ties do not arise: the last token of a prefix is unique.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain

import ahocorasick
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemetrix.llm.common import give_back, parts, slices, unwrap, wrap

KEPT = 200_000  # pairs of tokens
KEPT_BYTES = 32 << 20  # a generation of pieces
PART_BYTES = 2 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank of a rank file (base64 and rank a line)."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f) if token}


class Vocabulary:
    """Ranks, the tokens that BPE can reach with their last merges, and which pairs of tokens stay apart."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.decimals = {rank: b"%d" % rank for rank in self.tokens}
        self.longest = max(map(len, ranks))
        self.parts: dict[int, tuple[int, int]] = {}  # of a token that a merge makes: the two tokens merged
        self.joined: dict[tuple[int, int], int] = {}
        self.reach: dict[bytes, int] = {}
        self.ending = ahocorasick.Automaton()  # of the tokens in reach; bytes as characters of the same number
        for token, rank in ranks.items():
            if len(token) > 1:
                left = self.merged(token, 2)
                if len(left) != 2:
                    continue
                pair = ranks[left[0]], ranks[left[1]]
                self.parts[rank], self.joined[pair] = pair, rank
            self.ending.add_word(token.decode("latin-1"), (rank, len(token)))
            self.reach[token] = rank
        self.ending.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}

    def merged(self, text: bytes, least: int = 1) -> list[bytes]:
        """BPE of a short text by its definition: merge the adjacent pair of lowest rank, leftmost first, down to
        ``least`` tokens."""
        parts, get, none = [text[i:i + 1] for i in range(len(text))], self.ranks.get, 1 << 60
        while len(parts) > least:
            found = [get(a + b, none) for a, b in zip(parts, parts[1:])]
            rank = min(found)
            if rank == none:
                break
            at = found.index(rank)
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def apart(self, first: int, second: int) -> bool:
        """Whether BPE of the two tokens' bytes gives the two tokens; kept in ``pairs``.

        BPE makes its merges in the order of rank, equal ones from the left. So of the two tokens at the border the one
        made later is undone, step by step, which shows each pair that ever touched there; a pair was merged if its merge came
        before the one that took either token away.
        """
        if len(self.pairs) >= KEPT:
            self.pairs.clear()
        parts, joined = self.parts, self.joined
        a, b, until, found = first, second, 1 << 60, True
        while True:
            if joined.get((a, b), until) < until:
                found = False
                break
            left, right = a if a in parts else -1, b if b in parts else -1  # bytes were there before any merge
            if left < 0 and right < 0:
                break
            if right >= left:
                until, b = right + 1, parts[b][0]  # an equal merge to the left would have come first
            else:
                until, a = left, parts[a][1]
        self.pairs[first, second] = found
        return found


class Prefixes:
    """The last token (its rank) of each prefix of a growing, editable text."""

    def __init__(self, vocabulary: Vocabulary, text: bytes = b""):
        self.vocabulary, self.text, self.last = vocabulary, b"", []
        self.append(text)

    def _grow(self, text: bytes, stop: Callable[[int], bool] | None = None) -> None:
        """Add the last tokens of the prefixes of ``text`` that are longer than those at hand, until ``stop`` of one is true."""
        v, last = self.vocabulary, self.last
        known, apart_ = v.pairs.get, v.apart
        done = len(last)
        base = max(0, done + 1 - v.longest)
        for end, (token, size) in v.ending.iter(text[base:].decode("latin-1")):
            end += base + 1
            if end <= done:
                continue
            if end > done + 1:
                break
            if end > size:
                before = last[end - size - 1]
                apart = known((before, token))
                if not (apart_(before, token) if apart is None else apart):
                    continue
            last.append(token)
            done = end
            if stop and stop(token):
                return
        if done < len(text):
            raise ValueError(f"the vocabulary lacks the byte {text[done]}")

    def append(self, more: bytes) -> None:
        self.text += more
        self._grow(self.text)

    def truncate(self, size: int) -> None:
        self.text, self.last = self.text[:size], self.last[:size]

    def replace(self, start: int, end: int, new: bytes) -> int:
        """Put ``new`` in place of text[start:end]; returns how many prefixes after it had to be encoded again.

        Last tokens only look back ``longest`` bytes of text and of last tokens, so once that many in a row equal the
        old ones, all later ones do.
        """
        old, tail = self.last[end:], self.text[end:]
        self.truncate(start)
        self.append(new)
        self.text += tail
        same = done = 0

        def in_step(token: int) -> bool:
            nonlocal same, done
            same = same + 1 if token == old[done] else 0
            done += 1
            return same >= self.vocabulary.longest

        self._grow(self.text, in_step)
        self.last += old[done:]
        return done

    def encoding(self) -> list[int]:
        out, end, tokens, last = [], len(self.text), self.vocabulary.tokens, self.last
        while end:
            token = last[end - 1]
            out.append(token)
            end -= len(tokens[token])
        return out[::-1]


#: Ids of a piece.
Piece = tuple[int, ...]


class Encoder:
    """Token ids of whole texts."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, kept_bytes: int = KEPT_BYTES):
        self.vocabulary, self.find = Vocabulary(ranks), regex.compile(pattern).findall
        self.kept: dict[str, Piece] = {}  # the younger generation
        self.old: dict[str, Piece] = {}
        self.size, self.kept_bytes = 0, kept_bytes

    def _keep(self, piece: str, value: Piece) -> None:
        self.kept[piece] = value
        self.size += 200 + 2 * len(piece) + 8 * len(value)  # about what Python needs

    def learn(self, found: set[str]) -> None:
        """Bring pieces into the younger generation. Those in neither are encoded in order: one prefix table is cut to what two
        neighbours share and grown on."""
        kept, old, ranks = self.kept, self.old, self.vocabulary.ranks
        table, before, new = Prefixes(self.vocabulary), b"", []
        for piece in found:
            if piece not in kept:
                if piece in old:
                    self._keep(piece, old[piece])
                else:
                    new.append((piece.encode(), piece))
        new.sort()
        for data, piece in new:
            rank = ranks.get(data)
            if rank is not None:
                ids: Piece = (rank,)
            else:
                shared = 0
                for one, other in zip(before, data):
                    if one != other:
                        break
                    shared += 1
                table.truncate(shared)
                table.append(data[shared:])
                before = data
                ids = tuple(table.encoding())
            self._keep(piece, ids)

    def pieces(self, texts: list[str | None]) -> list[list[Piece]]:
        """The ids of the pieces of each text."""
        find = self.find
        found = [find(t or "") for t in texts]
        if self.size > self.kept_bytes:  # before learning, so that all pieces of these texts are at hand
            self.old, self.kept, self.size = self.kept, {}, 0
        self.learn(set(chain.from_iterable(found)))
        kept = self.kept
        return [[kept[p] for p in t] for t in found]

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(self.pieces([text])[0]))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.vocabulary.tokens.__getitem__, ids))

    def decimals(self, ids: Iterable[int]) -> bytes:
        """The ids in decimal, joined by one space."""
        return b" ".join(map(self.vocabulary.decimals.__getitem__, ids))


@dataclass(frozen=True)
class Ranks:
    """Broadcast ranks, told apart by what they hold."""

    digest: str
    value: Broadcast = field(compare=False)


@lru_cache(maxsize=1)
def encoder(ranks: Ranks, pattern: str) -> Encoder:
    """One encoder a worker process, so that tasks share the pieces it has met."""
    return Encoder(ranks.value.value, pattern)


#: How documents' ids become result columns.
Columns = Callable[[Encoder, list[list[int]]], tuple[pa.Array, ...]]
DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def _ids(coder: Encoder, texts: list[list[int]]) -> tuple[pa.Array, ...]:
    return (pa.array(texts, pa.list_(pa.int32())),)


def _decoded(coder: Encoder, texts: list[list[int]]) -> tuple[pa.Array, ...]:
    return (pa.array([coder.decode(t) for t in texts], pa.binary()),)


def _digests(coder: Encoder, texts: list[list[int]]) -> tuple[pa.Array, ...]:
    return (pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(coder.decimals(t)).hexdigest() for t in texts], pa.string()),
            pa.array([hashlib.sha256(coder.decode(t)).hexdigest() for t in texts], pa.string()))


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text") -> DataFrame:
    """Each document as ``row`` with ids (array<int>) and decoded (the bytes of the ids)."""
    return _encode(docs, ranks_path, pattern, text, lambda c, t: _ids(c, t) + _decoded(c, t), "ids array<int>, decoded binary")


def digests(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text") -> DataFrame:
    """Each document as ``row`` with n_tokens, ids_sha256 and decoded_sha256."""
    return _encode(docs, ranks_path, pattern, text, _digests, DIGESTS)


def encoded(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text") -> DataFrame:
    """Each document as ``row`` with its ids and the digests of ``digests``."""
    return _encode(docs, ranks_path, pattern, text, lambda c, t: _ids(c, t) + _digests(c, t), "ids array<int>, " + DIGESTS)


def _encode(docs: DataFrame, ranks_path: str, pattern: str, text: str, columns: Columns, kinds: str) -> DataFrame:
    spark = docs.sparkSession
    held = read_ranks(ranks_path)
    digest = hashlib.sha256(b"".join(b"%d %d %b" % (rank, len(token), token) for token, rank in held.items())).hexdigest()
    ranks = Ranks(digest, spark.sparkContext.broadcast(held))
    frame = wrap(docs, text=text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        coder = encoder(ranks, pattern)
        gc.disable()  # pieces make no cycles, and walking through all that are kept takes a third of the time
        try:
            for batch in parts(batches):
                texts = batch.column("text").to_pylist()
                for first, last in slices(texts, PART_BYTES):
                    made = columns(coder, [list(chain.from_iterable(t)) for t in coder.pieces(texts[first:last])])
                    yield pa.RecordBatch.from_arrays([batch.column("row").slice(first, last - first), *made], ["row", *names])
        finally:
            coder.old = {}  # a later stage on this worker has use for the memory
            gc.enable()

    new = spark.createDataFrame([], kinds)
    names = new.columns
    shape = frame.drop("text")
    for f in new.schema:
        shape = shape.withColumn(f.name, F.lit(None).cast(f.dataType))
    return frame.mapInArrow(run, shape.schema)


def encode_rows(docs: DataFrame, ranks_path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each document."""
    return digests(docs, ranks_path, pattern, text).select(
        F.col(f"row._c{docs.columns.index(doc_id)}").alias("doc_id"), "n_tokens", "ids_sha256", "decoded_sha256")
