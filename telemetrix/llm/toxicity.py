"""Toxicity by noisy-channel deobfuscation.

A writer hides a word by look-alike signs (1d10t), by spacing or dotting its letters (i d i o t, i.d.i.o.t) and by
repeating them (idiooot). Each suspicious piece of text becomes a lattice: every sign may stand for itself, for
a letter it resembles, for a repeat of the letter before it, or for nothing (a separator). Viterbi search
finds the intended letters with the least cost under the channel and a character trigram model. Suspicious are tokens
with signs or digits in them, or of nothing else, runs of single signs with any white space between them, and words with a doubled
letter that are no lexicon entries (read without the repeat where that is stronger evidence). A piece
without such signs has a single path, itself. The restored words are then scored: each word takes the
strongest evidence of its lexicon entries (the word and its beginnings of 4 to 9 letters), and the sum over the distinct
words of a text, calibrated, is the probability of label 1.

Fit: on all labelled documents; three quarters, by a hash of the id, give the character model and the lexicon (entry
weights from the lower confidence bound of the share of toxic documents), one quarter the calibration. Tasks count the
entries of their texts, at most about ``HELD`` at a time, and a shuffle adds them up; the driver gets the letters, the
lexicon, and how often each distinct sum of evidence occurs. All documents are scored as whole texts in one pass without a
shuffle. What is known of tokens and words is kept per task, for at most ``KEPT`` of each.

Edge cases: null and empty texts have no words and the score of a text without evidence. Without labels of both classes
every text gets (n1 + 1) / (n + 2). Repeated rows are scored each; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemetrix.llm.common import give_back, parts, pick, unwrap, wrap
from telemetrix.llm.labels import Constant, calibrate, class_counts, labelled, split_number

THRESHOLD = 0.7
KEPT = 100_000
HELD = 400_000  # words and entries counted by a task before it sends them
SETTLE = 64  # signs of a lattice after which the part that all paths share is written out
CONFIDENCE = 2.0
LEAST_SHARE = 0.3

# Signs and the letters they are written for, and their costs (negative log weights).
LOOKALIKE = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
             "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "¡": "i"}
SEPARATORS = " .-_*~'/,:"
COST_LOOKALIKE, COST_REPEAT, COST_SEPARATOR, COST_SIGN, COST_BREAK = 0.5, 0.7, 0.2, 9.0, 4.0

SPACED = re.compile(r"(?<!\S)[^\s|](?:[ \t][^\s|]){2,}(?!\S)")
SPREAD = re.compile(r"(?<!\S)[^\s|](?:\s++[^\s|]){2,}(?!\S)")
EDGE = re.compile(r"^[^\w@$!|+€£¡]+|(?:[^\w$@]|([^\w])\1+|[^\w]{2,})+$")
ODD = re.compile(r"[\d@$!|+€£¡_]|[^\w]|(.)\1\1")
LETTER = re.compile(r"[^\W\d_]")
READABLE = re.compile(r"[^\W\d_]|[%s]" % re.escape("".join(LOOKALIKE)))  # a letter or what may stand for one
DOUBLE = re.compile(r"(.)\1")
SAME = re.compile(r"(.)\1+")


@dataclass
class Letters:
    """Interpolated character trigram model of words."""

    counts: dict[str, int]
    known: dict[tuple[str, str], float] = field(default_factory=dict)

    def cost(self, before: str, letter: str) -> float:
        found = self.known.get((before, letter))
        if found is None:
            get, p = self.counts.get, 1 / 200
            for context in ("", before[-1:], before[-2:]):
                p = (get(context + letter, 0) + 5 * p) / (get(context + "\0", 0) + 5)
            found = self.known[before, letter] = -math.log(p)
        return found


def letter_counts(words: Counter) -> Counter:
    """Counts of letters after contexts of up to two letters; ``\\0`` after a context counts the context."""
    windows: dict[str, int] = {}  # a letter after its longest context
    get = windows.get
    for word, n in words.items():
        marked = "^" + word + "^"
        for window in (marked[:2], *[marked[i:i + 3] for i in range(len(word))]):
            windows[window] = get(window, 0) + n
    out: Counter = Counter()
    for window, n in windows.items():
        for context in {"", window[-2:-1], window[:-1]}:
            out[context + window[-1]] += n
            out[context + "\0"] += n
    return out


class Node:
    """A letter (or a blank) of a path, and the node before it; a node without one before it is settled."""

    __slots__ = ("before", "sign", "depth")

    def __init__(self, before: Node | None, sign: str, depth: int):
        self.before, self.sign, self.depth = before, sign, depth


def text_of(node: Node) -> str:
    """The text of a path after its settled node."""
    signs = []
    while node.before is not None:
        signs.append(node.sign)
        node = node.before
    return "".join(reversed(signs))


def texts_since(one: Node, other: Node) -> tuple[str, str]:
    """The texts of two paths after their last common node, or of as many steps back as keep a comparison short."""
    signs: tuple[list[str], list[str]] = ([], [])
    for _ in range(2 * SETTLE):
        if one is other:
            break
        if one.depth >= other.depth:
            signs[0].append(one.sign)
            one = one.before
        else:
            signs[1].append(other.sign)
            other = other.before
    return "".join(reversed(signs[0])), "".join(reversed(signs[1]))


def common(nodes: set[Node]) -> Node:
    """The last node that all paths pass."""
    while len(nodes) > 1:
        deepest = max(nodes, key=lambda n: n.depth)
        nodes.remove(deepest)
        nodes.add(deepest.before)
    return nodes.pop()


def decode(piece: str, letters: Letters) -> list[str]:
    """The intended words of a piece of text, by Viterbi search over its lattice.

    Paths keep nodes instead of texts; every ``SETTLE`` signs what all paths have in common is written out.
    """
    paths: dict[str, tuple[float, Node]] = {"^": (0.0, Node(None, "", 0))}  # last two letters -> cost, last node
    previous, written, due = "", [], SETTLE
    for i, sign in enumerate(piece):
        after: dict[str, tuple[float, Node]] = {}

        def offer(state: str, cost: float, node: Node, letter: str = "") -> None:
            best = after.get(state)
            if best is not None and best[0] < cost:
                return
            if letter:
                node = Node(node, letter, node.depth + 1)
            if best is not None and best[0] == cost:
                mine, other = texts_since(node, best[1])
                if mine >= other:  # the smaller text, as far as it is compared
                    return
            after[state] = (cost, node)

        if i == due:
            settled = common({node for _, node in paths.values()})
            written.append(text_of(settled))
            settled.before = None
            due = i + max(SETTLE, *(node.depth - settled.depth for _, node in paths.values()))
        letter_sign = LETTER.match(sign)
        for state, (cost, node) in paths.items():
            if letter_sign:
                offer((state + sign)[-2:], cost + letters.cost(state, sign), node, sign)
                if sign == previous:
                    offer(state, cost + COST_REPEAT, node)
                continue
            for letter in LOOKALIKE.get(sign, ""):
                offer((state + letter)[-2:], cost + COST_LOOKALIKE + letters.cost(state, letter), node, letter)
            if sign in SEPARATORS:
                offer(state, cost + COST_SEPARATOR, node)
                if node.sign not in ("", " "):
                    offer("^", cost + COST_BREAK + letters.cost(state, "^"), node, " ")
            else:
                offer(state, cost + COST_SIGN, node)  # a sign that stands for no letter
            if sign == previous:
                offer(state, cost + COST_REPEAT, node)
        paths, previous = after, sign
    ends = [(cost + letters.cost(state, "^"), text_of(node)) for state, (cost, node) in paths.items()]
    return ("".join(written) + min(ends)[1]).split()


def trimmed(token: str) -> str:
    """A token without punctuation around it; signs that can stand for a letter stay at its start."""
    return EDGE.sub("", token)


def core(token: str) -> tuple[str, bool]:
    """What a token of a lower-cased text is read from (nothing, if no sign of it can be a letter), and whether that is suspicious."""
    if token.isalpha() and (not DOUBLE.search(token) or not ODD.search(token)):
        return token, False
    found = trimmed(token)
    return (found, ODD.search(found) is not None) if READABLE.search(found) else ("", False)


def spread(low: str, tokens: list[str]) -> set[str]:
    """Distinct runs of single signs in a lower-cased text with these tokens; wide gaps part words or letters."""
    if b"\1\1\1" not in bytes(map((1).__eq__, map(len, tokens))):  # either pattern takes three such tokens
        return set()
    odd = {" ".join(m.group().split()) for p in (SPACED, SPREAD) for m in p.finditer(low)}
    return {p for p in odd if READABLE.search(p)}


def pieces(text: str | None) -> tuple[set[str], set[str]]:
    """Distinct plain words and distinct suspicious pieces of a text."""
    if not text:
        return set(), set()
    low = text.lower()
    tokens = low.split()
    found = {core(token) for token in set(tokens)} - {("", False)}
    return {p for p, odd in found if not odd}, {p for p, odd in found if odd} | spread(low, tokens)


class Kept(dict):
    """What a function gives for each key, kept for at most ``KEPT`` keys."""

    def __init__(self, make: Callable):
        self.make = make

    def __missing__(self, key: str):
        found = self.make(key)
        if len(self) >= KEPT:
            self.clear()
        self[key] = found
        return found


def entries(word: str) -> list[str]:
    """Lexicon entries of a word: itself and its beginnings."""
    return [word, *[word[:k] + "-" for k in range(4, min(10, len(word)))]]


@dataclass
class Model:
    letters: dict[str, int]
    lexicon: dict[str, float]
    probability: Callable[[np.ndarray], np.ndarray] | None = None


class Evidence:
    """Evidence in texts; keeps the evidence of words and the decoded pieces it has met."""

    def __init__(self, model: Model):
        self.letters, self.lexicon = Letters(model.letters), model.lexicon
        self.starts = {e[:4] for e in self.lexicon if e[-1:] == "-"}  # of the beginnings of words
        self.single = {SAME.sub(r"\1", e) for e in self.lexicon}
        self.heads = {e.rstrip("-")[:2] for e in self.single}
        self.evident = Kept(self.evident_words)
        self.decoded: dict[str, list[str]] = {}

    def word(self, word: str) -> float:
        if word[:4] in self.starts:
            return max([self.lexicon.get(e, 0.0) for e in entries(word)])
        return self.lexicon.get(word, 0.0)

    def may_read(self, word: str) -> bool:
        """Whether an entry equals a beginning of the plain word, or all of it, apart from repeats of letters."""
        word = SAME.sub(r"\1", word)
        if word[:2] not in self.heads and word[:1] not in self.heads:
            return False
        return word in self.single or any([word[:k] + "-" in self.single for k in range(1, 10)])

    def evident_words(self, token: str) -> tuple[str, ...]:
        """The words of a token that are evidence."""
        if token.isalpha() and not DOUBLE.search(token):  # its only reading, as most are
            return (token,) if self.word(token) else ()
        return tuple(filter(self.word, self.spelled(*core(token))))

    def spelled(self, piece: str, odd: bool) -> list[str]:
        """The words of a plain word or a suspicious piece."""
        if odd:
            return self.reading(piece)
        if piece and piece not in self.lexicon and DOUBLE.search(piece) and self.may_read(piece):
            words = self.reading(piece)  # a repeat or the spelling of the word: whichever is evidence
            if max(map(self.word, words), default=0.0) > self.word(piece):
                return words
        return [piece] if piece else []

    def restored(self, text: str | None) -> set[str]:
        """Distinct words of the restored text."""
        plain, odd = pieces(text)
        found: set[str] = set()
        for piece in plain:
            found.update(self.spelled(piece, False))
        for piece in odd:
            found.update(self.reading(piece))
        return found

    def reading(self, piece: str) -> list[str]:
        words = self.decoded.get(piece)
        if words is None:
            if len(self.decoded) >= KEPT:
                self.decoded.clear()
                self.letters.known.clear()
            words = self.decoded[piece] = decode(piece, self.letters)
        return words

    def raw(self, text: str | None) -> float:
        """Sum over the evident words of the restored text; what a token holds of them is looked up by token."""
        if not text:
            return 0.0
        low = text.lower()
        tokens = low.split()
        found = set().union(*map(self.evident.__getitem__, set(tokens)))
        for piece in spread(low, tokens):
            found.update(filter(self.word, self.reading(piece)))
        return sum(sorted(map(self.word, found)))


def fit(docs: DataFrame, labels: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text",
        label: str = "toxic") -> Model:
    known = labelled(labels, doc_id, label, learn)
    counts = class_counts(known)
    if not min(counts):
        return Model({}, {}, Constant(counts))
    rows = pick(docs, id=doc_id, text=text).where("id is not null").where(learn)  # before texts are moved to their labels
    part = split_number(F.col("id")) % 4

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        plain = Kept(lambda token: tuple(piece for piece, odd in [core(token)] if piece and not odd))
        spelled = Kept(entries)
        tokens: Counter = Counter()
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in parts(batches):
            for y, body in zip(batch.column("y").to_pylist(), batch.column("text").to_pylist()):
                words = set().union(*map(plain.__getitem__, set((body or "").lower().split())))
                tokens.update(words)
                seen[int(y)].update(set().union(*map(spelled.__getitem__, words)))
                if len(tokens) + len(seen[0]) + len(seen[1]) >= HELD:
                    yield _counted(tokens, seen)
        yield _counted(tokens, seen)

    tally = (rows.where(part > 0).join(known.hint("shuffle_hash"), "id").select("y", "text")  # as many labels as texts: never broadcast
             .mapInArrow(count, "kind string, key string, clean long, toxic long")
             .groupBy("kind", "key").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
             .where("kind = 'letters' or toxic >= 3 and toxic > clean").collect())
    letters = {r.key: r.clean for r in tally if r.kind == "letters"}
    lexicon = {r.key: -math.log(1 - s) for r in tally if r.kind == "entry"
               and (s := lower_bound(r.toxic, r.clean)) >= LEAST_SHARE}
    model = Model(letters, lexicon)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        evidence = Evidence(model)
        for batch in parts(batches):
            raw = [evidence.raw(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(raw, pa.float64())], ["id", "x"])

    found = rows.where(part == 0)
    shape = found.select("id", F.lit(0.0).alias("x")).schema
    measured = (found.mapInArrow(measure, shape).join(known, "id").groupBy("x", "y").agg(F.count("*").alias("n"))
                .orderBy("x", "y").toArrow())
    x, y, n = (measured.column(c).to_numpy() for c in ("x", "y", "n"))
    model.probability = calibrate(x, y, counts, n)
    return model


def _counted(tokens: Counter, seen: tuple[Counter, Counter]) -> pa.RecordBatch:
    """Counts of letters and of entries as rows; empties the counters."""
    letters, keys = letter_counts(tokens), [*(seen[0].keys() | seen[1].keys())]
    first = len(letters)
    out = pa.RecordBatch.from_arrays(
        [pa.array(["letters"] * first + ["entry"] * len(keys), pa.string()), pa.array([*letters, *keys], pa.string()),
         pa.array([*letters.values(), *[seen[0].get(k, 0) for k in keys]], pa.int64()),
         pa.array([0] * first + [*[seen[1].get(k, 0) for k in keys]], pa.int64())], ["kind", "key", "clean", "toxic"])
    for counter in (tokens, *seen):
        counter.clear()
    return out


def lower_bound(toxic: int, clean: int) -> float:
    """Wilson lower bound of the share of toxic documents."""
    n, z2 = toxic + clean, CONFIDENCE ** 2
    p = toxic / n
    return (p + z2 / (2 * n) - CONFIDENCE * math.sqrt(p * (1 - p) / n + z2 / (4 * n * n))) / (1 + z2 / n)


def _score(frame: DataFrame, model: Model) -> DataFrame:
    """Adds score to a frame of any columns with text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        evidence = Evidence(model)
        for batch in parts(batches):
            raw = np.array([evidence.raw(t) for t in batch.column("text").to_pylist()])
            kept = [i for i, n in enumerate(batch.schema.names) if n != "text"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in kept), pa.array(model.probability(raw), pa.float64())],
                [*(batch.schema.names[i] for i in kept), "score"])

    return frame.mapInArrow(run, frame.drop("text").withColumn("score", F.lit(0.0)).schema)


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text",
          threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score (probability of label 1) and predicted of each document."""
    scored = _score(pick(docs, doc_id=doc_id, text=text), model)
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_clean(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score is below the threshold."""
    return unwrap(_score(wrap(docs, text=text), model).where(F.col("score") < threshold), docs.columns)
