"""Cheapest repair of a conversation's structure, by Four-Russians block tables.

A repaired conversation's roles are nothing, or an optional system turn and then user and assistant in turn, ending with the
assistant. Turns may be kept (K, free), given the role user or assistant (R, 1), deleted (D, 2), and empty turns of either role
inserted anywhere (I, 5). Blank turns and repeats of an earlier turn (role and text) must go; a truncated turn, one that
ends in the middle of a sentence, costs 5 more if it stays. Of the cheapest repairs the one whose letters sort first is taken.

Four states say what the kept turns so far ask for: start, after system, after user, after assistant. The costs
from a place to the end are a vector over the states, which differs from its last entry by small numbers only, so few such
normalised vectors exist. A turn is one of ten symbols (by role's initial and fault); for each vector and each block of
``BLOCK`` symbols a table, composed by doubling, holds the vector before the block and what the block adds. A
conversation is run through from its end by one lookup a block. Its edits are then read from the start: each block
is expanded backward into the vectors between its turns, and at each turn the first letter that keeps to the least cost is taken.
Letter and state fix the next state, so that choice gives the first string of all.

Scale: turns are gathered by conversation, which is one row of the result with all its turns; texts are not compared across
conversations, so copies are no hot keys. Tables are computed once per worker process.

Edge cases: null roles and texts count as one space (so such texts are blank); turns without a number come first; turns of
one number are ordered by role and text. A null conversation id is a conversation like any other. Conversations of any
length are taken whole; extra columns are ignored; no rows give no rows. Rows whose ``present`` column is not true only name
their conversation; one without any other rows has zeros, empty letters and no turns.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemetrix.llm.common import parts, pick

# Costs of the edits, white space, ends of sentences, roles, initials that may stand side by side.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
BLANKS = " \t\n\x0b\x0c\r"
ENDS = ".!?"
USER, ASSISTANT = "user", "assistant"
LEGAL = {"su", "ua", "au"}

START, SYSTEM, ASKED, ANSWERED = range(4)
#: State after an inserted or renamed turn, and after a kept one by initial.
GIVEN = (ASKED, ASKED, ANSWERED, ASKED)
KEPT = {"s": {START: SYSTEM}, "u": {START: ASKED, SYSTEM: ASKED, ANSWERED: ASKED}, "a": {ASKED: ANSWERED}, "": {}}
INITIALS = ("s", "u", "a", "")
PAD, GONE = 0, 1  # symbols: nothing, must go, then by initial and whether truncated
SYMBOLS = 2 + 2 * len(INITIALS)
BLOCK = 4

Vector = tuple[int, int, int, int]


def symbol(initial: str, truncated: bool) -> int:
    return 2 + 2 * INITIALS.index(initial if initial in INITIALS else "") + truncated


def with_inserts(costs: list[int]) -> list[int]:
    """Least costs when turns may be inserted first."""
    asked = min(costs[ASKED], INSERT + costs[ANSWERED])
    answered = min(costs[ANSWERED], INSERT + costs[ASKED])
    return [min(costs[START], INSERT + asked), min(costs[SYSTEM], INSERT + asked), asked, answered]


FAR = 1 << 20  # no repair ends in such a state without more turns
END = tuple(with_inserts([0, FAR, FAR, 0]))


def edits(sign: int, state: int) -> list[tuple[str, int, int]]:
    """Letter, cost and next state of what can be done with a turn, in the order of the letters."""
    out = [("D", DELETE, state)]
    if sign != GONE:
        initial, extra = INITIALS[(sign - 2) // 2], TRUNCATED * (sign % 2)
        if state in KEPT[initial]:
            out.append(("K", extra, KEPT[initial][state]))
        out.append(("R", REROLE + extra, GIVEN[state]))
    return out


def before(sign: int, after: Vector) -> Vector:
    """Least costs from before a turn, given those from after it."""
    if sign == PAD:
        return after
    return tuple(with_inserts([min(cost + after[then] for _, cost, then in edits(sign, s)) for s in range(4)]))


class Tables:
    """The normalised vectors and what a block of symbols does to each.

    ``then[width][v, code]`` is the vector before ``width`` symbols if v is the one after them and ``more[width][v, code]`` what they
    add; a code's digits, base ``SYMBOLS``, are the symbols from left to right.
    """

    def __init__(self) -> None:
        self.vectors: list[Vector] = [END]
        number = {END: 0}
        then, more = [], []
        for v in self.vectors:  # grows until no new vector comes
            rows = [before(sign, v) for sign in range(SYMBOLS)]
            least = [r[ANSWERED] for r in rows]
            normal = [tuple(x - low for x in r) for r, low in zip(rows, least)]
            for n in normal:
                if n not in number:
                    number[n] = len(self.vectors)
                    self.vectors.append(n)
            then.append([number[n] for n in normal])
            more.append(least)
        # END[ANSWERED] is zero, so END is normalised, too
        self.then, self.more = {1: np.array(then)}, {1: np.array(more)}
        width = 1
        while width < BLOCK:
            right_then, right_more = self.then[width], self.more[width]
            mid = right_then[:, None, :]  # (vector, left code, right code)
            left = np.arange(right_then.shape[1])[None, :, None]
            self.then[2 * width] = right_then[mid, left].reshape(len(self.vectors), -1)
            self.more[2 * width] = (right_more[mid, left] + right_more[:, None, :]).reshape(len(self.vectors), -1)
            width *= 2
        self.block_then, self.block_more = self.then[BLOCK].tolist(), self.more[BLOCK].tolist()

    @lru_cache(maxsize=1 << 16)
    def expand(self, code: int, after: int, state: int) -> tuple[str, int]:
        """Letters and last state of a block, from the number of the vector after it and the state before it."""
        signs = []
        for _ in range(BLOCK):
            code, sign = divmod(code, SYMBOLS)
            signs.append(sign)
        between = [self.vectors[after]]
        for sign in signs:  # from the right
            between.append(before(sign, between[-1]))
        letters = ""
        for sign, here, there in zip(reversed(signs), reversed(between), reversed(between[:-1])):
            while sign != PAD:
                kept_to = [(e[0], e[2]) for e in edits(sign, state) if e[1] + there[e[2]] == here[state]]
                if INSERT + here[GIVEN[state]] == here[state]:
                    kept_to.append(("I", GIVEN[state]))
                letter, state = min(kept_to)
                letters += letter
                if letter != "I":
                    break
        return letters, state


@lru_cache(maxsize=1)
def tables() -> Tables:
    return Tables()


def audit(signs: list[int]) -> tuple[int, str]:
    """Least cost, and the first of the cheapest repairs' letters."""
    t = tables()
    signs = [PAD] * (-len(signs) % BLOCK) + signs
    codes = []
    for k in range(0, len(signs), BLOCK):
        code = 0
        for sign in signs[k:k + BLOCK]:
            code = code * SYMBOLS + sign
        codes.append(code)
    v, cost, after = 0, 0, []
    for code in reversed(codes):
        after.append(v)
        cost += t.block_more[v][code]
        v = t.block_then[v][code]
    cost += t.vectors[v][START]
    state, letters = START, []
    for code, right in zip(codes, reversed(after)):
        more, state = t.expand(code, right, state)
        letters.append(more)
    letters.append("I" * (END[state] // INSERT))
    return cost, "".join(letters)


def faults(turns: list[tuple[str, str]]) -> list[str]:
    """blank, duplicate, truncated or nothing for each turn: the first that holds."""
    seen: set[tuple[str, str]] = set()
    out = []
    for turn in turns:
        said = turn[1].rstrip(BLANKS)
        out.append("blank" if not said else "duplicate" if turn in seen else "" if said[-1] in ENDS else "truncated")
        seen.add(turn)
    return out


def repaired(turns: list[tuple[str, str]], letters: str) -> list[tuple[str, str]]:
    """The turns after the edits."""
    rest, out, state = iter(turns), [], START
    for letter in letters:
        role, text = ("", "") if letter == "I" else next(rest)
        if letter == "D":
            continue
        then = KEPT[role[:1]][state] if letter == "K" else GIVEN[state]
        out.append((role if letter == "K" else USER if then == ASKED else ASSISTANT, text))
        state = then
    return out


NAMES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired"]
SHAPE = ", ".join(f"{n} long" for n in NAMES[:6]) + ", audit string, repaired array<struct<role:string,text:string>>"


def mend(numbers: list[int | None], turns: list[tuple[str, str]]) -> tuple:
    """``NAMES`` of a conversation."""
    known = [n for n in numbers if n is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    found = faults(turns)
    initials = [role[:1] for role, _ in turns]
    illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))
    cost, letters = audit([GONE if f in ("blank", "duplicate") else symbol(i, f == "truncated") for i, f in zip(initials, found)])
    return (gaps, *(found.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, letters, repaired(turns, letters))


def _mend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64()] * 6 + [pa.string(), pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))]
    for batch in parts(batches):
        made = []
        for talk in batch.column("turns").to_pylist():
            *head, out = mend([t["turn"] for t in talk], [(t["role"], t["text"]) for t in talk])
            made.append((*head, [{"role": r, "text": x} for r, x in out]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv"), *(pa.array(c, k) for c, k in zip(zip(*made), kinds))],
            ["conv", *NAMES])


def repair(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
           present: str | None = None) -> DataFrame:
    """conv, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired (turns) of each conversation."""
    named = dict(conv=conv_id, turn=turn, role=role, text=text) | ({"present": present} if present else {})
    rows = pick(turns, **named)
    one = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"),
                   F.coalesce("text", F.lit(" ")).alias("text"))
    here = F.when(F.col("present"), one) if present else one
    talks = rows.groupBy("conv").agg(F.sort_array(F.collect_list(here)).alias("turns"))
    return talks.mapInArrow(_mend, f"conv {rows.schema['conv'].dataType.simpleString()}, {SHAPE}")
