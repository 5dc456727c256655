import hashlib
import itertools
import random
import zlib

import pytest

from telemetrix.llm import conversation_repair as cr
from telemetrix.llm.queries import op13_conversation_repair

ROLES = {"s": "system", "u": "user", "a": "assistant", "t": "tool"}


def legal(roles):
    initials = "".join(r[:1] or "?" for r in roles)
    return initials == "" or initials.removeprefix("s").replace("ua", "") == "" and initials != "s"


def every_repair(turns, fault):
    """(cost, letters, repaired) of all edits with at most two turns inserted at a place, by trying each."""
    choices = []
    for (role, text), f in zip(turns, fault):
        own = [("D", 2, None)]
        if f not in ("blank", "duplicate"):
            extra = 5 * (f == "truncated")
            own += [("K", extra, (role, text)), *(("R", 1 + extra, (r, text)) for r in ("user", "assistant"))]
        choices.append(own)
    empty = [("I", 5, ("user", "")), ("I", 5, ("assistant", ""))]
    gaps = [(), *((e,) for e in empty), *itertools.product(empty, repeat=2)]
    for pick in itertools.product(*choices):
        for between in itertools.product(gaps, repeat=len(turns) + 1):
            if sum(map(len, between)) > 3:
                continue
            done = [*between[0], *itertools.chain.from_iterable((p, *b) for p, b in zip(pick, between[1:]))]
            out = [d[2] for d in done if d[2]]
            if legal([r for r, _ in out]):
                yield sum(d[1] for d in done), "".join(d[0] for d in done), out


def test_all_repairs_of_short_conversations():
    rnd = random.Random(5)
    for _ in range(150):
        turns = [(rnd.choice(["system", "user", "assistant", "tool", "s", ""]), rnd.choice(["Hi.", "so", "Why?", " ", "No!"]))
                 for _ in range(rnd.randint(0, 3))]
        *_, cost, letters, out = cr.mend([None] * len(turns), turns)
        want = min(every_repair(turns, cr.faults(turns)), key=lambda r: r[:2])
        assert (cost, letters, out) == want


def by_rounds(turns, fault):
    """Least (cost, letters) by a plain forward search over (turn, state), a turn at a time."""
    best = {"": (0, "")}  # state: initials' last letter, after system 's'
    then = {"": "u", "s": "u", "u": "a", "a": "u"}

    def insert(best):
        best = dict(best)
        for _ in range(3):
            for state, (c, x) in list(best.items()):
                best[then[state]] = min(best.get(then[state], (1 << 30, "")), (c + 5, x + "I"))
        return best

    for (role, _), f in zip(turns, fault):
        new = {}

        def put(state, cost, letters):
            new[state] = min(new.get(state, (1 << 30, "")), (cost, letters))

        for state, (c, x) in insert(best).items():
            put(state, c + 2, x + "D")
            if f not in ("blank", "duplicate"):
                extra, i = 5 * (f == "truncated"), role[:1]
                if i == then[state] or i == "s" and state == "":
                    put(i, c + extra, x + "K")
                put(then[state], c + 1 + extra, x + "R")
        best = new
    best = insert(best)
    return min(best[s] for s in ("", "a") if s in best)


@pytest.mark.parametrize("size", [5, 40, 1000])
def test_long_conversations(size):
    rnd = random.Random(size)
    for _ in range(4000 // size):
        turns = [(ROLES[rnd.choice("suaatu")], rnd.choice(["Hi.", "so", f"x{rnd.random()}.", f"y{rnd.random()}", ""])) for _ in range(size)]
        if rnd.random() < 0.3:
            turns = [(ROLES["ua"[k % 2]], f"z{k}.") if rnd.random() < 0.9 else t for k, t in enumerate(turns)]
        *_, cost, letters, out = cr.mend(list(range(size)), turns)
        assert (cost, letters) == by_rounds(turns, cr.faults(turns))
        assert legal([r for r, _ in out])


def test_block_tables_agree_with_single_turns():
    t = cr.tables()
    rnd = random.Random(1)
    assert len(t.vectors) == len(set(t.vectors)) < 400 and all(v[cr.ANSWERED] == 0 for v in t.vectors)
    for _ in range(500):
        v, signs = rnd.randrange(len(t.vectors)), [rnd.randrange(cr.SYMBOLS) for _ in range(cr.BLOCK)]
        want = t.vectors[v]
        for sign in reversed(signs):
            want = cr.before(sign, want)
        code = 0
        for sign in signs:
            code = code * cr.SYMBOLS + sign
        got = t.vectors[t.then[cr.BLOCK][v, code]]
        assert tuple(x + t.more[cr.BLOCK][v, code] for x in got) == want


def expected(rows):
    talks = {}
    for conv, turn, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        m = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        own = talks.setdefault(conv, [])
        text = "" if m == 1 else "".join(c for c in text if c not in ".!?") if m == 2 else text
        own += [(turn is not None, turn or 0, "user" if m == 4 else role, text)] * (0 if m == 0 else 2 if m == 3 else 1)
    out = []
    for conv, own in talks.items():
        own.sort()
        turns = [t[2:] for t in own]
        known = [t[1] for t in own if t[0]]
        fault = cr.faults(turns)
        cost, letters = by_rounds(turns, fault)
        text = "\n".join(f"{r}:{t}" for r, t in cr.repaired(turns, letters))
        initials = [r[:1] for r, _ in turns]
        out.append((conv, max(known) - min(known) + 1 - len(set(known)) if known else 0, *(fault.count(f) for f in ("blank", "duplicate", "truncated")),
                    sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, letters,
                    hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_query_like_plain_search(spark, sf_small):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = op13_conversation_repair(spark, sf_small)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == expected(rows)


def test_nulls_clashing_names_and_no_rows(spark, tmp_path):
    rnd = random.Random(9)
    rows = [(rnd.choice([None, 1, 2, 3, 4, 5]), rnd.choice([None, *range(9)]), rnd.choice([None, "", "user", "assistant", "system", "ü"]),
             rnd.choice([None, "", "é.", "no end", "a\x0b!\t", "." * 50_000])) for _ in range(80)]
    rows += [(100 + k, 0, "user", "hi.") for k in range(60)]  # some lose their only turn
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    extra = turns.selectExpr("*", "1 as conv", "2 as Turn_", "array(3) as turns")
    extra.write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted((tuple(r) for r in op13_conversation_repair(spark, str(tmp_path)).collect()), key=repr)
    assert got == expected(rows)
    assert any(r[6:8] == (0, "") for r in got)
    out = cr.repair(extra)
    assert out.columns == ["conv", *cr.NAMES] and cr.repair(extra.limit(0)).count() == 0
    repeated = cr.repair(turns.unionByName(turns).where("conv_id = 1")).first()
    assert repeated.duplicate >= turns.where("conv_id = 1 and text = 'é.'").select("role").distinct().count()
