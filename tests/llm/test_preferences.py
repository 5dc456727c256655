from telemetrix.llm.preferences import preferences


def render(turns):
    return "".join(f"<|{r}|>\n{t}<|end|>\n" for r, t in turns)


def test_common_prefix_masks_and_edges(spark):
    talks = {
        1: [("system", "s"), ("user", "q"), ("assistant", "good"), ("user", "é?"), ("assistant", "")],
        2: [("system", "s"), ("user", "q"), ("assistant", "bad")],
        3: [("user", "x")], 4: [("user", "x"), ("assistant", "y")], 5: [("user", "z")],
    }
    rows = [(c, k, r, t, "n") for c, turns in talks.items() for k, (r, t) in enumerate(turns)]
    rows += [(None, 0, "user", "lost", "n"), (6, None, None, None, "n"), (6, 1, "user", "u", "n"), (6, 1, "user", "u", "n")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, Text2 string")
    pairs = spark.createDataFrame([(1, 1, 2), (2, 3, 4), (3, 5, 5), (4, 3, 99), (5, None, 5), (6, 6, 3)],
                                  "pair_id long, chosen long, rejected long")
    got = {r.pair_id: r for r in preferences(turns, pairs).collect()}
    one = got[1]
    assert one.n_common == 2 and one.prompt == render(talks[1][:2])
    assert one.chosen == render(talks[1][2:]) and one.rejected == render(talks[2][2:])
    assert [one.chosen[s.start:s.start + s.size] for s in one.chosen_spans] == ["good<|end|>\n", "<|end|>\n"]
    assert [one.rejected[s.start:s.start + s.size] for s in one.rejected_spans] == ["bad<|end|>\n"]
    assert (got[2].n_common, got[2].prompt, got[2].chosen, got[2].rejected) == (1, render(talks[3]), "", render(talks[4][1:]))
    assert (got[3].n_common, got[3].chosen, got[3].rejected) == (1, "", "")
    assert (got[4].n_common, got[4].prompt, got[4].chosen, got[4].rejected) == (0, "", render(talks[3]), None)
    assert (got[5].chosen, got[5].rejected) == (None, render(talks[5]))
    assert got[6].chosen == render([("", ""), ("user", "u"), ("user", "u")])
    assert preferences(turns.limit(0), pairs.limit(0)).count() == 0
