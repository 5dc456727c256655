import numpy as np
import pytest

from telemetrix.llm.suffixes import boundaries, repeated_classes, suffix_order, transform


def classes_by_strings(codes, length):
    padded = list(codes) + [0] * length
    return [tuple(padded[i:i + length]) for i in range(len(codes))]


@pytest.mark.parametrize("seed", range(30))
def test_classes_like_brute_force(seed):
    rnd = np.random.default_rng(seed)
    base = rnd.integers(1, 4 if seed % 2 else 30, 40)
    parts = [np.zeros(1, int)]
    for _ in range(rnd.integers(1, 8)):
        a, b = sorted(rnd.integers(0, 41, 2))
        parts += [base[a:b], rnd.integers(1, 4, rnd.integers(0, 5)), np.zeros(1, int)]
    codes = np.concatenate([*parts, np.zeros(12, int)]).astype(np.uint16)
    for length in (1, 2, 3, 5, 8, 12):
        order, number = repeated_classes(codes, length)
        strings = classes_by_strings(codes, length)
        assert sorted(order.tolist()) == list(range(len(codes)))
        got = {}
        for start, c in zip(order.tolist(), number.tolist()):
            got.setdefault(c, set()).add(strings[start])
        assert all(len(s) == 1 for s in got.values())
        assert len(got) == len(set(strings))
        assert [strings[i] for i in order] == sorted(strings)


def test_uniform_text():
    codes = np.concatenate([np.ones(300, np.uint16), np.zeros(100, np.uint16)])
    order, number = repeated_classes(codes, 100)
    strings = classes_by_strings(codes, 100)
    assert len(set(number.tolist())) == len(set(strings))


def test_long_text():
    rnd = np.random.default_rng(7)
    half = rnd.integers(1, 5, 1_050_000).astype(np.uint16)
    codes = np.concatenate([half, np.zeros(1, np.uint16), half[:1_049_000], np.zeros(1, np.uint16)])
    order, number = repeated_classes(codes, 100)
    assert len(order) == len(codes) and len(set(order.tolist())) == len(codes)
    at = np.empty(len(codes), np.int64)
    at[order] = number
    second = np.arange(1_049_000 - 99) + len(half) + 1
    assert (at[second] == at[second - len(half) - 1]).all()
    assert len(set(number.tolist())) == len(codes) - len(second)
