"""Repeated strings of a bounded text by threshold-bounded interval expansion on its Burrows-Wheeler transform."""

from __future__ import annotations

import numpy as np

from telemetrix.llm.common import ranges


def suffix_order(codes: np.ndarray, depth: int) -> np.ndarray:
    """Starts of the suffixes in the order of their first ``depth`` symbols, by prefix doubling.

    Ranks and positions are packed into one word and sorted by value; beyond two million symbols, where they do not
    fit, pairs of ranks are sorted indirectly. Past the end stand symbols 0.
    """
    n = len(codes)
    at = np.arange(n, dtype=np.uint64)
    bits, place = max(1, int(codes.max(initial=0)).bit_length()), max(1, n.bit_length())
    packed = 3 * place <= 64
    reach = min((64 - place) // bits, depth)
    padded = np.concatenate((codes, np.zeros(reach, codes.dtype))).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for j in range(reach):
        key = key << np.uint64(bits) | padded[j:j + n]
    low = np.uint64((1 << place) - 1)
    while True:
        if packed:
            key <<= np.uint64(place)
            key |= at
            key.sort()
            order = (key & low).astype(np.int64)
            key >>= np.uint64(place)
        else:
            order = np.argsort(key)
            key = key[order]
        rank = np.empty(n, np.uint64)
        step = np.concatenate(([1], (key[1:] != key[:-1]).astype(np.uint64)))
        ranked = np.cumsum(step, dtype=np.uint64)
        rank[order] = ranked
        if reach >= depth or ranked[-1] == n:
            return order
        more = min(reach, depth - reach)
        key = rank << np.uint64(place)
        key[:n - more] |= rank[more:]
        reach += more


def transform(codes: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The Burrows-Wheeler transform: the symbol before each suffix, in suffix order."""
    return codes[order - 1]


def boundaries(bwt: np.ndarray, depth: int) -> np.ndarray:
    """Where suffixes of a transform differ from the one before in their first ``depth`` symbols.

    Breadth-first backward extension: an interval holds the suffixes that begin with some string w, and extending w to
    the left by a symbol c leads, through the transform, to the interval of cw. The right end of an interval first
    reached with a string of length l is a place whose common prefix with its neighbour is l - 1, so
    the common prefixes come in increasing order; the search stops at ``depth``, and places still open share at least so
    many symbols. Only intervals whose right end is new are extended, so each place is set once.
    """
    n = len(bwt)
    source = np.argsort(bwt, kind="stable")  # row of c + suffix -> row of the suffix
    target = np.empty(n, np.int64)
    target[source] = np.arange(n)
    found = np.zeros(n + 1, bool)
    found[0] = found[n] = True
    end = np.full(n, n, np.int64)  # right end of the interval that holds a row
    begin = np.zeros(n + 1, np.int64)  # left end of the interval with this right end
    symbols = bwt[source]
    new = np.flatnonzero(symbols[1:] != symbols[:-1]) + 1  # strings of length 1
    found[new] = True
    last = True  # the interval that ends at n is new, too
    for _ in range(1, depth):
        # cut the intervals at the new places
        holder = end[new]
        first = np.concatenate(([True], holder[1:] != holder[:-1])) if len(new) else np.empty(0, bool)
        left = np.where(first, begin[holder], np.concatenate(([0], new[:-1])) if len(new) else new)
        begin[new] = left
        begin[holder] = new  # the last new place of each holder stays
        size = new - left
        if last:
            new_, left_, size_ = np.append(new, n), np.append(left, begin[n]), np.append(size, n - begin[n])
            last = False
        else:
            new_, left_, size_ = new, left, size
        rows = ranges(left_, size_)
        end[rows] = np.repeat(new_, size_)
        # extend to the left: neighbours in the row order whose sources have come apart
        after = target[rows] + 1
        open_ = ~found[after]
        rows, after = rows[open_], after[open_]
        apart = end[rows] != end[source[after]]
        new = np.sort(after[apart])
        if not len(new):
            break
        found[new] = True
    return found[:n]


def repeated_classes(codes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all suffixes in suffix order, and the number of the class of equal first ``length`` symbols.

    Past the end stand symbols 0. The transform is that of a ring, so ``length`` of them go in front.
    """
    ring = np.concatenate((np.zeros(length, codes.dtype), codes))
    order = suffix_order(ring, length)
    number = np.cumsum(boundaries(transform(ring, order), length)) - 1
    real = order >= length
    return order[real] - length, number[real]
