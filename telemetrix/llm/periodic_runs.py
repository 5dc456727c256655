"""Maximal periodic runs of words, by the branching-tandem test on an enhanced suffix array.

A run is a stretch of consecutive words with smallest period q (words q apart are the same) and a length of at least
``min_length`` and 2q that no neighbouring word extends keeping period q.

Several documents are numbered into one array of symbols; each has symbols of its own and ends with a separator, so equal
stretches never cross documents. Prefix doubling gives the rank of every stretch of 1, 2, 4, .. words, and with it the
suffix array, its inverse and the common prefixes of neighbours. Each boundary of the suffix array with a common prefix of
d words splits the interval of suffixes that share those words in two; of the smaller side every suffix i is asked whether
the suffix i + d or i - d (by the inverse suffix array) stands on the other side: if so, a square with root length d starts
at the earlier one, and cannot be moved one word to the right. All other squares are these moved left, so moving
each as far left as it goes, in steps that halve, gives its run; several squares of one run differ in their
periods only, and the smallest is its period. Smaller sides bound the questions by n log n; no tree is built.

Documents are rows, and a task holds one block of about ``BLOCK_WORDS`` words, or one longer document. Nothing is
shuffled, so neither copies nor a hot source matter.

Edge cases: null and empty texts, and texts of white space, have no words and no runs, and collapse to the empty text.
Texts of any length are taken whole, in memory of some 100 bytes a word. Repeated rows each get their result; columns of
any names and types pass through; no rows give no rows. Ties do not arise: runs differ in start or end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from telemetrix.llm.common import parts, ranges, wrap

MIN_LENGTH = 12
BLOCK_WORDS = 1 << 17
ASKED = 1 << 20  # suffixes asked at a time


def stretch_ranks(codes: np.ndarray) -> list[np.ndarray]:
    """Ranks of the stretches of 1, 2, 4, .. symbols at each place: equal ranks, equal stretches. The last are all distinct.

    The last symbol, and one after each stretch that occurs twice, must occur once. A rank is the number of smaller
    stretches, so a place whose stretch is unique has its final rank and is not sorted again.
    """
    count = np.bincount(codes)
    rank = (np.cumsum(count) - count)[codes].astype(np.int32)
    levels, open_ = [rank], np.flatnonzero(count[codes] > 1)
    bits = np.uint64(max(1, len(codes).bit_length()))
    width = 1
    while len(open_):
        first, second = rank[open_].astype(np.uint64), rank[open_ + width].astype(np.uint64)
        if 3 * int(bits) <= 64:
            key = np.sort(((first << bits | second) << bits) | open_.astype(np.uint64))
            place = (key & np.uint64((1 << int(bits)) - 1)).astype(np.int64)
            pair = key >> bits
        else:
            pair = first << np.uint64(32) | second
            order = np.argsort(pair, kind="stable")
            place, pair = open_[order], pair[order]
        first = rank[place]
        new = np.concatenate(([True], pair[1:] != pair[:-1]))
        at = np.arange(len(place), dtype=np.int64)
        group = np.maximum.accumulate(np.where(np.concatenate(([True], first[1:] != first[:-1])), at, 0))
        rank = rank.copy()
        rank[place] = first + (np.maximum.accumulate(np.where(new, at, 0)) - group).astype(np.int32)
        levels.append(rank)
        single = new & np.concatenate((new[1:], [True]))
        open_ = place[~single]
        width *= 2
    return levels


def common_prefixes(levels: list[np.ndarray], order: np.ndarray) -> np.ndarray:
    """Symbols that each suffix shares with the one before it in suffix order."""
    lcp = np.zeros(len(order), np.int32)
    at = np.flatnonzero(levels[0][order[1:]] == levels[0][order[:-1]]) + 1
    a, b, shared = order[at - 1], order[at], np.zeros(len(at), np.int64)
    for k in range(len(levels) - 2, -1, -1):
        shared += (levels[k][a + shared] == levels[k][b + shared]).astype(np.int64) << k
    lcp[at] = shared
    return lcp


def interval_sides(lcp: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For boundaries ``at`` the first row of the left side and the last row of the right side of their interval.

    The left side reaches back to the last boundary with a common prefix that is no longer, the right side on to the first with
    a shorter one, so an interval of several children is split child by child. Found by halving steps over range minima.
    """
    n, value = len(lcp), lcp[at]
    longest = np.diff(np.flatnonzero(np.concatenate(([True], lcp == 0, [True])))).max(initial=1)
    minima = [np.concatenate((lcp, np.zeros(1, lcp.dtype)))]
    while (1 << len(minima)) <= longest:
        step, last = 1 << (len(minima) - 1), minima[-1]
        minima.append(np.minimum(last, np.concatenate((last[step:], np.zeros(min(step, len(last)), lcp.dtype)))))
    left, right = at.copy(), at.copy()
    for k in range(len(minima) - 1, -1, -1):
        step = 1 << k
        back = np.maximum(left - step, 0)
        left = np.where(minima[k][back] > value, back, left)
        ahead = np.minimum(right + 1, n)
        right = np.where(minima[k][ahead] >= value, right + step, right)
    return left - 1, right


def branching_squares(levels: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Start and root length of every square that the next symbol ends."""
    place = levels[-1].astype(np.int64)  # the inverse suffix array
    n = len(place)
    order = np.empty(n, np.int64)
    order[place] = np.arange(n)
    lcp = common_prefixes(levels, order)
    at = np.flatnonzero(lcp)
    if not len(at):
        return at, at
    left, right = interval_sides(lcp, at)
    less = at - left <= right - at + 1
    start, size = np.where(less, left, at), np.where(less, at - left, right - at + 1)
    low, high = np.where(less, at, left), np.where(less, right, at - 1)  # the other side
    done, cuts = np.cumsum(size), [0]
    while cuts[-1] < len(at):
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(done, (done[cuts[-1] - 1] if cuts[-1] else 0) + ASKED, "right"))))
    starts, roots = [], []
    for a, b in zip(cuts, cuts[1:]):
        b = min(b, len(at))
        which = np.repeat(np.arange(a, b), size[a:b])
        i, depth = order[ranges(start[a:b], size[a:b])], lcp[at[which]].astype(np.int64)
        after = place[np.minimum(i + depth, n - 1)]
        hit = (after >= low[which]) & (after <= high[which])
        starts.append(i[hit])
        roots.append(depth[hit])
        before = place[np.maximum(i - depth, 0)]
        hit = (i >= depth) & (before >= low[which]) & (before <= high[which])
        starts.append((i - depth)[hit])
        roots.append(depth[hit])
    return np.concatenate(starts), np.concatenate(roots)


def find_runs(codes: np.ndarray, min_length: int = MIN_LENGTH) -> np.ndarray:
    """Rows of start, length and period of all runs, by start and period; ``codes`` as for ``stretch_ranks``."""
    levels = stretch_ranks(codes)
    at, root = branching_squares(levels)
    end = at + 2 * root
    for k in range(len(levels) - 2, -1, -1):  # move left
        step = 1 << k
        back = np.maximum(at - step, 0)
        at = np.where((at >= step) & (levels[k][back] == levels[k][back + root]), back, at)
    long = end - at >= min_length
    at, end, root = at[long], end[long], root[long]
    by = np.lexsort((root, end, at))
    at, end, root = at[by], end[by], root[by]
    first = np.ones(len(at), bool)
    first[1:] = (at[1:] != at[:-1]) | (end[1:] != end[:-1])
    out = np.stack((at, end - at, root), axis=1)[first]
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def _block(words: list[list[bytes]], min_length: int) -> tuple[list[np.ndarray], list[bytes]]:
    """Runs and collapsed text of each of some documents."""
    codes, starts, top, size = [], [], 0, 0
    for doc in words:
        seen: dict[bytes, int] = {}
        number = seen.setdefault
        own = np.fromiter((number(w, len(seen)) for w in doc), np.int64, len(doc))
        codes += [own + top, np.array([top + len(seen)])]
        starts.append(size)
        top, size = top + len(seen) + 1, size + len(doc) + 1
    found = find_runs(np.concatenate(codes), min_length)
    cut = np.searchsorted(found[:, 0], [*starts, size])
    runs, texts = [], []
    for k, doc in enumerate(words):
        own = found[cut[k]:cut[k + 1]] - [starts[k], 0, 0]
        runs.append(own)
        if len(own):
            cover = np.zeros(len(doc) + 1, np.int64)
            np.add.at(cover, own[:, 0] + own[:, 2], 1)
            np.add.at(cover, own[:, 0] + own[:, 1], -1)
            doc = [doc[i] for i in np.flatnonzero(np.cumsum(cover[:-1]) == 0).tolist()]
        texts.append(b" ".join(doc))
    return runs, texts


def _find(batches: Iterator[pa.RecordBatch], min_length: int) -> Iterator[pa.RecordBatch]:
    kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    for batch in parts(batches):
        words = [(t or b"").split() for t in batch.column("text").cast(pa.binary()).to_pylist()]
        runs, texts, first, size = [], [], 0, 0
        for k, doc in enumerate(words):
            size += len(doc)
            if size >= BLOCK_WORDS or k == len(words) - 1:
                more = _block(words[first:k + 1], min_length)
                runs += more[0]
                texts += more[1]
                first, size = k + 1, 0
        flat = np.concatenate(runs) if runs else np.empty((0, 3), np.int64)
        ends = np.cumsum([0, *map(len, runs)])
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(
            [pa.array(flat[:, i]) for i in range(3)], fields=list(kind)))
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), pa.array([len(d) for d in words], pa.int64()), lists, pa.array(texts, pa.binary()).cast(pa.string())],
            ["row", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, text: str = "text", min_length: int = MIN_LENGTH) -> DataFrame:
    """The rows of ``docs`` as struct ``row`` (see ``common.wrap``) with n_words, runs (start, length, period; by start,
    then period) and collapsed: the words, joined by a space, without what a run holds after its first period."""
    frame = wrap(docs, text=text)
    shape = f"row {frame.schema['row'].dataType.simpleString()}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return frame.mapInArrow(lambda batches: _find(batches, min_length), shape)
