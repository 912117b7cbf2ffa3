"""Vectorised rolling hashes and content-defined window runs.

A *window* is ``width`` consecutive symbols (bytes or words) of one document. Each window is assigned the smallest
hash among its ``gram``-symbol sub-strings (its minimiser). Equal windows have equal minimisers wherever they stand,
so windows that could be equal always meet under one key. Consecutive windows with one minimiser form a *run*; a run
of n windows spans n + width - 1 symbols.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)
BYTE_VALUES = np.random.default_rng(20240917).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values, so that order and low bits look random."""
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(33)
    return x


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, 2 * len(_powers))
        for name, factor in (("_powers", _BASE), ("_inverses", _INVERSE)):
            steps = np.full(size, factor, np.uint64)
            steps[0] = 1
            globals()[name] = np.cumprod(steps)
    return _powers, _inverses


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums of values * base**i (mod 2**64); ``span_hash`` reads hashes of any span off them."""
    powers, _ = _tables(len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers[: len(values)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, inverses = _tables(len(sums))
    return mixed((sums[end] - sums[start]) * inverses[start] + (end - start).astype(np.uint64))


def gram_hash(sums: np.ndarray, width: int) -> np.ndarray:
    """Hash of every ``width`` consecutive symbols."""
    n = len(sums) - width
    _, inverses = _tables(len(sums))
    return mixed((sums[width:] - sums[:-width]) * inverses[:n])


def sliding(a: np.ndarray, width: int, op) -> np.ndarray:
    """op over every ``width`` consecutive values, by doubling."""
    span = 1
    while span * 2 <= width:
        a = op(a[:-span], a[span:])
        span *= 2
    if span < width:
        a = op(a[: len(a) - (width - span)], a[width - span :])
    return a


def window_runs(values: np.ndarray, offsets: np.ndarray, width: int, gram: int):
    """Runs of all documents whose symbols stand end to end in ``values`` with bounds ``offsets``.

    Returns arrays (start, windows, minimiser, spot, weight) over the runs; start and spot, where the minimiser stands
    first, are indices into ``values``. weight is 2 where it stands more than once inside the run (windows of one run may
    then be equal).
    """
    n = len(values)
    empty = np.zeros(0, np.int64)
    starts, lengths = offsets[:-1], np.diff(offsets)
    long_enough = lengths >= width
    if not long_enough.any():
        return empty, empty, empty.astype(np.uint64), empty, empty
    sums = prefix(values)
    grams = gram_hash(sums, gram)
    reach = width - gram + 1
    lowest = sliding(grams, reach, np.minimum)  # one for each window start
    total = n - width + 1
    edges = np.zeros(total + 1, np.int32)
    np.add.at(edges, starts[long_enough], 1)
    np.add.at(edges, (starts + lengths - width + 1)[long_enough], -1)
    valid = np.cumsum(edges[:-1]) > 0
    change = np.ones(total + 1, bool)
    change[1:-1] = lowest[1:] != lowest[:-1]
    change[1:-1] |= valid[1:] != valid[:-1]
    first = np.flatnonzero(change[:-1] & valid)
    last = np.flatnonzero(change[1:] & valid)
    windows = last - first + 1
    keys = lowest[first]
    # gram positions that are a minimiser of some window
    pad = np.zeros(reach - 1, np.uint64)
    highest = sliding(np.concatenate([pad, lowest, pad]), reach, np.maximum)
    anchors = np.flatnonzero(highest == grams)
    low = np.searchsorted(anchors, first)
    high = np.searchsorted(anchors, last + reach)
    weight, spot = np.zeros(len(first), np.int64), first.copy()
    active = np.arange(len(first))
    values_at = grams[anchors]
    while len(active):
        active = active[(low[active] < high[active]) & (weight[active] < 2)]
        met = values_at[low[active]] == keys[active]
        new = active[met & (weight[active] == 0)]
        spot[new] = anchors[low[new]]
        weight[active] += met
        low[active] += 1
    return first, windows, keys, spot, np.maximum(weight, 1)


def chunks(offsets: np.ndarray, limit: int, overlap: int | None):
    """Cut documents into work units of about ``limit`` symbols; a longer document is cut into pieces that share
    ``overlap`` symbols, so every window still stands whole in exactly one piece. Without ``overlap`` none is cut.

    Yields (document numbers, piece starts, piece ends, start of the piece within its document).
    """
    docs: list[int] = []
    begin: list[int] = []
    end: list[int] = []
    size = 0
    for doc in range(len(offsets) - 1):
        at, stop = int(offsets[doc]), int(offsets[doc + 1])
        if stop - at <= (overlap or 0):
            continue
        while True:
            cut = stop if overlap is None else min(stop, at + limit)
            if cut < stop and stop - cut <= overlap:
                cut = stop
            docs.append(doc)
            begin.append(at)
            end.append(cut)
            size += cut - at
            if size >= limit:
                yield np.array(docs), np.array(begin), np.array(end)
                docs, begin, end, size = [], [], [], 0
            if cut == stop:
                break
            at = cut - overlap
    if docs:
        yield np.array(docs), np.array(begin), np.array(end)


def gathered(symbols: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of all pieces end to end, and their bounds."""
    offsets = np.zeros(len(begin) + 1, np.int64)
    np.cumsum(end - begin, out=offsets[1:])
    if len(begin) and (begin[1:] == end[:-1]).all():
        return symbols[begin[0] : end[-1]], offsets
    return np.concatenate([symbols[a:b] for a, b in zip(begin, end)]), offsets


def word_bounds(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words (maximal runs of bytes other than the six blanks) of documents that stand end to end in ``raw``.

    Returns word starts, word ends, and the bounds of each document in the list of words.
    """
    letter = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    flag = np.zeros(len(raw) + 1, bool)
    flag[:-1] = letter
    before = np.zeros(len(raw) + 1, bool)
    before[1:] = letter
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    start = np.flatnonzero(flag & (~before | edge))
    end = np.flatnonzero(before & (~flag | edge))
    return start, end, np.searchsorted(start, offsets)


def word_values(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word."""
    return span_hash(prefix(BYTE_VALUES[raw]), start, end)
