"""Exact substring removal with suffix arrays.

A string of ``min_bytes`` bytes that starts at two or more places is a repeat; every byte that a repeat covers goes.
Equal strings share their minimiser (``rolling``), so shards dealt by minimiser (``fragments``) decide alone, byte by
byte; what stands twice as a whole, by its 128-bit digest, is counted there before. Inside a shard the contents stand end to end; its suffix array comes from induced sorting - classify suffixes, sort the leftmost-smaller
(LMS) substrings recursively, induce all others in two linear sweeps - and neighbours' common prefixes from the permuted
array, of which only the irreducible entries are compared and the rest follow by counting down. The sweeps go bucket
by bucket, each bucket as one vector operation.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import same_doc, utf8_parts
from .fragments import distinct_contents, merged_cover, repeats, texts

#: Length of the minimiser's gram in bytes.
GRAM = 24
#: Names at which the recursion ends in prefix doubling.
FEW = 1 << 15
#: Symbols of a shard's text: 0 ends it, 1 ends a part, then the bytes of UTF-8 (at most 0xF4).
SIGMA = 0xF4 + 3


# ---- suffix sorting ------------------------------------------------------------------------------------------------


def _ranked(groups: np.ndarray, n_groups: int) -> tuple[np.ndarray, np.ndarray]:
    """A stable order by group, and each ordered element's rank within its group."""
    order = np.argsort(groups, kind="stable")
    sizes = np.bincount(groups, minlength=n_groups)
    first = np.cumsum(sizes) - sizes
    return order, np.arange(len(groups)) - first[groups[order]]


def _induce(code: np.ndarray, sizes: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """All suffixes in order, induced from the LMS suffixes in the order given. code: 2 * symbol + (1 if S-type)."""
    n, sigma = len(code), len(sizes)
    tails = np.cumsum(sizes)
    heads = tails - sizes
    used = np.flatnonzero(sizes)
    kind = np.uint8 if sigma <= 1 << 8 else np.uint16
    array = np.full(n, -1, np.int32)
    at = (code[lms] >> 1).astype(np.int64)
    count = np.bincount(at, minlength=sigma)
    order, rank = _ranked(at.astype(kind), sigma)
    array[(tails - count)[at[order]] + rank] = lms[order]
    seeds = tails - count
    fill = heads.copy()

    for c in used:  # L-type suffixes, left to right
        parts, done = [], heads[c]
        while done < fill[c]:
            now = array[done : fill[c]]
            done = fill[c]
            before = now[now > 0] - 1
            kinds = code[before]
            same = before[kinds == 2 * c]
            parts.append(before[(kinds > 2 * c) & (kinds & 1 == 0)])
            array[done : done + len(same)] = same
            fill[c] += len(same)
        before = array[seeds[c] : tails[c]]
        before = before[before > 0] - 1
        parts.append(before[code[before] & 1 == 0])
        before = np.concatenate(parts)
        if len(before):
            to = (code[before] >> 1).astype(kind)
            order, rank = _ranked(to, sigma)
            to = to[order]
            array[fill[to] + rank] = before[order]
            fill += np.bincount(to, minlength=sigma)
    ends, fill = fill, tails.copy()
    if sizes[0]:
        fill[0] = 0
    for c in used[::-1]:  # S-type suffixes, right to left
        parts, done = [], tails[c]
        while fill[c] < done and c:
            now = array[fill[c] : done][::-1]
            done = fill[c]
            before = now[now > 0] - 1
            kinds = code[before]
            same = before[kinds == 2 * c + 1]
            parts.append(before[(kinds < 2 * c) & (kinds & 1 == 1)])
            array[done - len(same) : done] = same[::-1]
            fill[c] -= len(same)
        before = array[heads[c] : ends[c]][::-1]
        before = before[before > 0] - 1
        parts.append(before[code[before] & 1 == 1])
        before = np.concatenate(parts)
        if len(before):
            to = (code[before] >> 1).astype(kind)
            order, rank = _ranked(to, sigma)
            to = to[order]
            array[fill[to] - 1 - rank] = before[order]
            fill -= np.bincount(to, minlength=sigma)
    return array


def _doubling(names: np.ndarray) -> np.ndarray:
    """Order of the suffixes of ``names`` by prefix doubling: ends the recursion when names are few, or when naming
    hardly shortens the text."""
    rank, step, n = names.astype(np.int64), 1, len(names)
    while True:
        after = np.full(n, -1, np.int64)
        after[: n - step] = rank[step:]
        order = np.lexsort((after, rank))
        new = np.ones(n, bool)
        new[1:] = (rank[order[1:]] != rank[order[:-1]]) | (after[order[1:]] != after[order[:-1]])
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new) - 1
        if new.all():
            return order
        step *= 2


def suffix_array(text: np.ndarray, sigma: int, before: int = 1 << 62) -> np.ndarray:
    """Suffix array of ``text`` (symbols below ``sigma``) that ends with its only 0."""
    text = np.ascontiguousarray(text, np.int32)
    n = len(text)
    if n == 1:
        return np.zeros(1, np.int32)
    differs = text[1:] != text[:-1]
    nearest = np.flatnonzero(differs)[np.cumsum(differs) - differs]  # the next position whose successor differs
    smaller = np.ones(n, bool)
    smaller[:-1] = text[nearest] < text[nearest + 1]
    code = (text * 2 + smaller).astype(np.uint16 if sigma < 1 << 15 else np.int32)
    sizes = np.bincount(text, minlength=sigma)
    is_lms = np.zeros(n, bool)
    is_lms[1:] = smaller[1:] & ~smaller[:-1]
    lms = np.flatnonzero(is_lms).astype(np.int32)
    m = len(lms)
    if m > 1:
        ordered = _induce(code, sizes, lms)
        ordered = ordered[is_lms[ordered]]
        # equal neighbours get one name; symbols are compared round by round, ended pairs drop out
        stop = np.empty(m, np.int64)
        stop[:-1] = lms[1:]
        stop[-1] = n - 1
        where = np.empty(n, np.int32)
        where[lms] = np.arange(m)
        index = where[ordered]
        length = stop[index] - ordered
        new = np.ones(m, bool)
        pair = np.flatnonzero(length[1:] == length[:-1]) + 1
        step = 0
        while len(pair):
            pair = pair[text[ordered[pair] + step] == text[ordered[pair - 1] + step]]
            over = length[pair] == step
            new[pair[over]] = False
            pair = pair[~over]
            step += 1
        names = np.empty(m, np.int64)
        names[index] = np.cumsum(new) - 1
        k = int(new.sum())
        if k == m:
            lms = ordered
        elif m > 0.9 * before or m <= FEW:
            lms = lms[_doubling(names)]
        else:
            if k <= 1024:
                shorter, digits, radix = names + 1, 1, k
            else:  # two digits a name keep the alphabet, and so the number of buckets, small
                radix = int(np.ceil(np.sqrt(k)))
                shorter, digits = np.empty(2 * m, np.int64), 2
                shorter[::2] = names // radix + 1
                shorter[1::2] = names % radix + 1
            inner = suffix_array(np.append(shorter, 0), radix + 1, m)
            inner = inner[(inner % digits == 0) & (inner < digits * m)] // digits
            lms = lms[inner]
    array = _induce(code, sizes, lms)
    array[0] = n - 1
    return array


def common_prefixes(text: np.ndarray, array: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each suffix with its left neighbour in the suffix array, by text position."""
    n = len(text)
    left = np.full(n, -1, np.int64)
    left[array[1:]] = array[:-1]
    follows = np.zeros(n, bool)  # reducible: one less than the entry before
    at = np.flatnonzero(left > 0)
    at = at[at > 0]
    follows[at] = text[at - 1] == text[left[at] - 1]
    wide = np.zeros(n + 3, np.uint64)
    wide[:n] = text
    four = wide[:n] | wide[1 : n + 1] << np.uint64(16) | wide[2 : n + 2] << np.uint64(32) | wide[3 : n + 3] << np.uint64(48)
    own = np.flatnonzero(~follows & (left >= 0))
    length = np.zeros(n, np.int64)
    a, b, here = own, left[own], own
    step = 0
    while len(here):
        inside = np.maximum(a, b) + step < n
        here, a, b = here[inside], a[inside], b[inside]
        x = four[a + step] ^ four[b + step]
        same = x == 0
        ended = ~same
        low = x[ended]
        length[here[ended]] = step + (low & np.uint64(0xFFFF) == 0) + (low & np.uint64(0xFFFFFFFF) == 0).astype(np.int64) + (low & np.uint64(0xFFFFFFFFFFFF) == 0)
        here, a, b = here[same], a[same], b[same]
        step += 4
        length[here] = step
    anchor = np.where(follows, 0, np.arange(n))
    anchor = np.maximum.accumulate(anchor)
    return length[anchor] - (np.arange(n) - anchor)


def repeated_starts(parts: list[bytes], windows: np.ndarray, copies: np.ndarray, width: int):
    """Runs (part, first window, count) of windows that start at two places at least among ``parts``.

    Only the first ``windows[i]`` positions of part i are window starts; a part with copies > 1 repeats by itself.
    """
    sizes = np.array([len(x) for x in parts])
    begin = np.cumsum(sizes + 1) - sizes - 1
    text = np.ones(int((sizes + 1).sum()) + 1, np.int32)
    joined = np.frombuffer(b"\0".join(parts) + b"\0\0", np.uint8)
    text[:] = joined
    text += 2
    text[begin + sizes] = 1
    text[-1] = 0
    array = suffix_array(text, SIGMA)
    prefixes = common_prefixes(text, array)
    start = np.zeros(len(text) + 1, np.int32)
    start[begin] += 1
    np.add.at(start, begin + windows, -1)
    start = np.cumsum(start[:-1]) > 0
    heavy = np.repeat(np.append(copies > 1, False), np.append(sizes + 1, 1))
    group = np.cumsum(prefixes[array] < width) - 1
    weight = start[array] * (1 + heavy[array])
    repeats = np.zeros(len(text) + 1, bool)
    repeats[array] = (np.bincount(group, weight)[group] >= 2) & start[array]
    edge = np.diff(repeats.astype(np.int8), prepend=0)
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    part = np.searchsorted(begin, first, "right") - 1
    # windows of neighbouring parts never touch: each part ends with width - 1 further bytes
    return part, first - begin[part], last - first


# ---- the operator --------------------------------------------------------------------------------------------------


def _decide(width: int):
    def shard(table: pa.Table) -> pa.Table:
        table = distinct_contents(table)
        copies = table.column("copies").to_numpy()
        part, at, n = repeated_starts(table.column("data").to_pylist(), table.column("windows").to_numpy(), copies, width)
        once = copies[part] == 1  # the others are known to repeat whole
        rows = table.select(["doc_id", "rk", "start"]).take(pa.array(part[once]))
        start = rows.column("start").to_numpy() + at[once]
        return pa.table([rows.column("doc_id"), rows.column("rk"), pa.array(start), pa.array(n[once].astype(np.int32))], names=["doc_id", "rk", "start", "n"])

    return shard


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_bytes: int = 200) -> tuple[DataFrame, DataFrame]:
    """Keyed texts, and for each of them its runs of repeated window starts: (doc_id, rk, spans: array of (start, n))."""
    keyed = texts(docs, id_col, text_col)
    placed = repeats(keyed, min_bytes, min(GRAM, min_bytes), False, _decide(min_bytes), ordered=False)
    return keyed, placed.groupBy("doc_id", "rk").agg(F.collect_list(F.struct("start", "n")).alias("spans"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_bytes: int = 200, with_kept: bool = True) -> DataFrame:
    """Remove every byte covered by a ``min_bytes``-byte string that also starts anywhere else, same document included.

    Returns one row per input row: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), removed (the runs as
    (start, length) in bytes), kept_sha256 and, if ``with_kept``, kept (binary: what remains may cut characters).

    Null text counts as empty; texts shorter than ``min_bytes`` are never cut. Rows that repeat an id are separate
    documents; rows equal in id and text get equal results, each counting as a copy of the other. A null id is a
    document of its own. An empty table gives an empty result; further columns are not read.
    """
    keyed, spans = repeated_spans(docs, id_col, text_col, min_bytes)
    joined = keyed.join(spans, same_doc(keyed, spans), "left").select(keyed["doc_id"], "text", "spans")
    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("removed", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))), ("kept_sha256", pa.string())]
    names = "doc_id long, n_bytes long, n_removed long, n_spans long, removed array<struct<start: long, length: long>>, kept_sha256 string"
    if with_kept:
        fields.append(("kept", pa.binary()))
        names += ", kept binary"

    def apply(batches):
        for batch in batches:
            raw, offsets = utf8_parts(batch.column("text"))
            rows = []
            spans = batch.column("spans")
            for doc in range(batch.num_rows):
                part = raw[offsets[doc] : offsets[doc + 1]]
                kept, runs = part, []
                if spans[doc].is_valid:
                    own = spans.slice(doc, 1).flatten()
                    at = own.field(0).to_numpy()
                    begin, end = merged_cover(len(part), at, at + own.field(1).to_numpy() + min_bytes - 1)
                    runs = [{"start": a, "length": b - a} for a, b in zip(begin.tolist(), end.tolist())]
                    edge = np.zeros(len(part) + 1, np.int8)
                    edge[begin] += 1
                    edge[end] -= 1
                    kept = part[np.cumsum(edge[:-1]) == 0]
                kept = kept.tobytes()
                rows.append((len(part), len(part) - len(kept), len(runs), runs, hashlib.sha256(kept).hexdigest(), kept))
            columns = list(zip(*rows)) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id")] + [pa.array(c, f[1]) for c, f in zip(columns, fields[1:])], names=[f[0] for f in fields]
            )

    return joined.mapInArrow(apply, names)
