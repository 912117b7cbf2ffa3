"""Exact removal of repeated passages by relative Lempel-Ziv parsing.

A window is ``window_words`` consecutive words. A word goes if a window that covers it repeats one that starts earlier
(smaller id, or earlier in the same document). Runs of windows meet by their minimiser (``fragments``), so each shard's
reference block holds every text that can match inside it. A block lists its contents by first place, numbers their
words, and indexes their windows by exact ranks; each content is parsed greedily against the block: where a window stands
earlier, the factor is extended word by word as far as text and reference agree, all windows inside it are repeats, and
parsing goes on with the windows that cross the factor's boundary. Factors shorter than a window are left as they are.
Later places of a whole content (equal 128-bit digests) are factors known before any text moves.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import same_doc, utf8_parts
from .fragments import distinct_contents, merged_cover, repeats, texts

#: Length of the minimiser's gram in words.
GRAM = 4


def window_ranks(block: np.ndarray, width: int) -> np.ndarray:
    """A number for every ``width`` consecutive symbols, the same for the same symbols only: pairs of numbers of half the
    length are numbered, by doubling."""
    ranks, size = block.astype(np.int64), 1
    while size < width:
        step = min(size, width - size)
        pairs = ranks[:-step] * (int(ranks.max(initial=0)) + 1) + ranks[step:]
        ranks = np.unique(pairs, return_inverse=True)[1]
        size += step
    return ranks


def parse_block(parts: list[np.ndarray], windows: np.ndarray, width: int):
    """Parse each part (an array of word numbers) against the parts and windows before it; parts are in the order of
    their first place.

    Returns runs (part, first window, count) of windows that stand earlier in the block.
    """
    sizes = np.array([len(x) for x in parts])
    begin = np.cumsum(sizes) - sizes
    block = np.concatenate(parts)
    starts = np.concatenate([np.arange(b, b + w) for b, w in zip(begin, windows)])
    keys = window_ranks(block, width)[starts]
    order = np.argsort(keys, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = keys[order[1:]] != keys[order[:-1]]
    earliest = np.empty(len(starts), np.int64)
    earliest[order] = starts[order[np.flatnonzero(new)[np.cumsum(new) - 1]]]
    index = np.full(len(block), -1, np.int64)
    index[starts] = earliest
    ends = begin + sizes
    found: list[tuple[int, int, int]] = []
    seeds = starts[earliest < starts]
    owner = np.searchsorted(begin, seeds, "right") - 1
    bounds = np.searchsorted(owner, np.arange(len(parts) + 1))
    for part in np.unique(owner):
        own = seeds[bounds[part] : bounds[part + 1]]  # where a factor may begin
        last = begin[part] + windows[part] - 1
        at = own[0]
        while True:
            source = index[at]
            stop = ends[np.searchsorted(begin, source, "right") - 1]
            length = min(ends[part] - at, stop - source)
            differ = block[at : at + length] != block[source : source + length]
            length = int(differ.argmax()) if differ.any() else length
            count = min(length - width + 1, last - at + 1)
            found.append((part, at - begin[part], count))
            after = np.searchsorted(own, at + count)  # windows across the boundary are looked up anew
            if after == len(own):
                break
            at = own[after]
    return found


def _parse(width: int):
    def shard(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("rk", "ascending"), ("start", "ascending")])
        if table.column("doc_id").null_count:  # a null id stands before all others
            nulls = table.column("doc_id").is_null().to_numpy()
            table = table.take(pa.array(np.argsort(~nulls, kind="stable")))
        table = distinct_contents(table)
        lists = [data.split() for data in table.column("data").to_pylist()]
        number: dict[bytes, int] = {}
        parts = [np.array([number.setdefault(w, len(number)) for w in own], np.int64) for own in lists]
        found = parse_block(parts, table.column("windows").to_numpy(), width)
        part, at, n = (np.array(x, np.int64) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
        rows = table.select(["doc_id", "rk", "start"]).take(pa.array(part))
        start = rows.column("start").to_numpy() + at
        return pa.table([rows.column("doc_id"), rows.column("rk"), pa.array(start), pa.array(n.astype(np.int32))], names=["doc_id", "rk", "start", "n"])

    return shard


def repeated_windows(docs: DataFrame, id_col: str, text_col: str, window_words: int) -> tuple[DataFrame, DataFrame]:
    """Keyed texts, and for each of them its runs of windows that stand earlier: (doc_id, rk, spans)."""
    keyed = texts(docs, id_col, text_col)
    placed = repeats(keyed, window_words, min(GRAM, window_words), True, _parse(window_words), ordered=True)
    return keyed, placed.groupBy("doc_id", "rk").agg(F.collect_list(F.struct("start", "n")).alias("spans"))


def remove_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window_words: int = 20, with_kept: bool = True) -> DataFrame:
    """Remove every word covered by a ``window_words``-word window whose words also start earlier.

    Words are runs of anything but the six ASCII blanks, compared as they are; earlier means a smaller id, or the same
    document further left. Windows are judged on the input. Returns one row per input row: doc_id, n_words, n_removed,
    removed (maximal runs of removed words as (start, length)), kept_sha256 of the kept words joined by one space and,
    if ``with_kept``, kept (that text).

    Null text counts as having no words; texts shorter than a window are never cut. Rows that repeat an id are separate
    documents, ordered by a hash of their text; rows equal in id and text are one place, so none removes the other. A
    null id stands before all others. An empty table gives an empty result; further columns are not read.
    """
    keyed, spans = repeated_windows(docs, id_col, text_col, window_words)
    joined = keyed.join(spans, same_doc(keyed, spans), "left").select(keyed["doc_id"], "text", "spans")
    fields = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("removed", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))), ("kept_sha256", pa.string())]
    names = "doc_id long, n_words long, n_removed long, removed array<struct<start: long, length: long>>, kept_sha256 string"
    if with_kept:
        fields.append(("kept", pa.string()))
        names += ", kept string"

    def apply(batches):
        for batch in batches:
            raw, offsets = utf8_parts(batch.column("text"))
            data = raw.tobytes()
            spans = batch.column("spans")
            rows = []
            for doc in range(batch.num_rows):
                words = data[offsets[doc] : offsets[doc + 1]].split()
                size, runs = len(words), []
                if spans[doc].is_valid:
                    own = spans.slice(doc, 1).flatten()
                    at = own.field(0).to_numpy()
                    begin, end = merged_cover(size, at, at + own.field(1).to_numpy() + window_words - 1)
                    runs = [{"start": a, "length": b - a} for a, b in zip(begin.tolist(), end.tolist())]
                    for run in reversed(runs):
                        del words[run["start"] : run["start"] + run["length"]]
                kept = b" ".join(words)
                rows.append((size, size - len(words), runs, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace") if with_kept else ""))
            columns = list(zip(*rows)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id")] + [pa.array(c, f[1]) for c, f in zip(columns, fields[1:])], names=[f[0] for f in fields]
            )

    return joined.mapInArrow(apply, names)
