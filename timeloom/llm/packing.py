"""Best-fit packing of token pieces into sequences, improved by swap-based local search.

Pieces are dealt to groups by a hash of their id, so no group depends on one key. In each group pieces go, longest
first, to the fullest bin that holds them; then the search moves and exchanges pieces between underfull bins wherever
that increases the sum of squared fills, which empties the least filled bins into the others. Bins that stay underfull
are opened again and packed together in the next, much smaller round, until one group holds what is left or a round
closes hardly any: what stays open then cannot be filled, and its groups are final.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved
from .tokens import token_pieces

#: Pieces in one group; bounds a task's memory.
GROUP = 40_000
#: A bin with at most this share of its capacity free is closed for good.
CLOSED = 1 / 512
#: Share of a round's pieces that has to be closed for another round to follow.
PROGRESS = 1 / 8


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of piece numbers: longest first, each into the fullest bin that holds it. Bins of equal fill are alike, so
    they are kept by free space, with one bit per free space that occurs."""
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    bins: list[list[int]] = []
    for piece in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[piece])
        fitting = mask >> size
        if fitting:
            gap = size + (fitting & -fitting).bit_length() - 1
            at = free[gap].pop()
            if not free[gap]:
                mask ^= 1 << gap
            bins[at].append(piece)
        else:
            gap, at = capacity, len(bins)
            bins.append([piece])
        gap -= size
        free[gap].append(at)
        mask |= 1 << gap
    return bins


def local_search(bins: list[list[int]], sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Exchanges between underfull bins that increase the sum of squared fills; empty bins go.

    For each underfull bin, fullest first, the exchange that fills it most is looked for among all less filled ones: a
    move of one piece, one piece for one, or two pieces of one bin for one. Every exchange fills the fuller bin further,
    so the sum grows; the search ends when none is left.
    """
    size = sizes.tolist()
    fill = [sum(size[p] for p in b) for b in bins]
    spare = int(capacity * CLOSED)
    changed = True
    while changed:
        changed = False
        under = sorted((at for at in range(len(bins)) if 0 < fill[at] < capacity - spare), key=lambda at: fill[at])
        stock = sorted((size[p], p, at) for at in under for p in bins[at])  # pieces of the bins not yet looked at
        pairs = sorted(x for at in under for x in _pair_sums(bins[at], size, at))  # and their pairs, some out of date
        rank = {at: n for n, at in enumerate(under)}

        def within(low: int, high: int):
            """The largest piece in stock with low < size <= high."""
            n = bisect_right(stock, (high, len(size), 0)) - 1  # noqa: B023
            return stock[n] if n >= 0 and stock[n][0] > low else None  # noqa: B023

        def forgo(p: int, at: int) -> None:
            del stock[bisect_left(stock, (size[p], p, at))]  # noqa: B023

        def pair_within(low: int, high: int, last: int):
            """The two pieces of one bin with the largest low < sum <= high, and the bin."""
            n = bisect_right(pairs, (high, len(bins), 0, 0)) - 1  # noqa: B023
            while n >= 0 and pairs[n][0] > low:  # noqa: B023
                _, at, x, y = pairs[n]  # noqa: B023
                own = {} if rank[at] >= last else {size[p]: p for p in bins[at]}  # noqa: B023
                if x != y and x in own and y in own:
                    return [own[x], own[y]], at
                twice = [p for p in bins[at] if size[p] == x] if x == y and own else []
                if len(twice) > 1:
                    return twice[:2], at
                del pairs[n]  # noqa: B023
                n -= 1
            return None

        for n in range(len(under) - 1, -1, -1):
            target = under[n]
            for p in bins[target]:
                forgo(p, target)
            while 0 < fill[target] < capacity - spare:
                gap = capacity - fill[target]
                found = within(0, gap)
                best = (found[0], [found[1]], found[2], None) if found else (0, [], None, None)  # gain, in, source, out
                for p in {size[p]: p for p in bins[target]}.values():
                    found = within(size[p] + best[0], size[p] + gap)
                    if found:
                        best = (found[0] - size[p], [found[1]], found[2], p)
                for p in {size[p]: p for p in bins[target]}.values():
                    found = pair_within(size[p] + best[0], size[p] + gap, n)
                    if found:
                        best = (sum(size[x] for x in found[0]) - size[p], *found, p)
                gain, pieces, source, out = best
                if not gain:
                    break
                changed = True
                for p in pieces:
                    forgo(p, source)
                    bins[source].remove(p)
                    bins[target].append(p)
                if out is not None:
                    bins[target].remove(out)
                    bins[source].append(out)
                    insort(stock, (size[out], out, source))
                    for x in _pair_sums(bins[source], size, source):
                        if size[out] in x[2:]:
                            insort(pairs, x)
                fill[target] += gain
                fill[source] -= gain
    return [b for b in bins if b]


def _pair_sums(content: list[int], size: list[int], at: int) -> list[tuple[int, int, int, int]]:
    """(sum, bin, first size, second size) of all pairs of different pieces of a bin, equal sizes once."""
    count = Counter(size[p] for p in content)
    sizes = sorted(count)
    return [(x + y, at, x, y) for n, x in enumerate(sizes) for y in (sizes[n:] if count[x] > 1 else sizes[n + 1 :])]


def pack(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    return local_search(best_fit(sizes, capacity), sizes, capacity)


def _fit(columns: list[str], size_col: str, capacity: int, number: int, last: bool):
    """Pack one group; in all rounds but the last, bins that stay underfull are marked to be opened again."""

    def fit(table: pa.Table) -> pa.Table:
        sizes = table.column(size_col).to_numpy()
        key = (number << 56) | (table.column("pack_group")[0].as_py() << 24)
        row, sequence, offset, opened = [], [], [], []
        for n, content in enumerate(pack(sizes, capacity)):
            at = 0
            for p in content:
                row.append(p)
                sequence.append(key | n)
                offset.append(at)
                at += int(sizes[p])
            opened += [not last and capacity - at > capacity * CLOSED] * len(content)
        out = table.select(columns).take(pa.array(row))
        out = out.append_column("sequence_id", pa.array(sequence, pa.int64()))
        return out.append_column("offset", pa.array(offset, pa.int64())).append_column("pack_open", pa.array(opened, pa.bool_()))

    return fit


def pack_pieces(pieces: DataFrame, capacity: int = 4096, size_col: str = "length", group_rows: int = GROUP) -> DataFrame:
    """Add sequence_id and offset to pieces with a size between 1 and ``capacity``; offsets of a sequence are gapless.

    Rounds follow one another while each closes PROGRESS of its pieces at least, so they end for any sizes. Sequence ids
    are numbers without further meaning. Extra columns stay, but one called sequence_id or offset is an error. Repeated
    rows are pieces of their own; ties in size go by the order of rows. An empty table gives an empty one.
    """
    columns = pieces.columns
    if {"sequence_id", "offset", "pack_group", "pack_open"} & set(columns):
        raise ValueError("sequence_id, offset, pack_group and pack_open are names of the result")
    own = pieces.schema
    pieces = saved(pieces, "pieces")
    done: list[DataFrame] = []
    rest, number = pieces, 0
    while True:
        count = rest.count()
        groups = -(-count // group_rows)
        if not groups:
            break
        last = groups == 1
        ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own) + ", sequence_id long, offset long, pack_open boolean"
        # by the place in the saved table, so that rows that repeat are dealt to many groups like others
        dealt = rest.withColumn("pack_group", F.pmod(F.xxhash64(F.lit(number), F.monotonically_increasing_id()), F.lit(groups)))
        packed = dealt.groupBy("pack_group").applyInArrow(_fit(columns, size_col, capacity, number, last), ddl)
        if last:
            done.append(packed.drop("pack_open"))
            break
        packed = saved(packed, "packed")
        if packed.where("pack_open").count() > (1 - PROGRESS) * count:
            done.append(packed.drop("pack_open"))
            break
        done.append(packed.where("not pack_open").drop("pack_open"))
        rest, number = packed.where("pack_open").select(columns), number + 1
    if not done:
        return pieces.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int = 1, capacity: int = 4096, with_ids: bool = False) -> DataFrame:
    """Tokenise documents and pack them into sequences of at most ``capacity`` ids.

    One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids if asked for). Documents
    of at most ``capacity`` ids stay whole; longer ones are cut into full pieces and a last one. Null text is empty;
    an empty text is its end id alone. Every row is a document of its own, also if it repeats an id. An empty table
    gives an empty result; further columns are not read.
    """
    return pack_pieces(token_pieces(docs, id_col, text_col, path, end_id, capacity, with_ids), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed ids themselves: (sequence_id, ids), pieces in the order of their offsets. A sequence is bounded."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(ordered, lambda x: x["ids"])).alias("ids"))
