"""What timeline operators share: rows of one media in their order, and scans that cut a media into blocks.

A block is ``BLOCK`` numbers of ``seq`` of one media. Rules that carry a state from row to row run block by block: each
block says in a few numbers what it makes of any state it may be entered with, these are chained per media, and the
blocks run again from the state they are really entered with. So a media of any length spreads over many tasks, and work
is linear in its rows. Both passes read one exchange; only media of more than one block are chained.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StringType, StructField, StructType

#: Numbers of seq in a block: bounds what a task holds, never changes a result.
BLOCK = 4096
KEY = ["media_id", "block"]
#: Blocks described in one Arrow batch.
TOLD = 256


def in_order() -> WindowSpec:
    """Every operator keys rows by media_id and orders them by seq, so their windows share one exchange and sort."""
    return Window.partitionBy("media_id").orderBy("seq")


def before() -> WindowSpec:
    return in_order().rowsBetween(Window.unboundedPreceding, -1)


def renumbered(rows: DataFrame, *order: str) -> DataFrame:
    """seq from 1 within each media, by ``order``."""
    return rows.withColumn("seq", F.row_number().over(Window.partitionBy("media_id").orderBy(*order)).cast("long"))


def interval_cells(rows: DataFrame, base_s: float, start: str = "start_s", end: str = "end_s") -> DataFrame:
    """Rows once for each cell their interval touches: a cell is (level, cell) with a width of ``base_s`` times a power of
    two, and an interval belongs to the first level as wide as itself, so it touches two cells at most, however long."""
    level = F.greatest(F.lit(0), F.coalesce(F.ceil(F.log2((F.col(end) - F.col(start)) / base_s)), F.lit(0))).cast("int")
    rows = rows.withColumn("level", level)
    width = F.lit(base_s) * F.pow(F.lit(2.0), F.col("level"))
    first, final = (F.floor(F.col(c) / width) for c in (start, end))
    return rows.withColumn("cell", F.explode(F.sequence(first, F.greatest(first, final))))


def point_cells(rows: DataFrame, cells: DataFrame, base_s: float, at: str) -> DataFrame:
    """Rows once for each level that ``cells`` of ``interval_cells`` has in their media, with the cell of ``at``: a point
    meets each interval around it in exactly one cell."""
    levels = cells.select("media_id", "level").distinct()
    return rows.join(levels, "media_id").withColumn("cell", F.floor(F.col(at) / (F.lit(base_s) * F.pow(F.lit(2.0), F.col("level")))))


# ---- blocks --------------------------------------------------------------------------------------------------------


def in_blocks(rows: DataFrame) -> DataFrame:
    return rows.withColumn("block", F.floor(F.col("seq") / BLOCK)).repartition(*KEY)


def numbered_in_blocks(rows: DataFrame) -> DataFrame:
    """Rows with place, their number from 1 within the media: rows of a block are numbered by themselves, and one row a
    block goes through a window of the media."""
    blocks = in_blocks(rows)
    past = Window.partitionBy("media_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.groupBy(*KEY).agg(F.count("*").alias("rows")).select(*KEY, F.coalesce(F.sum("rows").over(past), F.lit(0)).alias("offset"))
    at = F.row_number().over(Window.partitionBy(*KEY).orderBy("seq"))
    return blocks.join(offsets, KEY).withColumn("place", (F.col("offset") + at).cast("long")).drop("offset", "block")


def _whole_blocks(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[dict, list]]:
    """(media_id and block, columns) of one whole block after the other; ``at`` is 1 in its first row."""
    key, parts = None, []
    for batch in batches:
        firsts = np.flatnonzero(batch.column("at").to_numpy() == 1).tolist()
        columns = [batch.column(n) for n in names]
        columns = [c.to_pylist() if pa.types.is_string(c.type) else c.to_numpy(zero_copy_only=False) for c in columns]
        for a, b in zip([0, *firsts], [*firsts, batch.num_rows]):
            if a == b:
                continue
            if a in firsts[:1] or a > 0:
                if parts:
                    yield key, _together(parts)
                key, parts = {n: batch.column(n)[a].as_py() for n in KEY}, []
            parts.append([c[a:b] for c in columns])
    if parts:
        yield key, _together(parts)


def _together(parts: list[list]) -> list:
    if len(parts) == 1:
        return parts[0]
    return [sum(c, []) if isinstance(c[0], list) else np.concatenate(c) for c in zip(*parts)]


def scanned(rows: DataFrame, rule, adds: list[StructField], drop: list[str] = ()) -> DataFrame:
    """Rows that ``rule`` has run over in the order of seq within their media, with the fields it ``adds`` and without
    the columns to ``drop``.

    A rule names the ``columns`` it reads. ``profile`` gets a block's columns and returns (numbers, words), whatever its
    ``chain`` makes of them: that gets (block, numbers, words) of a media in order and yields, from the second block on,
    (block, numbers, word) of the state the block is entered with. ``run`` gets batches of whole partitions with at, 1 in
    the first row of each block, and entry, the state or null, and yields (batch, arrays of the fields)."""
    blocks = in_blocks(rows)
    blocks = blocks.withColumn("at", F.row_number().over(Window.partitionBy(*KEY).orderBy("seq")))
    key = [StructField("media_id", rows.schema["media_id"].dataType), StructField("block", LongType())]
    told = StructType([*key, StructField("numbers", ArrayType(DoubleType())), StructField("words", ArrayType(StringType()))])
    states = StructType([*key, StructField("numbers", ArrayType(DoubleType())), StructField("word", StringType())])
    arrow_told, arrow_states = to_arrow_schema(told), to_arrow_schema(states)

    def profiles(batches):
        found = []
        for own, values in _whole_blocks(batches, rule.columns):
            numbers, words = rule.profile(values)
            found.append({**own, "numbers": numbers, "words": words})
            if len(found) == TOLD:
                yield pa.RecordBatch.from_pylist(found, schema=arrow_told)
                found = []
        yield pa.RecordBatch.from_pylist(found, schema=arrow_told)

    def chained(table: pa.Table) -> pa.Table:
        media = table.column("media_id")[0].as_py()
        blocks = sorted(zip(*(table.column(c).to_pylist() for c in ("block", "numbers", "words"))), key=lambda b: b[0])
        return pa.Table.from_pylist([{"media_id": media, "block": b, "numbers": n, "word": w} for b, n, w in rule.chain(blocks)], schema=arrow_states)

    def run(batches):
        for batch, new in rule.run(batches):
            yield pa.RecordBatch.from_arrays([batch.column(f.name) for f in kept] + new, names=[f.name for f in kept] + [f.name for f in adds])

    described = blocks.mapInArrow(profiles, told)  # all columns: with fewer, the exchange and all before it would be made twice
    several = described.withColumn("blocks", F.count("*").over(Window.partitionBy("media_id"))).where("blocks > 1").drop("blocks")
    entries = several.groupBy("media_id").applyInArrow(chained, states).select(*KEY, F.struct("numbers", "word").alias("entry"))
    entered = blocks.join(entries, KEY, "left").sortWithinPartitions(*KEY, "seq")
    kept = [f for f in rows.schema.fields if f.name not in drop]
    return entered.mapInArrow(run, StructType(kept + list(adds)))


# ---- greedy groups -------------------------------------------------------------------------------------------------


@dataclass
class Greedy:
    """Rows join the open group until one breaks it: one that starts more than ``gap`` after the row before ends, that
    follows a row which stops, that ends more than ``longest`` after the group starts, or with which a size of the group
    would exceed its limit in ``most``. With ``glue`` a row that starts before the one before ends never breaks. A row
    adds its sizes to the group, one more to the first if its head meets the tail of the row before."""

    gap: float
    longest: float
    most: list[int]
    glue: bool = False

    def __post_init__(self) -> None:
        self.sizes = range(len(self.most))
        self.columns = ["g_start", "g_end", "g_stop", "g_head", "g_tail", *[f"g_size{k}" for k in self.sizes]]

    # -- one block, entered with any state

    def _next(self, at: int) -> int:
        """The row that breaks a group which starts at ``at``, or the number of rows."""
        first, step = at + 1, 32
        while first < len(self.start):
            part = slice(first, first + step)
            broken = self.hard[part] | (self.end[part] - self.start[at] > self.longest)
            for k in self.sizes:
                broken |= self.own[k][at] + self.sums[k][part] - self.sums[k][at] > self.most[k]
            broken &= ~self.glued[part]
            if broken.any():
                return first + int(broken.argmax())
            first, step = first + step, step * 8
        return len(self.start)

    def _exit(self, at: int) -> list[float]:
        """Number of groups that start from ``at`` on, if one starts there, and start and sizes of the last."""
        way = []
        while at < len(self.start) and at not in self.known:
            way.append(at)
            at = self._next(at)
        for own in reversed(way):
            if at < len(self.start):
                self.known[own] = [self.known[at][0] + 1, *self.known[at][1:]]
            else:
                self.known[own] = [1.0, float(self.start[own]), *[float(self.own[k][own] + self.sums[k][-1] - self.sums[k][own]) for k in self.sizes]]
            at = own
        return self.known[at]

    def profile(self, values: list) -> tuple[list[float], list[str]]:
        """The block's first and last row, the sizes that rows behind the first add, the exit if a group starts with the
        first row, and row by row (highest end so far, sizes added so far, exit if a group that is open before breaks by
        then) up to where any such group is broken."""
        self.start, self.end, stop, head, tail, *self.own = values
        spaced = np.zeros(len(self.start), np.int64)
        spaced[1:] = head[1:] & tail[:-1]
        self.hard, self.glued = np.zeros(len(self.start), bool), np.zeros(len(self.start), bool)
        self.hard[1:] = (self.start[1:] - self.end[:-1] > self.gap) | stop[:-1]
        self.glued[1:] = (self.start[1:] <= self.end[:-1]) & self.glue
        self.hard &= ~self.glued
        self.sums = []
        for k in self.sizes:
            added = self.own[k] + (spaced if k == 0 else 0)
            added[0] = 0
            self.sums.append(np.cumsum(added))
        self.known: dict[int, list[float]] = {}
        final = self._next(0) if (np.diff(self.start) >= 0).all() else len(self.start)
        found: list[list[float]] = []
        highest, skip = -math.inf, 1 + len(self.most)
        for at in range(1, min(final + 1, len(self.start))):
            if self.glued[at]:
                continue
            highest = math.inf if self.hard[at] else max(highest, float(self.end[at]))
            row = [highest, *[float(s[at]) for s in self.sums], *self._exit(at)]
            if found and found[-1][skip:] == row[skip:]:
                found.pop()  # one exit for both: the later row tells whether it is taken
            found.append(row)
            if self.hard[at] or any(s[at] > m for s, m in zip(self.sums, self.most)):
                break
        edge = [float(self.start[0]), float(self.end[0]), float(head[0]), float(self.end[-1]), float(stop[-1]), float(tail[-1]), *[float(own[0]) for own in self.own]]
        return [*edge, *[float(s[-1]) for s in self.sums], *self._exit(0), *[x for row in found for x in row]], []

    # -- from block to block

    def _breaks(self, state: list, start: float, end: float, head: float, sizes: list) -> tuple[bool, list]:
        """Whether a row breaks the open group, and what it adds to it. ``state``: number, end, stop and tail of the row
        before, start and sizes of the group."""
        _, last_end, stopped, tail, opened, *held = state
        adds = [size + (1 if k == 0 and tail and head else 0) for k, size in enumerate(sizes)]
        if self.glue and start <= last_end:
            return False, adds
        full = any(h + a > m for h, a, m in zip(held, adds, self.most))
        return bool(start - last_end > self.gap or stopped or end - opened > self.longest or full), adds

    def chain(self, blocks: list[tuple[int, list, list]]) -> Iterator[tuple[int, list, None]]:
        size = len(self.most)
        state: list[float] | None = None
        for block, numbers, _ in blocks:
            start, end, head, *edge = numbers[:6]
            own, total, rest = numbers[6 : 6 + size], numbers[6 + size : 6 + 2 * size], numbers[6 + 2 * size :]
            fresh, rows = rest[: 2 + size], rest[2 + size :]
            count = 0.0
            if state is not None:
                yield block, state, None
                count = state[0]
                broken, adds = self._breaks(state, start, end, head, own)
            if state is None or broken:
                state = [count + fresh[0], *edge, *fresh[1:]]
                continue
            opened, held = state[4], [h + a for h, a in zip(state[5:], adds)]
            if opened > start and rows and not math.isinf(self.longest):
                self._in_order(opened - start)
            width = 3 + 2 * size
            for at in range(0, len(rows), width):
                highest, added, exit_ = rows[at], rows[at + 1 : at + 1 + size], rows[at + 1 + size : at + width]
                if highest - opened > self.longest or any(h + a > m for h, a, m in zip(held, added, self.most)):
                    state = [count + exit_[0], *edge, *exit_[1:]]
                    break
            else:
                state = [count, *edge, opened, *[h + t for h, t in zip(held, total)]]

    @staticmethod
    def _in_order(back: float) -> None:
        raise ValueError(f"starts go back by {back} s from one block of a media to the next")

    def run(self, batches):
        """Group numbers, whether a row met its head with the tail before it inside the group, and the first size of the
        group up to each row."""
        state = [0.0, 0.0, 0.0, 0.0, 0.0, *[0] * len(self.most)]
        for batch in batches:
            start, end, stop, head, tail, *sizes = (batch.column(c).to_pylist() for c in self.columns)
            entries = batch.column("entry")
            entered = set(np.flatnonzero(batch.column("at").to_numpy() == 1).tolist())
            numbers, spaced, held = [], [], []
            for n, (a, b, stops, begins, ends, *own) in enumerate(zip(start, end, stop, head, tail, *sizes)):
                fresh = False
                if n in entered:
                    entry = entries[n].as_py()
                    fresh = entry is None
                    state = [0.0, 0.0, 0.0, 0.0, 0.0] if fresh else entry["numbers"]
                broken, adds = (True, own) if fresh else self._breaks(state, a, b, begins, own)
                if broken:
                    state = [state[0] + 1, b, stops, ends, a, *own]
                else:
                    state = [state[0], b, stops, ends, state[4], *[h + x for h, x in zip(state[5:], adds)]]
                numbers.append(int(state[0]))
                spaced.append(not broken and adds != own)
                held.append(int(state[5]) if own else 0)
            yield batch, [pa.array(numbers, pa.int64()), pa.array(spaced, pa.bool_()), pa.array(held, pa.int64())]


def greedy_groups(rows: DataFrame, rule: Greedy, start: Column, end: Column, stop: Column | None = None, head: Column | None = None, tail: Column | None = None, sizes: list[Column] = ()) -> DataFrame:
    """Rows with group, the number of their group from 1 within the media, spaced, whether head and tail met before the
    row inside its group, and held, the first size of the group up to the row. ``start``, ``end`` and sizes (whole
    numbers) must not be null. A media of more than a block must not go back in ``start`` from one block to the next
    within a group, if ``longest`` is finite."""
    known = lambda c: F.lit(False) if c is None else F.coalesce(c, F.lit(False))
    made = {"g_start": start.cast("double"), "g_end": end.cast("double"), "g_stop": known(stop), "g_head": known(head), "g_tail": known(tail)}
    made |= {f"g_size{k}": size.cast("long") for k, size in enumerate(sizes)}
    adds = [StructField("group", LongType()), StructField("spaced", BooleanType()), StructField("held", LongType())]
    return scanned(rows.withColumns(made), rule, adds, drop=rule.columns)


# ---- ends that push on ---------------------------------------------------------------------------------------------

#: More than an end may be off by through rounding.
_SLACK = 1e-6


@dataclass
class PushedOn:
    """Rows (start_s below end_s, neither null nor negative) so that none repeats the text before it and none starts
    before the one before ends; one that would end too early lasts ``sliver``.

    A reach from before pushes rows of a block on by ``sliver`` each until one ends after it; from there on the block is
    what it is anyway. So a block tells where it ends by itself, how many rows it has and which rows can stop a push; its
    first row is told apart, as the text before may be the same."""

    sliver: float
    columns = ["start_s", "end_s", "text"]

    def _step(self, reach: float, a: float, b: float) -> tuple[float, float]:
        a = max(a, reach)
        return a, b if b > a else a + self.sliver

    def profile(self, values: list) -> tuple[list[float], list[str]]:
        starts, ends, texts = values[0].tolist(), values[1].tolist(), values[2]
        kept = [n for n in range(1, len(texts)) if texts[n] != texts[n - 1]]
        reach = 0.0
        for n in kept:
            reach = self._step(reach, starts[n], ends[n])[1]
        room = np.array([ends[n] - self.sliver * at for at, n in enumerate(kept)] or [-math.inf])
        near = np.flatnonzero(room >= room.max() - 2 * _SLACK).tolist() if kept else []
        stops = [x for at in near for x in (float(at), ends[kept[at]])]
        return [starts[0], ends[0], reach, float(len(kept)), float(room.max()), *stops], [texts[0], texts[-1]]

    def chain(self, blocks: list[tuple[int, list, list]]) -> Iterator[tuple[int, list, str]]:
        count, reach, said = 0.0, 0.0, None
        for block, (start, end, own, size, most, *stops), (first, last) in blocks:
            if said is not None:
                yield block, [count, reach], said
            if first != said:
                count, reach = count + 1, self._step(reach, start, end)[1]
            if size:
                reach = own if reach < most - _SLACK else self._pushed(reach, own, size, stops)
            count, said = count + size, last

    def _pushed(self, reach: float, own: float, size: float, stops: list[float]) -> float:
        """The end of a block whose rows may all be pushed on, slivers added one by one as rows do."""
        at = 0
        for n, end in zip(stops[::2], stops[1::2]):
            while at < n:
                reach, at = reach + self.sliver, at + 1
            if end > reach:
                return own
        while at < size:
            reach, at = reach + self.sliver, at + 1
        return reach

    def run(self, batches):
        number, reach, said = 0, 0.0, None
        for batch in batches:
            entries = batch.column("entry")
            entered = set(np.flatnonzero(batch.column("at").to_numpy() == 1).tolist())
            rows, numbers, starts, ends = [], [], [], []
            for n, (a, b, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in self.columns))):
                if n in entered:
                    entry = entries[n].as_py()
                    number, reach, said = (0, 0.0, None) if entry is None else (int(entry["numbers"][0]), entry["numbers"][1], entry["word"])
                if text != said:
                    a, reach = self._step(reach, a, b)
                    number += 1
                    rows.append(n)
                    numbers.append(number)
                    starts.append(a)
                    ends.append(reach)
                said = text
            yield batch.take(pa.array(rows, pa.int64())), [pa.array(numbers, pa.int64()), pa.array(starts, pa.float64()), pa.array(ends, pa.float64())]


def pushed_on(rows: DataFrame, sliver: float) -> DataFrame:
    """Rows by the rule ``PushedOn``, numbered anew: media_id, text, seq, start_s, end_s."""
    adds = [StructField("place", LongType()), StructField("moved_s", DoubleType()), StructField("reach_s", DoubleType())]
    out = scanned(rows, PushedOn(sliver), adds, drop=["start_s", "end_s", "seq"])
    return out.withColumnsRenamed({"place": "seq", "moved_s": "start_s", "reach_s": "end_s"})
