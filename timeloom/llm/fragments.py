"""Candidate search shared by the two exact substring operators (suffix arrays on bytes, factor parsing on words).

Runs of windows (see ``rolling``) are keyed by their minimiser. A minimiser that stands once in the corpus cannot
belong to a repeated window, so only runs under repeated minimisers go on; runs of equal content (equal 128-bit digests)
are then folded into one *content* with a count and its first place, before any text moves. Two contents under one
minimiser share a window only if they agree in the minimiser and one half of the rest on its left or on its right, so
contents that share neither with another are left out too. What is left is dealt to shards by minimiser.

Minimisers whose contents would fill a shard are hot: their contents are cut again into runs by the minimiser of a longer
gram, which has half as many places in a window, and so on until the gram is the window itself. Each level counts and
folds as the first one does, so what many documents share becomes one content, and all of it reaches a shard.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, keyed_texts, same_doc, saved, slices, utf8_parts
from .rolling import BYTE_VALUES, chunks, gathered, span_hash, prefix, window_runs, word_bounds

#: Symbols in one unit of vectorised work; bounds memory, not results.
UNIT = 1 << 20
#: Bytes of contents in one shard; bounds a task's memory.
SHARD_BYTES = 1 << 20
#: Bytes of remembered words in a worker, and what an entry takes besides its word; bound memory, not results.
ROOM, ENTRY = 16 << 20, 150

#: What both operators return for shards and levels: n windows from word or byte ``start`` of a document.
PLACED = "doc_id long, rk long, start long, n int"
_PLACE = ["doc_id", "rk", "start"]
_RUN = [("anchor", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("windows", pa.int32()), ("doc_id", pa.int64()), ("rk", pa.int64()), ("start", pa.int64()), ("weight", pa.int32())]
_KINDS = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary"}


def _ddl(fields) -> str:
    return ", ".join(f"{name} {_KINDS[kind]}" for name, kind in fields)


def digest(data) -> bytes:
    return xxhash.xxh3_128_digest(data)


def word_value(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


class Words:
    """64-bit values of words, which a worker remembers within a bound."""

    memory: dict[bytes, int] = {}
    held = 0

    @classmethod
    def values(cls, words: list[bytes]) -> np.ndarray:
        found = list(map(cls.memory.get, words))
        if None in found:
            for at, known in enumerate(found):
                if known is None:
                    word = words[at]
                    if cls.held > ROOM:
                        cls.memory, cls.held = {}, 0
                    if word not in cls.memory:
                        cls.memory[word] = word_value(word)
                        cls.held += ENTRY + len(word)
                    found[at] = cls.memory[word]
        return np.array(found, np.uint64)


def symbols_of(raw: np.ndarray, offsets: np.ndarray, words: bool):
    """Values of the symbols of all texts, and the bounds of each text among them."""
    if not words:
        return BYTE_VALUES[raw], offsets
    data = raw.tobytes()
    lists = [data[a:b].split() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
    bounds = np.zeros(len(lists) + 1, np.int64)
    np.cumsum([len(x) for x in lists], out=bounds[1:])
    return Words.values([w for own in lists for w in own]), bounds


def _digests(symbols: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """128-bit digests of spans of symbols, as two columns."""
    view, size = memoryview(np.ascontiguousarray(symbols).view(np.uint8)), symbols.itemsize
    out = b"".join([digest(view[a:b]) for a, b in zip((begin * size).tolist(), (end * size).tolist())])
    return np.frombuffer(out, np.int64).reshape(-1, 2)


def _sides(values: np.ndarray, first, windows, spot, width: int, gram: int) -> list[pa.Array]:
    """Hashes of the minimiser with half of a window's rest on its left, and on its right; null where no window of the
    run reaches that far."""
    half = (width - gram + 1) // 2
    sums = prefix(values)
    last = first + windows - 1 + width
    out = []
    for low, high in ((spot - half, spot + gram), (spot, spot + gram + half)):
        inside = (low >= first) & (high <= last)
        hashes = span_hash(sums, np.where(inside, low, 0), np.where(inside, high, 0))
        out.append(pa.array((hashes >> np.uint64(32)).astype(np.uint32).view(np.int32), mask=~inside))
    return out


def _runs(width: int, gram: int, words: bool):
    schema = pa.schema([*_RUN, ("left_half", pa.int32()), ("right_half", pa.int32())])

    def run(batches):
        for batch in batches:
            raw, offsets = utf8_parts(batch.column("text"))
            ids = batch.column("doc_id")
            keys = batch.column("rk")
            for docs, begin, end in chunks(offsets, UNIT, None if words else width - 1):
                part, bounds = gathered(raw, begin, end)
                values, marks = symbols_of(part, bounds, words)
                first, windows, anchor, spot, weight = window_runs(values, marks, width, gram)
                if not len(first):
                    continue
                piece = np.searchsorted(marks, first, "right") - 1
                place = first - marks[piece]
                if not words:
                    place = place + (begin - offsets[docs])[piece]
                row = pa.array(docs[piece])
                halves = _digests(values if words else part, first, first + windows + width - 1)
                columns = [anchor.view(np.int64), halves[:, 0].copy(), halves[:, 1].copy(), windows.astype(np.int32)]
                columns = [pa.array(x) for x in columns] + [ids.take(row), keys.take(row), pa.array(place), pa.array(weight.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns + _sides(values, first, windows, spot, width, gram), schema=schema)

    return run, _ddl(schema_fields(schema))


def schema_fields(schema: pa.Schema) -> list[tuple[str, pa.DataType]]:
    return [(field.name, field.type) for field in schema]


def texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return keyed_texts(docs, id_col, text_col)


def _repeated(runs: DataFrame, name: str) -> DataFrame:
    """Runs whose minimiser stands at least twice, as a saved table; ``runs`` goes."""
    anchors = runs.groupBy("anchor").agg(F.sum("weight").alias("n")).where("n >= 2").select("anchor")
    found = saved(runs.join(anchors, "anchor", "left_semi"), name)
    forget(runs)
    return found


def _whole(places: DataFrame, folded: DataFrame, ordered: bool) -> DataFrame:
    """Places of contents that stand more than once: all of them or, if ``ordered``, all but the first."""
    twice = folded.where("copies > 1").select("h1", "h2", F.struct(*_PLACE).alias("first"))
    found = places.join(twice, ["h1", "h2"])
    if ordered:
        found = found.where(~F.struct(*_PLACE).eqNullSafe(F.col("first")))
    return found.select(*_PLACE, F.col("windows").alias("n"))


def _meeting(folded: DataFrame, ordered: bool) -> DataFrame:
    """Contents that may share a window with another, or with themselves. Unless ``ordered``, one of them has to stand
    once, as windows of the others are known to repeat."""
    undecided = F.lit(True) if ordered else F.col("copies") == 1
    if "left_half" in folded.columns:
        side = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("left_half").alias("half")), F.struct(F.lit(1).alias("side"), F.col("right_half").alias("half"))))
        sides = folded.select("anchor", "h1", "h2", undecided.alias("open"), side.alias("s")).select("anchor", "h1", "h2", "open", "s.*").where("half is not null")
        groups = sides.groupBy("anchor", "side", "half").agg(F.count("*").alias("n"), F.max("open").alias("any_open")).where("n > 1 and any_open")
        near = sides.join(groups, ["anchor", "side", "half"], "left_semi").select("h1", "h2")
        # a minimiser that stands twice within a window has no one place, so all contents under it may meet
        loose = folded.groupBy("anchor").agg(F.max("weight").alias("weight"), F.max(undecided).alias("any_open")).where("weight > 1 and any_open").select("anchor")
        near = near.unionByName(folded.join(loose, "anchor", "left_semi").select("h1", "h2")).distinct()
        return folded.join(near, ["h1", "h2"], "left_semi")
    groups = folded.groupBy("anchor").agg(F.count("*").alias("n"), F.max("weight").alias("weight"), F.max(undecided).alias("any_open"))
    return folded.join(groups.where("(n > 1 or weight > 1) and any_open").select("anchor"), "anchor", "left_semi")


def _folded(places: DataFrame, *more) -> DataFrame:
    """One row for each content: how often it stands, its first place, and what else is the same wherever it stands."""
    same = [F.min(c).alias(c) for c in ("anchor", "windows", "left_half", "right_half") if c in places.columns]
    copies = F.sum("copies") if "copies" in places.columns else F.count("*")
    out = places.groupBy("h1", "h2").agg(copies.alias("copies"), F.min(F.struct(*_PLACE)).alias("at"), F.max("weight").alias("weight"), *same, *more)
    return out.select("*", "at.*").drop("at")


def _dealt(chosen: DataFrame, width: int, symbol_bytes: int, last: bool) -> tuple[DataFrame, bool]:
    """Contents with the shard of their minimiser; -1 marks those of hot ones, whose contents would fill a shard alone.
    On the last level contents under one minimiser are equal but for their length, so there none is hot."""
    size = (F.col("windows") + (width - 1)).cast("long") * symbol_bytes
    per = chosen.groupBy("anchor").agg(F.sum(size).alias("bytes"))
    hot = per.where(F.col("bytes") > SHARD_BYTES).select("anchor", F.lit(True).alias("hot"))
    total, most = per.agg(F.sum(F.when(F.lit(last) | (F.col("bytes") <= SHARD_BYTES), F.col("bytes"))), F.max("bytes")).first()
    shard = F.pmod(F.xxhash64("anchor"), F.lit((total or 0) // SHARD_BYTES + 1)).cast("int")
    if last or (most or 0) <= SHARD_BYTES:
        return chosen.withColumn("shard", shard), False
    return chosen.join(hot, "anchor", "left").withColumn("shard", F.when(F.col("hot"), F.lit(-1)).otherwise(shard)).drop("hot"), True


_CUT = [("shard", pa.int32()), *_RUN[:4], ("copies", pa.int64()), *_RUN[4:7], ("data", pa.binary())]


def _with_data(keyed: DataFrame, chosen: DataFrame, width: int, words: bool) -> DataFrame:
    """Each content with its bytes, cut out of the text it first stands in."""
    own = [name for name, _ in _CUT if name not in ("doc_id", "rk", "data")]
    listed = chosen.groupBy("doc_id", "rk").agg(F.collect_list(F.struct(*own)).alias("runs"))
    joined = keyed.join(listed, same_doc(keyed, listed)).select(keyed["doc_id"], keyed["rk"], "text", "runs")
    schema = pa.schema(_CUT)

    def cut(batches):
        for batch in batches:
            raw, offsets = utf8_parts(batch.column("text"))
            for doc in range(batch.num_rows):
                part = raw[offsets[doc] : offsets[doc + 1]]
                runs = batch.column("runs").slice(doc, 1).flatten()
                columns = dict(zip(own, runs.flatten()))
                low = columns["start"].to_numpy()
                high = low + columns["windows"].to_numpy() + width - 1
                if words:
                    begin, end, _ = word_bounds(part, np.array([0, len(part)]))
                    low, high = begin[low], end[high - 1]
                data = part.tobytes()
                row = pa.array(np.full(len(low), doc))
                columns |= {c: batch.column(c).take(row) for c in ("doc_id", "rk")}
                columns["data"] = pa.array([data[a:b] for a, b in zip(low.tolist(), high.tolist())], pa.binary())
                yield pa.RecordBatch.from_arrays([columns[name] for name, _ in _CUT], schema=schema)

    return joined.mapInArrow(cut, _ddl(_CUT))


def _parted(width: int, gram: int, words: bool):
    """The runs of given contents by the minimiser of a longer gram, with their data; copies are those of the content."""
    fields = [*_RUN, ("copies", pa.int64()), ("data", pa.binary())]

    def run(batches):
        for batch in slices(batches, 1 << 20):
            parts = batch.column("data").to_pylist()
            offsets = np.cumsum([0, *map(len, parts)])
            raw = np.frombuffer(b"".join(parts), np.uint8)
            values, marks = symbols_of(raw, offsets, words)
            first, windows, anchor, _, weight = window_runs(values, marks, width, gram)
            if not len(first):
                continue
            piece = np.searchsorted(marks, first, "right") - 1
            low, high = first, first + windows + width - 1
            halves = _digests(values if words else raw, low, high)
            if words:
                begin, end, _ = word_bounds(raw, offsets)
                low, high = begin[low], end[high - 1]
            copies = batch.column("copies").to_numpy()[piece]
            row = pa.array(piece)
            columns = [pa.array(x) for x in (anchor.view(np.int64), halves[:, 0].copy(), halves[:, 1].copy(), windows.astype(np.int32))]
            columns += [batch.column(c).take(row) for c in ("doc_id", "rk")] + [pa.array(batch.column("start").to_numpy()[piece] + first - marks[piece])]
            columns += [pa.array(np.maximum(weight, np.minimum(copies, 2)).astype(np.int32)), pa.array(copies)]
            data = raw.tobytes()
            columns.append(pa.array([data[a:b] for a, b in zip(low.tolist(), high.tolist())], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=[name for name, _ in fields])

    return run, _ddl(fields)


def repeats(keyed: DataFrame, width: int, gram: int, words: bool, decide, ordered: bool) -> DataFrame:
    """Windows that repeat, as (doc_id, rk, start, n): n windows from ``start`` on; some may be given twice.

    ``decide`` maps a shard - an Arrow table of contents (anchor, h1, h2, windows, copies, doc_id, rk, start, data), some
    of them twice - to such rows for the first places of contents. If ``ordered``, a window's first place is no repeat.
    """
    run, ddl = _runs(width, gram, words)
    places = _repeated(saved(keyed.mapInArrow(run, ddl), "runs"), "candidates")
    folded = saved(_folded(places), "contents")
    found = [_whole(places, folded, ordered)]
    chosen, hot = _dealt(saved(_meeting(folded, ordered), "meeting"), width, 7 if words else 1, gram == width)
    cut = saved(_with_data(keyed, chosen, width, words), "cut")
    while hot:
        found.append(cut.where("shard >= 0").groupBy("shard").applyInArrow(decide, PLACED))
        gram = width - (width - gram) // 2
        run, ddl = _parted(width, gram, words)
        # repeated rows give their contents twice, but these stand twice and are known to repeat, so no count goes wrong
        places = _repeated(saved(cut.where("shard < 0").mapInArrow(run, ddl), "parts"), "candidates")
        folded = saved(_folded(places, F.min("data").alias("data")), "contents")
        found.append(_whole(places, folded, ordered))
        chosen, hot = _dealt(saved(_meeting(folded, ordered), "meeting"), width, 7 if words else 1, gram == width)
        cut = saved(chosen.select(*[name for name, _ in _CUT]), "cut")
    out = cut.groupBy("shard").applyInArrow(decide, PLACED)
    for part in found:
        out = out.unionByName(part)
    return out


def distinct_contents(table: pa.Table) -> pa.Table:
    """A shard's contents without those that repeated rows of the corpus gave twice."""
    key = np.rec.fromarrays([table.column(x).to_numpy() for x in ("h1", "h2")])
    _, keep = np.unique(key, return_index=True)
    return table.take(pa.array(np.sort(keep)))


def merged_cover(size: int, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open intervals as maximal intervals; touching ones join."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.minimum(ends[order], size)
    if not len(starts):
        return starts, ends
    top = np.maximum.accumulate(ends)
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] > top[:-1]
    first = np.flatnonzero(new)
    return starts[first], top[np.append(first[1:] - 1, len(starts) - 1)]
