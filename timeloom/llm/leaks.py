"""Benchmark decontamination: one Aho-Corasick automaton over the normalised items reads every text once."""

from __future__ import annotations

import re
import uuid

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, slices, utf8_parts

#: Bytes of windows in one automaton. Test sets are far below it; what exceeds it is read in several passes.
PART_BYTES = 16 << 20
SLICE = 1 << 20
#: A-Z lower-cased, letters, digits and all bytes above 0x7F kept, everything else a space; lengths do not change, so
#: places in normalised texts are places in the original ones.
_NORMAL = bytes(b if chr(b) in "0123456789abcdefghijklmnopqrstuvwxyz" or b > 127 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
_WORD = re.compile(rb"[^ ]+")


def normalised(text: bytes) -> bytes:
    return text.translate(_NORMAL)


class Scanner:
    """Finds the windows of items in sequences of words.

    The automaton reads words, not letters: each word of the windows is coded as three characters of ranges of their own,
    so no node has many children and a match can only begin with a word. Any other word matches nothing.
    """

    def __init__(self, windows: list[bytes], items: list[str]) -> None:
        owners: dict[bytes, set[str]] = {}
        for window, item in zip(windows, items):
            owners.setdefault(window, set()).add(item)
        words = sorted({w for window in owners for w in window.split(b" ")})
        radix = max(2, round(len(words) ** (1 / 3)) + 1)
        self.code = {w: chr(1 + n // radix // radix) + chr(1 + radix * 2 + n // radix % radix) + chr(1 + radix * 3 + n % radix) for n, w in enumerate(words)}
        self.items = [sorted(found) for found in owners.values()]
        self.automaton = ahocorasick.Automaton()
        for n, window in enumerate(owners):
            parts = window.split(b" ")
            self.automaton.add_word("".join([self.code[w] for w in parts]), (n, len(parts)))
        if owners:
            self.automaton.make_automaton()

    _last: tuple[str, "Scanner"] | None = None

    @classmethod
    def shared(cls, name: str, part) -> Scanner:
        """The scanner of a broadcast part, built once a worker; one is held at a time."""
        if cls._last is None or cls._last[0] != name:
            cls._last = None
            cls._last = (name, cls(*part.value))
        return cls._last[1]

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Ranges [from, to) of word numbers inside windows, merged and in order, and the items of these windows."""
        if not self.items:
            return [], set()
        get = self.code.get
        ranges: list[tuple[int, int]] = []
        seen: set[int] = set()
        for end, (n, size) in self.automaton.iter("".join([get(w, "\0\0\0") for w in words])):
            to = end // 3 + 1
            start = to - size
            while ranges and ranges[-1][1] >= start:  # ends never go back, so only the latest ranges can touch
                start = min(start, ranges.pop()[0])
            ranges.append((start, to))
            seen.add(n)
        return ranges, {item for n in seen for item in self.items[n]}


def item_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", words: int = 10) -> DataFrame:
    """(window, item): each distinct run of ``words`` words of an item, or all its words if it has fewer."""
    texts = benchmark.select(F.col(id_col).cast("string").alias("item"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches):
        for batch in slices(batches, SLICE):
            row, found = [], []
            for n, text in enumerate(batch.column("text").to_pylist()):
                own = normalised(text.encode()).split()
                windows = {b" ".join(own[at : at + words]) for at in range(max(1, len(own) - words + 1))} - {b""}
                row += [n] * len(windows)
                found += windows
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), batch.column("item").take(pa.array(row, pa.int64()))], names=["window", "item"])

    return texts.mapInArrow(run, "window binary, item string").where("item is not null").distinct()


SPANS = "array<struct<first: int, last: int, start: int, end: int>>"


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 10, item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_hit (words inside an item's window), items (sorted as strings) and spans:
    the maximal runs of hit words by their numbers (first, last, from 0) and their places in the original text in code
    points (start, end, the end outside).

    Words are runs of ASCII letters and digits and of anything above ASCII, with A-Z lower-cased. A window is ``words``
    words of an item in a row; an item of fewer is one window whole, an item without words has none. Null and empty texts
    have no words; every row is judged by itself, repeated ids or not; a null item id and empty tables give no windows;
    further columns are not read. Windows go to the workers as broadcast parts of ``PART_BYTES`` each, dealt by hash: the
    first part is all there is unless the test sets are huge, and each further part reads the texts once more.
    """
    windows = saved(item_windows(benchmark, item_col, item_text, words), "windows")
    size = windows.agg(F.sum(F.length("window") + F.length("item") + 16)).first()[0] or 0
    parts = -(-size // PART_BYTES) or 1
    text = F.coalesce(F.col(text_col), F.lit(""))
    state = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.array().cast("array<int>").alias("marks"), F.array().cast("array<string>").alias("items"))
    for part in range(parts):
        last = part == parts - 1
        state = _scanned(state, windows.where(F.pmod(F.xxhash64("window", "item"), F.lit(parts)) == part), last)
        if not last:
            state = saved(state, "scanned")
    return state


def _scanned(state: DataFrame, windows: DataFrame, last: bool) -> DataFrame:
    table = windows.toArrow()
    part = state.sparkSession.sparkContext.broadcast((table.column("window").to_pylist(), table.column("item").to_pylist()))
    name = uuid.uuid4().hex

    def run(batches):
        scanner = Scanner.shared(name, part)
        for batch in slices(batches, SLICE):
            raw, offsets = utf8_parts(batch.column("text"))
            data = normalised(raw.tobytes())
            known_marks, known_items = batch.column("marks").to_pylist(), batch.column("items").to_pylist()
            counts, hits, items, spans, marks = [], [], [], [], []
            for n, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                own = data[a:b].split()
                ranges, found = scanner.scan(own)
                if known_marks[n]:
                    ranges = _union(ranges + list(zip(known_marks[n][::2], known_marks[n][1::2])))
                items.append(sorted(found.union(known_items[n])))
                if last:
                    counts.append(len(own))
                    hits.append(sum(y - x for x, y in ranges))
                    spans.append(_places(raw[a:b], data[a:b], ranges) if ranges else [])
                else:
                    marks.append([x for pair in ranges for x in pair])
            listed = pa.array(items, pa.list_(pa.string()))
            if last:
                kind = pa.list_(pa.struct([(f, pa.int32()) for f in ("first", "last", "start", "end")]))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(hits, pa.int64()), listed, pa.array(spans, kind)], names=["doc_id", "n_words", "n_hit", "items", "spans"])
            else:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array(marks, pa.list_(pa.int32())), listed], names=["doc_id", "text", "marks", "items"])

    kind = f"doc_id long, n_words long, n_hit long, items array<string>, spans {SPANS}" if last else "doc_id long, text string, marks array<int>, items array<string>"
    return state.mapInArrow(run, kind)


def _union(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, to in sorted(ranges):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], to))
        else:
            out.append((start, to))
    return out


def _places(raw: np.ndarray, data: bytes, ranges: list[tuple[int, int]]) -> list[dict]:
    """Spans of hit words in the original text; only texts with hits come here."""
    bounds = [m.span() for m in _WORD.finditer(data)]
    before = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])  # code points before each byte
    return [{"first": x, "last": y - 1, "start": int(before[bounds[x][0]]), "end": int(before[bounds[y - 1][1]])} for x, y in ranges]
