"""Spelling variants: words one edit apart, found by full one-edit neighbourhoods over a reduced alphabet."""

from __future__ import annotations

import collections
import re
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, saved, slices, utf8_parts

SLICE = 4 << 20
_RUN = re.compile("[a-zÀ-ÿ]+")


def corpus_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 6, min_count: int = 5, slip: int = 199) -> DataFrame:
    """(word, n) of the corpus: runs of Latin letters (U+00C0 to U+00FF included) with A-Z lower-cased, of ``min_chars``
    code points and ``min_count`` occurrences at least.

    One run in ``slip`` gets a slip of the pen: with h the CRC-32 of ``<doc_id>:<run>``, a run whose h it divides loses
    its code point h % length. ``slip`` 0 leaves all as they are. Null and empty texts have no words, a null id is written
    as nothing, every row counts. Slices of texts are counted before anything is shuffled, so no word is hot.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches):
        for batch in slices(batches, SLICE):
            raw, offsets = utf8_parts(batch.column("text"))
            data = raw.tobytes().lower()  # of bytes: A-Z only
            total: collections.Counter[str] = collections.Counter()
            for doc, a, b in zip(batch.column("doc_id").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist()):
                found = collections.Counter(_RUN.findall(data[a:b].decode()))
                if slip:
                    prefix = zlib.crc32(b":" if doc is None else b"%d:" % doc)
                    for word in list(found):
                        h = zlib.crc32(word.encode(), prefix)
                        if h % slip == 0:
                            at = h % len(word)
                            total[word[:at] + word[at + 1 :]] += found.pop(word)
                total.update(found)
            kept = {w: n for w, n in total.items() if len(w) >= min_chars}
            yield pa.RecordBatch.from_arrays([pa.array(list(kept), pa.string()), pa.array(list(kept.values()), pa.int64())], names=["word", "n"])

    return texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


# ---- reduced neighbourhoods ----------------------------------------------------------------------------------------


class _Reduced(dict):
    """Letters to a few symbols by a hash of the letter."""

    def __init__(self, symbols: int) -> None:
        self.symbols = symbols

    def __missing__(self, letter: int) -> str:
        symbol = chr(97 + zlib.crc32(chr(letter).encode()) % self.symbols)
        self[letter] = symbol
        return symbol


def _key(reduced: str, front: bool, half: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{reduced}{'<' if front else '>'}{half}") - (1 << 63)


def own_keys(word: str, letters: _Reduced) -> list[int]:
    """Keys under which a word is found: its reduced form with its first half, and with its second."""
    reduced, half = word.translate(letters), len(word) // 2
    return [_key(reduced, True, word[:half]), _key(reduced, False, word[half:])]


def neighbour_keys(word: str, letters: _Reduced) -> set[int]:
    """Keys of all reduced words within one edit of the reduced ``word``, the word itself included as a replacement by
    the same symbol.

    Each comes with the half of the word it stands for that the edit leaves alone: the first half if the edit lies at or
    behind the middle of that word, else the second. Every word one edit from ``word`` has one of these keys, and what
    shares a key without being near agrees in a whole half, so that a key's words stay few.
    """
    reduced, size = word.translate(letters), len(word)
    symbols = [chr(97 + n) for n in range(letters.symbols)]
    keys = set()
    for change, middle in ((0, size // 2), (-1, (size - 1) // 2), (1, (size + 1) // 2)):
        rest = word[middle - change :]  # the second half of the word it becomes
        for at in range(size + (change == 1)):
            front = at >= middle
            half = word[:middle] if front else rest
            head, tail = reduced[:at], reduced[at + (change < 1) :]
            for symbol in symbols if change >= 0 else [""]:
                keys.add(_key(head + symbol + tail, front, half))
    return keys


def near_words(words: DataFrame, symbols: int = 4) -> DataFrame:
    """(word, n, near, near_n): every ordered pair of distinct words (word, n) that differ by exactly one inserted,
    deleted or replaced code point. Words must not repeat; a null word is near to none; an empty table gives none."""
    words = words.where("word is not null")

    def keyed(of):
        def run(batches):
            letters = _Reduced(symbols)
            for batch in slices(batches, 1 << 17):
                found = [list(of(w, letters)) for w in batch.column("word").to_pylist()]
                take = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
                keys = pa.array([k for f in found for k in f], pa.int64())
                yield pa.RecordBatch.from_arrays([keys, batch.column("word").take(take), batch.column("n").take(take)], names=["key", "word", "n"])

        return words.select("word", "n").mapInArrow(run, "key long, word string, n long")

    listed = keyed(own_keys).withColumnsRenamed({"word": "near", "n": "near_n"})
    met = keyed(neighbour_keys).join(listed, "key").where(F.levenshtein("word", "near", 1) == 1)
    return met.select("word", "n", "near", "near_n").distinct()


def spelling_forms(words: DataFrame, ratio: int = 5, symbols: int = 4) -> DataFrame:
    """One row per word: word, n, n_near (its near words), form (the near word of largest n, ties to the smallest in
    code-point order, if that is ``ratio`` times its own n at least, else null), form_n, and root: the last word on the
    way from form to form, the word itself if it has none. An empty table gives an empty result."""
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))
    found = near_words(words, symbols).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    rows = words.join(found, "word", "left")
    holds = -F.col("best.less") >= ratio * F.col("n")
    rows = rows.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(holds, F.col("best.near")).alias("form"), F.when(holds, -F.col("best.less")).alias("form_n"))
    rows = saved(rows, "forms")
    roots = _roots(rows.where("form is not null").select("word", F.col("form").alias("root")))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(steps: DataFrame) -> DataFrame:
    """(word, root) by pointer doubling: counts grow from form to form, so ways are short and never return."""
    steps = saved(steps, "roots")
    while True:
        onward = steps.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        longer = saved(steps.join(onward, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "roots")
        forget(steps)
        steps = longer.drop("moved")
        steps.scratch_path = longer.scratch_path
        if longer.where("moved").isEmpty():
            return steps
