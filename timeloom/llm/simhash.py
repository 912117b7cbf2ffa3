"""SimHash near-duplicates with Golay-code keys.

A fingerprint's 64 bits fall into segments A, B, C of 22, 21 and 21 bits. Two fingerprints that differ in at most two
bits differ in no bit of one segment, and in at most one bit of the segment that goes before it (in the order A, B, C,
A): two errors inside one segment leave both others exact, two errors in different segments leave the third exact
and one error in each of the rest. So the keys are (segment before, up to one error; next segment, exact).

One error is bridged by the perfect Golay code of length 23 (4096 codewords, every word within distance 3 of exactly
one). A segment's keys are the indices of all codewords within distance 4: its own one, and five more if that one is at
distance 3. Segments one bit apart share a key: if either lies within 2 of its codeword c, the other lies within 3 of c;
if both lie at 3, each lies within 4 of the other's codeword.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed_texts, may_be_among, same_doc, saved, utf8_parts
from .components import components

#: Fixed value: generator polynomial of the binary Golay code of length 23.
GENERATOR = 0b110001110101
#: Lowest bit and number of bits of the segments A, B, C.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Rows under one key above which bits outside the key part them further before they are compared.
CROWD = 256


# ---- fingerprints --------------------------------------------------------------------------------------------------


def fingerprint_of(text: bytes, shingle_words: int) -> int:
    words = text.lower().split()  # bytes: A-Z and the six ASCII blanks only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle_words:
        hashes = [xxhash.xxh64_intdigest(joined, 42)]
    else:
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        ends = np.cumsum(sizes)
        starts = (ends - sizes)[: len(words) - shingle_words + 1].tolist()
        stops = (ends - 1)[shingle_words - 1 :].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], 42) for a, b in zip(starts, stops)]
    bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[at : at + (1 << 16)], np.uint64)
        bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints_of(text: pa.Array, shingle_words: int) -> pa.Array:
    raw, offsets = utf8_parts(text)
    data = raw.tobytes()
    return pa.array([fingerprint_of(data[a:b], shingle_words) for a, b in zip(offsets[:-1], offsets[1:])], pa.int64())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3) -> DataFrame:
    """(doc_id, rk, fp): the majority bits of the XXH64 hashes (seed 42) of all word shingles, repeats included."""
    texts = keyed_texts(docs, id_col, text_col)

    def run(batches):
        for batch in batches:
            found = fingerprints_of(batch.column("text"), shingle_words)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("rk"), found], names=["doc_id", "rk", "fp"])

    return texts.mapInArrow(run, "doc_id long, rk long, fp long")


# ---- Golay keys ----------------------------------------------------------------------------------------------------


def _remainders(values: np.ndarray) -> np.ndarray:
    values = values.copy()
    for bit in range(22, 10, -1):
        values ^= np.where(values >> bit & 1, GENERATOR << (bit - 11), 0)
    return values


class Golay:
    """Tables: remainder of the high and low half of a word, and the error patterns of each remainder."""

    def __init__(self) -> None:
        half = np.arange(1 << 12)
        self.low, self.high = _remainders(half), _remainders(half[: 1 << 11] << 12)
        self.errors = np.full((1 << 11, 6), -1, np.int64)
        used = np.zeros(1 << 11, np.int64)
        for weight in range(5):
            patterns = np.array([sum(1 << b for b in bits) for bits in combinations(range(23), weight)])
            for pattern, at in zip(patterns.tolist(), _remainders(patterns).tolist()):
                self.errors[at, used[at]] = pattern
                used[at] += 1

    def indices(self, words: np.ndarray) -> np.ndarray:
        """Indices of the codewords within distance 4, or -1: up to six for each 23-bit word."""
        errors = self.errors[self.low[words & 0xFFF] ^ self.high[words >> 12]]
        return np.where(errors < 0, -1, (words[:, None] ^ errors) >> 11)


def keys_of(golay: Golay, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every key of the fingerprints."""
    bits = fps.view(np.uint64)
    parts = [(bits >> np.uint64(low) & np.uint64((1 << size) - 1)).astype(np.int64) for low, size in SEGMENTS]
    rows, keys = [], []
    for which in range(3):
        near = golay.indices(parts[which])
        row, column = np.nonzero(near >= 0)
        rows.append(row)
        keys.append(which << 60 | near[row, column] << 22 | parts[(which + 1) % 3][row])
    return np.concatenate(rows), np.concatenate(keys)


def _pairs(group: np.ndarray, fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of equal group (sorted) whose fingerprints differ in at most ``distance`` bits."""
    left, right = [], []
    at = np.arange(len(group) - 1)
    step = 1
    while len(at):
        at = at[at + step < len(group)]
        at = at[group[at] == group[at + step]]
        near = np.bitwise_count(fps[at] ^ fps[at + step]) <= distance
        left.append(at[near])
        right.append(at[near] + step)
        step += 1
    empty = np.zeros(0, np.int64)
    return np.concatenate(left or [empty]), np.concatenate(right or [empty])


def _further_groups() -> np.ndarray:
    """Masks (segment x 3): the bits outside each segment, parted in three."""
    masks = []
    for low, size in SEGMENTS:
        others = [bit for bit in range(64) if not low <= bit < low + size]
        masks.append([sum(1 << bit for bit in part) for part in (others[0::3], others[1::3], others[2::3])])
    return np.array(masks, np.uint64)


_FURTHER = _further_groups()


def linked(keys: np.ndarray, fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among rows of equal key. In a crowded key the bits outside the segment that the key fixes are parted in
    three: with at most two errors one of these groups is exact, so rows that agree in one are compared."""
    _, group, size = np.unique(keys, return_inverse=True, return_counts=True)
    few = np.flatnonzero(size[group] <= CROWD)
    few = few[np.argsort(group[few], kind="stable")]
    a, b = _pairs(group[few], fps[few], distance)
    left, right = [few[a]], [few[b]]
    many = np.flatnonzero(size[group] > CROWD)
    if len(many):
        exact = ((keys[many] >> 60) + 1) % 3
        for further in range(3):
            part = fps[many] & _FURTHER[exact, further]
            at = np.lexsort((part, group[many]))
            order, part = many[at], part[at]
            new = np.ones(len(order), bool)
            new[1:] = (group[order[1:]] != group[order[:-1]]) | (part[1:] != part[:-1])
            a, b = _pairs(np.cumsum(new), fps[order], distance)
            left.append(order[a])
            right.append(order[b])
    return np.concatenate(left), np.concatenate(right)


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest row reachable by links, for each row."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while True:
            jump = new[new]
            if (jump == new).all():
                break
            new = jump
        if (new == label).all():
            return label
        label = new


def links(distinct: DataFrame, max_distance: int = 2) -> DataFrame:
    """(a, b) over distinct fingerprints (column fp): links that join the same fingerprints as all pairs would.

    Each key's rows arrive together and sorted; a key gives at most one row for each of its fingerprints.
    """
    if not 0 <= max_distance <= 2:
        raise ValueError("the keys find every pair up to two differing bits")

    def explode(batches):
        golay = Golay()
        for batch in batches:
            fps = batch.column("fp").to_numpy()
            row, key = keys_of(golay, fps)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fps[row])], names=["key", "fp"])

    def star(batches):
        rest_key, rest_fp = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def flush(key, fp):
            start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            alone = np.zeros(len(key), bool)
            alone[start[np.append(np.diff(start), len(key) - start[-1]) == 1]] = True
            key, fp = key[~alone], fp[~alone]
            a, b = linked(key, fp.view(np.uint64), max_distance)
            label = _forest(len(fp), a, b)
            member = np.flatnonzero(label != np.arange(len(fp)))
            return pa.RecordBatch.from_arrays([pa.array(fp[member]), pa.array(fp[label[member]])], names=["a", "b"])

        for batch in batches:
            key = np.concatenate([rest_key, batch.column("key").to_numpy()])
            fp = np.concatenate([rest_fp, batch.column("fp").to_numpy()])
            whole = np.searchsorted(key, key[-1]) if len(key) else 0  # the last key may go on in the next batch
            if whole:
                yield flush(key[:whole], fp[:whole])
            rest_key, rest_fp = key[whole:], fp[whole:]
        if len(rest_key):
            yield flush(rest_key, rest_fp)

    keyed = distinct.select("fp").mapInArrow(explode, "key long, fp long")
    # the exchange groups equal keys; sorting inside partitions lets them stream
    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(star, "a long, b long").distinct()


# ---- the operator --------------------------------------------------------------------------------------------------


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3, max_distance: int = 2, marked: DataFrame | None = None) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest id reachable by links), and
    component and rk, keys of the component and, with doc_id, of the row.

    Documents link if their fingerprints differ in at most ``max_distance`` bits. Texts are lower-cased in A-Z; a text
    with fewer words than a shingle is one shingle; a text without words (null, empty, blank) has fingerprint zero and
    links like any other. Rows that repeat an id are separate documents of one name. Null ids are never the smallest;
    a component of null ids only has a null id. An empty table gives an empty result; further columns are not read.
    ``marked`` is a saved table of the documents' fingerprints (doc_id, rk, fp), if there is one.
    """
    marked = saved(fingerprints(docs, id_col, text_col, shingle_words), "fingerprints") if marked is None else marked
    distinct = saved(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = components(links(distinct, max_distance))
    named = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    lowest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = named.join(lowest, "root").select("fp", "component_id", F.col("root").alias("component"))
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return marked.join(classes, "fp").select("doc_id", hexed.alias("fingerprint"), "component_id", "component", "rk")


def first_of_each(docs: DataFrame, classes: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay when each class (doc_id, rk, component; a row for each of ``docs``) keeps one: that with
    the smallest id (null first), and among rows of that id one. All columns stay.

    Rows that stay and stand once are told by a map of bits and stay where they are; only the others travel."""
    keys = saved(classes.groupBy("doc_id", "rk", "component").agg(F.count("*").alias("copies")), "keys")
    first = saved(keys.groupBy("component").agg(F.min(F.struct("doc_id", "rk")).alias("at")).select("component", "at.*"), "first")
    alone = keys.where("copies = 1").join(first, same_doc(keys, first), "left_semi")
    others = keys.join(alone, same_doc(keys, alone), "left_anti")
    keyed = may_be_among(keyed_texts(docs, id_col, text_col, carry=True), saved(others.select("rk"), "others"))
    judged = keyed.where("maybe")
    kept = judged.join(first, same_doc(judged, first), "left_semi").dropDuplicates(["doc_id", "rk"])
    return keyed.where("not maybe").select("row.*").unionByName(kept.select("row.*"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, max_distance: int = 2) -> DataFrame:
    """The rows of ``docs`` that stay when each group of near-duplicates keeps one."""
    return first_of_each(docs, near_duplicates(docs, id_col, text_col, shingle_words, max_distance), id_col, text_col)
