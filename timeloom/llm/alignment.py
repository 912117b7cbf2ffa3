"""Alignment of two tokenisers' tokens by divide and conquer at shared cuts, and the links of ids over a corpus."""

from __future__ import annotations

import hashlib
import json
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, slices
from .tokens import byte_values

#: Bytes of texts in one unit of work.
SLICE = 1 << 19
#: Pairs whose links are looked up in a broadcast table: those of more than one link in FREQUENT, so never more of them.
FREQUENT = 1 << 18


#: Fixed value: how byte-level BPE of this kind parts a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


# ---- alignment of token sequences ----------------------------------------------------------------------------------

#: Tokens next to the middle that are tried one by one before an interval is searched as a whole.
NEAR = 16


def leaf_groups(ends_a: np.ndarray, ends_b: np.ndarray, bounds_a: np.ndarray, bounds_b: np.ndarray) -> np.ndarray:
    """Ranges (a from, a to, b from, b to) of the tokens between neighbouring common ends, in order.

    ``ends_a`` and ``ends_b`` are the rising byte offsets at which the tokens of texts that stand end to end end, and the
    bounds (n + 1) tell the tokens of each text. Each text is an interval; an interval is cut at the common end nearest to
    its middle, which is sought outward by bisection of the other side; both halves are treated alike, and one without a
    common end inside is a leaf. All intervals of a depth are worked on together.
    """
    a0, a1, b0, b1 = (x.astype(np.int64) for x in (bounds_a[:-1], bounds_a[1:], bounds_b[:-1], bounds_b[1:]))
    leaves = [np.zeros((0, 4), np.int64)]
    while len(a0):
        cut_a, cut_b = np.full(len(a0), -1), np.full(len(a0), -1)
        middle = a0 + (a1 - a0 - 2) // 2
        open_ = np.flatnonzero((a1 - a0 > 1) & (b1 - b0 > 1))
        for away in range(NEAR):
            for side in (-away, away) if away else (0,):
                at = middle[open_] + side
                inside = (at >= a0[open_]) & (at < a1[open_] - 1)
                at, own = at[inside], open_[inside]
                other = np.searchsorted(ends_b, ends_a[at])
                met = ends_b[other] == ends_a[at]
                cut_a[own[met]], cut_b[own[met]] = at[met], other[met]
                open_ = open_[cut_a[open_] < 0]
            open_ = open_[(middle[open_] - away > a0[open_]) | (middle[open_] + away < a1[open_] - 2)]
            if not len(open_):
                break
        for n in open_.tolist():  # long stretches with hardly a common end
            at = np.arange(a0[n], a1[n] - 1)
            other = np.searchsorted(ends_b, ends_a[at])
            met = np.flatnonzero(ends_b[other] == ends_a[at])
            if len(met):
                best = met[np.abs(at[met] - middle[n]).argmin()]
                cut_a[n], cut_b[n] = at[best], other[best]
        cut = cut_a >= 0
        leaves.append(np.stack([a0, a1, b0, b1], axis=1)[~cut & (a1 > a0)])
        ends = cut_a[cut] + 1, cut_b[cut] + 1
        a0, a1 = np.concatenate([a0[cut], ends[0]]), np.concatenate([ends[0], a1[cut]])
        b0, b1 = np.concatenate([b0[cut], ends[1]]), np.concatenate([ends[1], b1[cut]])
    groups = np.concatenate(leaves)
    return groups[np.argsort(groups[:, 0])]


def overlaps(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all A and B tokens whose byte ranges overlap; every token has bytes."""
    first = np.searchsorted(ends_b, np.concatenate([[0], ends_a[:-1]])[: len(ends_a)], "right")
    count = np.searchsorted(ends_b, ends_a) - first + 1
    inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return np.repeat(np.arange(len(ends_a)), count), np.repeat(first, count) + inside


class PairAligner:
    """Ids of a byte-level BPE (A) and a sentence-piece BPE (B) on space + text, and their alignment.

    Where the ids of A follow the order of its merges, as ranks do, the same vocabulary runs in a faster engine of ranks;
    texts with characters of which versions of Unicode may think otherwise go through A's own."""

    _shared: dict[tuple[str, str], "PairAligner"] = {}
    #: Anything but Latin, Greek and Cyrillic letters, common marks, kana, frequent ideographs and Hangul.
    _unsure = re.compile("[^\t\n\r -~\u00a0-\u0377\u0400-\u0527\u2010-\u2027\u2030-\u205e\u3000-\u30ff\u4e00-\u9fa5\uac00-\ud7a3]")

    def __init__(self, path_a: str, path_b: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        value = byte_values()
        vocabulary = self.a.get_vocab()
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for piece, n in vocabulary.items():
            self.bytes_a[n] = bytes(value[c] for c in piece) if all(c in value for c in piece) else piece.encode()
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(n) for n in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(n) else p.replace("▁", " ").encode() for n, p in enumerate(pieces)]
        self.sizes_a, self.sizes_b = (np.array([len(x) for x in known], np.int64) for known in (self.bytes_a, self.bytes_b))
        with open(path_a, encoding="utf-8") as file:
            stored = json.load(file)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in stored["model"]["merges"]]
        kind = stored["pre_tokenizer"] or {}
        ranked = all(vocabulary.get(x + y) == 256 + n for n, (x, y) in enumerate(merges)) and all(vocabulary.get(c, 256) < 256 for c in value)
        plain = kind.get("type") == "ByteLevel" and not kind.get("add_prefix_space") and kind.get("use_regex", True) and stored["normalizer"] is None
        self.ranks = None
        if ranked and plain:
            self.ranks = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks={self.bytes_a[n]: n for n in range(256 + len(merges))}, special_tokens={})
        # every id's digits and the mark behind it: next of its side, end of A's side, end of the group
        digits = [str(n) for n in range(max(len(self.bytes_a), len(self.bytes_b)))]
        self.written = pa.array([d + mark for d in digits for mark in ",|;"], pa.large_string())

    @classmethod
    def shared(cls, path_a: str, path_b: str) -> PairAligner:
        if (path_a, path_b) not in cls._shared:
            cls._shared[path_a, path_b] = cls(path_a, path_b)
        return cls._shared[path_a, path_b]

    def ids_a(self, text: str) -> list[int]:
        if self.ranks is None or self._unsure.search(text):
            return self.a.encode(" " + text, add_special_tokens=False).ids
        return self.ranks.encode_ordinary(" " + text)

    def encoded(self, texts: list[str]) -> list[tuple[list[int], list[int]]]:
        """Ids of both sides of each text, none where they do not spell space + text."""
        out = []
        for text, b in zip(texts, self.b.encode(texts, num_threads=1)):
            a = self.ids_a(text) if text else []
            expected = b" " + text.encode()
            if not text or b"".join([self.bytes_a[n] for n in a]) != expected or b"".join([self.bytes_b[n] for n in b]) != expected:
                a = b = []
            out.append((a, b))
        return out

    def align(self, texts: list[str]) -> dict[str, list | np.ndarray]:
        """By text: n_a, n_b, n_groups, n_links, groups_sha256, and pairs (a << 32 | b, rising and distinct within a text)
        with their times, end to end with their bounds."""
        ids = self.encoded(texts)
        (a, bounds_a), (b, bounds_b) = (_joined([pair[side] for pair in ids]) for side in (0, 1))
        ends_a, ends_b = np.cumsum(self.sizes_a[a]), np.cumsum(self.sizes_b[b])
        groups = leaf_groups(ends_a, ends_b, bounds_a, bounds_b)
        # the groups in writing: A's ids of a group, then B's
        own_a, own_b = (np.repeat(np.arange(len(groups)), groups[:, n + 1] - groups[:, n]) for n in (0, 2))
        mark_a, mark_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        mark_a[groups[:, 1] - 1], mark_b[groups[:, 3] - 1] = 1, 2
        order = np.zeros(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + groups[own_a, 2]] = 3 * a + mark_a
        order[np.arange(len(b)) + groups[own_b, 1]] = 3 * b + mark_b
        written = self.written.take(pa.array(order))
        spots = np.frombuffer(written.buffers()[1], np.int64)[: len(order) + 1][bounds_a + bounds_b].tolist() if len(order) else [0] * (len(texts) + 1)
        data = memoryview(written.buffers()[2] or b"")
        digests = [hashlib.sha256(data[x : y - 1]).hexdigest() if y > x else "" for x, y in zip(spots, spots[1:])]
        # links, counted within each text
        left, right = overlaps(ends_a, ends_b)
        links = a[left] << 32 | b[right]
        at = np.searchsorted(left, bounds_a)
        counted = [np.unique(links[x:y], return_counts=True) for x, y in zip(at[:-1].tolist(), at[1:].tolist())]
        return {
            "n_a": np.diff(bounds_a), "n_b": np.diff(bounds_b), "n_groups": np.diff(np.searchsorted(groups[:, 0], bounds_a)), "n_links": np.diff(at), "groups_sha256": digests,
            "bounds": np.cumsum([0] + [len(v) for v, _ in counted]), "pairs": np.concatenate([v for v, _ in counted]), "times": np.concatenate([n for _, n in counted]),
        }


def _joined(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    return np.array([n for ids in lists for n in ids], np.int64), np.cumsum([0] + [len(ids) for ids in lists])


# ---- corpus --------------------------------------------------------------------------------------------------------


def aligned_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", paths: tuple[str, str] | None = None) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, groups_sha256, and its distinct links as pairs
    (a << 32 | b, rising) with their times.

    A encodes space + text, B the text. Texts that are null or empty, or whose tokens do not spell space + text, have no
    tokens: zeros, '' and empty lists. Every row is aligned by itself, repeated ids or not; a null id stays null; an empty
    table gives an empty result; further columns are not read.
    """
    paths = paths or default_tokenizers()
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches):
        aligner = PairAligner.shared(*paths)
        for batch in slices(batches, SLICE):
            found = aligner.align(batch.column("text").to_pylist())
            columns = [pa.array(found[name], pa.string() if name == "groups_sha256" else pa.int64()) for name in ("n_a", "n_b", "n_groups", "n_links", "groups_sha256")]
            lists = [pa.ListArray.from_arrays(pa.array(found["bounds"], pa.int32()), pa.array(found[name], kind)) for name, kind in (("pairs", pa.int64()), ("times", pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns, *lists], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    return texts.mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>")


def _values(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False)


def link_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n, best) over all documents: how many links hold a pair, and whether no pair of its B id has more."""

    def run(batches):
        for batch in batches:
            values, back = np.unique(_values(batch.column("pairs")), return_inverse=True)
            sums = np.bincount(back, _values(batch.column("times")), len(values)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(values, pa.int64()), pa.array(sums)], names=["pair", "n"])

    counted = aligned.select("pairs", "times").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    most = F.max("n").over(Window.partitionBy(F.col("pair").bitwiseAND(0xFFFFFFFF)))
    return counted.select("pair", "n", (F.col("n") == most).alias("best"))


def alignment_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", paths: tuple[str, str] | None = None, frequent: int = FREQUENT) -> DataFrame:
    """``aligned_documents`` without the lists, with n_best (links whose count is the highest of their B id, ties
    included) and count_sum (the sum of the counts of all links).

    Pairs of more than one link in ``frequent`` of the corpus - fewer than ``frequent`` of them, whatever its size - are
    looked up in a broadcast table; only the others are joined, and each of these has few rows. Edge cases as there.
    """
    aligned = saved(aligned_documents(docs, id_col, text_col, paths).withColumn("row", F.monotonically_increasing_id()), "aligned")
    counts = saved(link_counts(aligned), "links")
    least = (counts.agg(F.sum("n")).first()[0] or 0) // frequent
    table = counts.where(F.col("n") > least).toArrow().sort_by("pair")
    known = aligned.sparkSession.sparkContext.broadcast([table.column(c).to_numpy() for c in ("pair", "n", "best")])

    def run(batches):
        pairs, n, best = known.value
        for batch in batches:
            values, times, lengths = _values(batch.column("pairs")), _values(batch.column("times")).astype(np.int64), batch.column("pairs").value_lengths().to_numpy()
            at = np.minimum(np.searchsorted(pairs, values), max(len(pairs) - 1, 0))
            met = pairs[at] == values if len(pairs) else np.zeros(len(values), bool)
            ends = np.concatenate([[0], np.cumsum(lengths)])
            rests = np.concatenate([[0], np.cumsum(~met)])[ends]
            columns = []
            for weight in (n, best.astype(np.int64)):
                each = np.zeros(len(values), np.int64)
                each[met] = weight[at[met]] * times[met]
                running = np.concatenate([[0], np.cumsum(each)])[ends]
                columns.append(pa.array(running[1:] - running[:-1]))
            lists = [pa.ListArray.from_arrays(pa.array(rests, pa.int32()), pa.array(x[~met], kind)) for x, kind in ((values, pa.int64()), (times, pa.int32()))]
            rest = [batch.column(c) for c in ("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")]
            yield pa.RecordBatch.from_arrays([*rest, *columns, *lists], names=["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "count_sum", "n_best", "pairs", "times"])

    schema = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, count_sum long, n_best long, pairs array<long>, times array<int>"
    summed = saved(aligned.mapInArrow(run, schema), "frequent")
    rare = summed.where(F.size("pairs") > 0).select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    rare = rare.join(counts.where(F.col("n") <= least), "pair").groupBy("row")
    rare = rare.agg(F.sum(F.col("n") * F.col("times")).alias("rare_sum"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("rare_best"))
    full = summed.drop("pairs", "times").join(rare, "row", "left")
    total = lambda name, more: (F.col(name) + F.coalesce(more, F.lit(0))).cast("long").alias(name)
    return full.select("doc_id", "n_a", "n_b", "n_groups", "n_links", total("n_best", "rare_best"), total("count_sum", "rare_sum"), "groups_sha256")
