"""Line deduplication over levelled sorted runs of line hashes."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucket_order, forget, keyed_texts, same_doc, saved, saved_in_buckets, slices, utf8_parts

_STRIP = b" \t\n\x0b\x0c\r"
LINES = "doc_id long, rk long, lines array<int>, h1 long, h2 long"
HASH = ["h1", "h2"]
#: Lines of more than one in so many of all (document, line) pairs counted, fewer lines than this at any size, are looked up
#: in a broadcast table; the others are joined, and each has few rows.
MANY = 1 << 16


def line_keys(keyed: DataFrame, min_chars: int) -> DataFrame:
    """One row for each distinct key of a document, with the numbers of its lines: a line without ASCII blanks at its ends,
    A-Z lower-cased, 128-bit hashed."""

    def run(batches):
        for batch in slices(batches):
            raw, offsets = utf8_parts(batch.column("text"))
            data = raw.tobytes()
            row, sizes, numbers, digests = [], [], [], []
            for doc, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                own: dict[bytes, list[int]] = {}
                for at, line in enumerate(data[a:b].split(b"\n")):
                    key = line.strip(_STRIP).lower()
                    if key and (min_chars <= 1 or len(key.decode("utf-8", "replace")) >= min_chars):
                        own.setdefault(key, []).append(at)
                row += [doc] * len(own)
                for key, places in own.items():
                    digests.append(xxhash.xxh3_128_digest(key))
                    sizes.append(len(places))
                    numbers += places
            take = pa.array(row, pa.int64())
            halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            places = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype(np.int32), pa.array(numbers, pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(take), batch.column("rk").take(take), places, pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy())],
                names=["doc_id", "rk", "lines", *HASH],
            )

    return keyed.select("doc_id", "rk", "text").mapInArrow(run, LINES)


class LineIndex:
    """Runs of line hashes in levels: (h1, h2, docs), in buckets by hash, each sorted by it and written to the shared folder.

    ``add`` merges a batch against the runs: hashes that the runs already hold in ``limit`` documents are settled and
    drop out by merge-anti-joins; the rest of the batch becomes a run of level 0. Two runs of a level are compacted into
    one of the next by a merge join, so the index holds a logarithmic number of runs. Only the batch is exchanged and
    sorted: all runs stand in as many buckets as the session shuffles to.
    """

    def __init__(self, spark: SparkSession, limit: int) -> None:
        self.spark, self.limit = spark, limit
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        #: The run of each level, or None.
        self.levels: list[DataFrame | None] = []

    @staticmethod
    def merged(left: DataFrame, right: DataFrame) -> DataFrame:
        # a union of the two would have to be exchanged before it can be grouped
        docs = [F.coalesce(run["docs"], F.lit(0)) for run in (left, right)]
        return left.join(right.hint("merge"), HASH, "full_outer").select(*HASH, (docs[0] + docs[1]).alias("docs"))

    def _compacted(self, left: DataFrame, right: DataFrame) -> DataFrame:
        whole = self._run(self.merged(left, right))
        forget(left)
        forget(right)
        return whole

    def _run(self, rows: DataFrame) -> DataFrame:
        return saved_in_buckets(rows, "run", self.buckets, HASH)

    def runs(self) -> list[DataFrame]:
        return [run for run in self.levels if run is not None]

    def unsettled(self, lines: DataFrame) -> DataFrame:
        """(h1, h2, docs) of a batch without what the runs have settled."""
        batch = lines.select("doc_id", "rk", *HASH).distinct().groupBy(*HASH).agg(F.count("*").alias("docs"))
        for run in self.runs():
            held = run.where(F.col("docs") >= self.limit).select(*HASH).hint("merge")
            # the last condition always holds; it keeps the join behind the counting, so a hash is sent once a task at most
            batch = batch.join(held, (batch["h1"] == held["h1"]) & (batch["h2"] == held["h2"]) & (batch["docs"] > 0), "left_anti")
        return batch

    def add(self, lines: DataFrame) -> None:
        """Add a batch of lines (doc_id, rk, h1, h2); all lines of a document stand in one batch."""
        with bucket_order(self.spark):
            run = self._run(self.unsettled(lines))
            for level, held in enumerate(self.levels):
                if held is None:
                    self.levels[level] = run
                    return
                self.levels[level], run = None, self._compacted(held, run)
            self.levels.append(run)

    def frequent(self) -> tuple[DataFrame, int]:
        """(h1, h2, docs) of the lines found in ``limit`` documents at least, docs as far as counted until they were
        settled, and the sum of docs over all lines. Ends the index: its runs are compacted into one and deleted."""
        with bucket_order(self.spark):
            whole, *rest = self.runs()
            for run in rest:
                whole = self._compacted(whole, run)
        found = saved(whole.where(F.col("docs") >= self.limit), "frequent")
        counted = whole.agg(F.sum("docs")).first()[0] or 0
        forget(whole)
        self.levels = []
        return found, counted


def _in_frequent(lines: DataFrame, frequent: DataFrame, keep_first: bool, small: bool) -> DataFrame:
    """The rows of ``lines`` with a hash in ``frequent``, but with ``keep_first`` those of its first document."""
    sent = F.broadcast if small else lambda table: table
    found = lines.join(sent(frequent.select(*HASH)), HASH)
    if keep_first:
        first = found.groupBy(*HASH).agg(F.min(F.struct("doc_id", "rk")).alias("first"))
        found = found.join(sent(first), HASH).where(~F.struct("doc_id", "rk").eqNullSafe(F.col("first")))
    return found.select("doc_id", "rk", "lines")


def drop_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1, keep_first: bool = False, batches: int = 8, with_kept: bool = True, carry: bool = False
) -> DataFrame:
    """Drop the lines whose key stands in at least ``min_docs`` documents and has ``min_chars`` code points at least.

    ``keep_first`` keeps them in the document with the smallest id. Returns one row per input row: doc_id, n_lines
    (before), n_dropped, kept_sha256 of the kept lines joined by LF and, if ``with_kept``, kept (that text), if ``carry`` also row (a
    struct of all input columns but the text).

    Null and empty texts are one empty line, which has no key and stays. Rows that repeat an id are separate documents
    unless their texts are equal too: then they count once and share the result. Null ids are a document like others
    (and the first of all). An empty table gives an empty result; further columns are not read.
    """
    keyed = keyed_texts(docs, id_col, text_col, carry, text_in_row=False)
    extra = ["row"] if carry else []
    lines = line_keys(keyed, min_chars).withColumn("batch", F.pmod("rk", F.lit(batches)))
    lines = saved(lines.sortWithinPartitions("batch"), "lines")  # so that a batch reads its own pages only
    index = LineIndex(docs.sparkSession, min_docs)
    for number in range(batches):
        index.add(lines.where(F.col("batch") == number))
    frequent, counted = index.frequent()
    share = counted // MANY
    parts = [_in_frequent(lines, frequent.where(F.col("docs") > share), keep_first, True), _in_frequent(lines, frequent.where(F.col("docs") <= share), keep_first, False)]
    dropped = parts[0].unionByName(parts[1]).groupBy("doc_id", "rk").agg(F.flatten(F.collect_set("lines")).alias("lines"))
    joined = keyed.join(dropped, same_doc(keyed, dropped), "left").select(keyed["doc_id"], "text", "lines", *extra)

    def apply(batches):
        for batch in slices(batches):
            raw, offsets = utf8_parts(batch.column("text"))
            data = raw.tobytes()
            rows = []
            for doc, gone in enumerate(batch.column("lines").to_pylist()):
                own = data[offsets[doc] : offsets[doc + 1]].split(b"\n")
                size = len(own)
                if gone:
                    gone = set(gone)
                    own = [x for at, x in enumerate(own) if at not in gone]
                kept = b"\n".join(own)
                rows.append((size, size - len(own), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace") if with_kept else ""))
            columns = list(zip(*rows)) if rows else [()] * 4
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
            arrays = [batch.column("doc_id")] + [pa.array(c, k) for c, k in zip(columns, kinds)]
            names = ["doc_id", "n_lines", "n_dropped", "kept_sha256", "kept"]
            arrays, names = arrays[: 4 + with_kept], names[: 4 + with_kept]
            yield pa.RecordBatch.from_arrays(arrays + [batch.column(x) for x in extra], names=names + extra)

    ddl = "doc_id long, n_lines long, n_dropped long, kept_sha256 string" + ", kept string" * with_kept
    return joined.mapInArrow(apply, ddl + (f", row {keyed.schema['row'].dataType.simpleString()}" if carry else ""))
