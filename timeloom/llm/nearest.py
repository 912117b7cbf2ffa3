"""Exact nearest neighbours by a block matrix join over int8 tiles.

Vectors are packed into blocks, one row each: int8 codes, scales and norms, worked out once, and the originals. A block
is known by its first id, which no other block holds. Query blocks meet candidate
blocks as tiles of a grid; no pair of vectors is ever a row. In a tile one matrix product of codes gives approximate
inner products, and each has an error bound from the norms of what quantisation dropped. Candidates whose upper bound
stays below the k-th best lower bound are out; the survivors are computed again from the originals in double precision,
and bounded heaps - the k best of a tile, then of all tiles - merge them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors in a block of candidates and of queries; bound a tile's memory.
CANDIDATES, QUERIES = 4096, 512
#: Candidate blocks that one task goes through for a query block.
STRIP = 8
#: Queries multiplied at once, and parts of query blocks whose best a task holds.
PART, HELD = 128, 512

BLOCK = "dim int, first long, ids binary, codes binary, facts binary, data binary"


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes (as float32 for the product), scale, norm of what the codes spell and norm of the rest."""
    scale = np.abs(x).max(axis=1) / 127
    scale[scale == 0] = 1
    codes = np.rint(x / scale[:, None])
    spelled = codes * scale[:, None]
    slack = 1 + 1e-6
    return codes.astype(np.int8), scale, np.linalg.norm(spelled, axis=1) * slack, np.linalg.norm(x - spelled, axis=1) * slack + 1e-300


def best_of_tile(q_ids, q, q_packed, c_ids, c, c_packed, k: int, floor: np.ndarray):
    """(query row, candidate id, score) of the k best candidates of each query, its own row left out. ``q_packed`` and
    ``c_packed`` are what ``quantised`` makes of ``q`` and ``c``.

    ``floor`` holds a score that k candidates of earlier tiles reach already, or -inf.
    """
    q_codes, q_scale, q_norm, q_rest = q_packed
    c_codes, c_scale, c_norm, c_rest = c_packed
    near = q_codes.astype(np.float32) @ c_codes.astype(np.float32).T  # whole numbers, exact up to 1,000 dimensions
    near = near.astype(np.float64) * q_scale[:, None] * c_scale[None, :]
    bound = q_norm[:, None] * c_rest[None, :] + q_rest[:, None] * (c_norm + c_rest)[None, :]
    bound = bound * (1 + 1e-9) + np.abs(near) * 1e-12 + (1e-6 * np.abs(near) if q.shape[1] > 1000 else 0)
    own = q_ids[:, None] == c_ids[None, :]
    near[own] = -np.inf
    lower = near - bound
    if lower.shape[1] > k:
        kth = np.partition(lower, lower.shape[1] - k, axis=1)[:, lower.shape[1] - k]
        floor = np.maximum(floor, kth)
    row, column = np.nonzero((near + bound >= floor[:, None]) & ~own)
    score = np.zeros(len(row))
    for d in range(q.shape[1]):  # one dimension after another: each sum is rounded in the same order everywhere
        score += q[row, d] * c[column, d]
    return _best(row, c_ids[column], score, k)


def _best(row, ids, score, k: int):
    order = np.lexsort((ids, -score, row))
    row, ids, score = row[order], ids[order], score[order]
    first = np.searchsorted(row, row)
    keep = np.arange(len(row)) - first < k
    return row[keep], ids[keep], score[keep]


def _blocks(vectors: DataFrame, size: int) -> DataFrame:
    """Vectors (vec_id, v) as rows of at most ``size`` packed vectors of one dimension."""

    def pack(batches):
        held: dict[int, list] = {}

        def row(dim):
            ids, data = zip(*held.pop(dim))
            data = np.array(data, np.float64)
            codes, *facts = quantised(data)
            packed = [pa.array([x.tobytes()], pa.binary()) for x in (np.array(ids, np.int64), codes, np.stack(facts), data)]
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([ids[0]], pa.int64()), *packed], names=["dim", "first", "ids", "codes", "facts", "data"])

        for batch in batches:
            lists = batch.column("v")
            offsets = lists.offsets.to_numpy()
            flat = lists.values.to_numpy(zero_copy_only=False)
            for at, number in enumerate(batch.column("vec_id").to_pylist()):
                values = flat[offsets[at] : offsets[at + 1]]
                own = held.setdefault(len(values), [])
                own.append((number, values))
                if len(own) == size:
                    yield row(len(values))
        for dim in list(held):
            yield row(dim)

    return vectors.mapInArrow(pack, BLOCK)


def _dealt(count: int):
    """One of ``count`` parts for a block, by a hash of its first id."""
    return F.pmod(F.xxhash64("first"), F.lit(count)).cast("long")


def _unpacked(read, side: str, dim: int):
    """Ids, vectors, and codes, scales and norms of a block."""
    facts = read(f"{side}facts", np.float64).reshape(3, -1)
    return read(f"{side}ids", np.int64), read(f"{side}data", np.float64).reshape(-1, dim), [read(f"{side}codes", np.int8).reshape(-1, dim), *facts]


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` candidates with the largest inner products of each query: query_id, rank (from 1), vec_id, score.

    Both tables have ``id_col`` and ``vector_col``; a candidate with the query's own id is not its neighbour. Ties go to
    the smaller id. Scores are sums of products in double precision, in the order of dimensions. Rows with a null id,
    and vectors that are null, empty, zero or hold a null or non-finite component, take no part; vectors of different
    length do not meet. A repeated candidate id counts once (its greatest vector); a repeated query id too. Fewer
    candidates give fewer rows; an empty table none. Further columns are not read.
    """

    def clean(table: DataFrame) -> DataFrame:
        v = F.col(vector_col).cast("array<double>")
        table = table.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and size(v) > 0")
        finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
        table = table.where(finite & F.exists("v", lambda x: x != 0))
        return table.groupBy("vec_id").agg(F.max("v").alias("v"))

    n, asked_n = vectors.count(), queries.count()
    # a grid of cells: strips of candidates by groups of queries; a task works through one cell
    strips = max(1, -(-n // (CANDIDATES * STRIP)), min(-(-n // CANDIDATES), 16))
    groups = max(1, -(-asked_n // (QUERIES * STRIP)))
    candidates = _blocks(clean(vectors), CANDIDATES).withColumn("strip", _dealt(strips))
    candidates = candidates.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)).cast("array<long>")))
    asked = _blocks(clean(queries), QUERIES).withColumn("group", _dealt(groups))
    asked = asked.withColumn("strip", F.explode(F.sequence(F.lit(0), F.lit(strips - 1)).cast("array<long>")))
    packed = ("ids", "codes", "facts", "data")
    asked = asked.select("dim", "strip", "group", F.col("first").alias("block"), *[F.col(c).alias(f"q_{c}") for c in packed])
    tiles = candidates.select("dim", "strip", "group", *packed).join(asked, ["dim", "strip", "group"])

    def search(batches):
        # best so far of each part of a query block, which its first id tells; the k-th is the next tile's floor
        held: dict[tuple[int, int], tuple] = {}

        def flush():
            for ids, (row, found, score) in held.values():
                yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(found), pa.array(score)], names=["query_id", "vec_id", "score"])
            held.clear()

        for batch in batches:
            for at in range(batch.num_rows):
                dim, block = batch.column("dim")[at].as_py(), batch.column("block")[at].as_py()
                read = lambda name, kind: np.frombuffer(batch.column(name)[at].as_buffer(), kind)  # noqa: B023, E731
                (q_ids, q, q_packed), (c_ids, c, c_packed) = (_unpacked(read, side, dim) for side in ("q_", ""))
                for low in range(0, len(q_ids), PART):
                    part = slice(low, low + PART)
                    ids, own = q_ids[part], q[part]
                    _, before = held.get((block, low), (ids, None))
                    floor = np.full(len(ids), -np.inf)
                    if before:
                        last = np.flatnonzero(np.bincount(before[0], minlength=len(ids)) == k)
                        floor[last] = before[2][np.searchsorted(before[0], last, "right") - 1]
                    new = best_of_tile(ids, own, [x[part] for x in q_packed], c_ids, c, c_packed, k, floor)
                    if before:
                        new = _best(*(np.concatenate(x) for x in zip(before, new)), k)
                    held[block, low] = (ids.copy(), new)
                if len(held) > HELD:
                    yield from flush()
        yield from flush()

    found = tiles.mapInArrow(search, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
