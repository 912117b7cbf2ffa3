"""Near-duplicates by verified similarity of shingle sets.

The similarity of two documents is the Jaccard index of their sets of word shingles. Candidates share a key: a hash of
``ROWS`` minima of the set under random orders; there are ``BANDS`` keys. A pair of similarity s shares at least one with
probability 1 - (1 - s**ROWS)**BANDS: 0.99993 at 0.8 and more above. No pair is linked unless its sets, compared in full,
are similar enough.

Equal sets, told by a 128-bit digest of the sorted set, are folded into one first, which gets a number of its own. Under each key the sets are then compared along a chain in an order of the key's
own, so the many near copies of one document are mostly joined by few comparisons, none of which has a centre. All pairs
under a key that the chains did not bring into one component are compared after that: the key's sets are dealt to blocks,
and each pair of blocks is a tile whose common members a matrix product counts. Pairs never become rows; a tile gives a
star at most. So the components are those that comparing all pairs of every key would give.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed_texts, may_be_among, same_doc, saved, slices, utf8_parts
from .components import components
from .rolling import mixed, word_bounds, word_values
from .simhash import _forest as forest
from .simhash import fingerprints_of, first_of_each

#: Keys of a set, and minima in each; see above for the pairs they find.
BANDS, ROWS = 24, 5
_LOWER = bytes(x + 32 if 65 <= x <= 90 else x for x in range(256))
_ORDERS = np.random.default_rng(20240918).integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Bytes of texts in one unit of work; bounds memory, not results.
SLICE = 1 << 20
#: Shingles and sets in a block of a key's sets, and columns of one membership matrix; bound a tile's memory.
BLOCK, BLOCK_SETS, COLUMNS = 1 << 19, 1024, 2048


#: Words of more bytes are hashed one by one: sums of powers tell short words apart, but not all long ones.
LONG_WORD = 64


def shingle_hash(values: np.ndarray, width: int) -> np.ndarray:
    """A hash of every ``width`` consecutive words: each word's hash is scrambled into those before it."""
    n = len(values) - width + 1
    found = np.full(n, width, np.uint64)
    for at in range(width):
        found = mixed(found * np.uint64(0x9E3779B97F4A7C15) + values[at : at + n])
    return found


def shingle_sets(text: pa.Array, shingle_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each text's word shingles, in order and end to end, and the bounds (n + 1) of each text's.

    Words are lower-cased in A-Z; a text with fewer words than a shingle is one shingle, one without words has none.
    """
    raw, offsets = utf8_parts(text)
    data = raw.tobytes().translate(_LOWER)
    plain = np.frombuffer(data, np.uint8)
    start, end, bounds = word_bounds(plain, offsets)
    values = word_values(plain, start, end) if len(start) else np.zeros(0, np.uint64)
    for n in np.flatnonzero(end - start > LONG_WORD).tolist():
        values[n] = xxhash.xxh3_64_intdigest(data[start[n] : end[n]])
    sets = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        sets.append(np.unique(shingle_hash(values[a:b], min(shingle_words, b - a))) if b > a else np.zeros(0, np.uint64))
    return np.concatenate([*sets, np.zeros(0, np.uint64)]), np.cumsum([0, *map(len, sets)])


def set_digests(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """128 bits of each set as two numbers (sets x 2)."""
    data = hashes.tobytes()
    digests = [xxhash.xxh3_128_digest(data[8 * a : 8 * b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
    return np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)


def set_keys(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The keys of each set (sets x BANDS)."""
    n = len(bounds) - 1
    keys = np.zeros((n, BANDS), np.uint64)
    filled = np.flatnonzero(np.diff(bounds))
    if len(filled):
        start = bounds[filled]
        for at, order in enumerate(_ORDERS):
            low = np.minimum.reduceat(hashes * order, start)
            keys[filled, at // ROWS] = mixed(keys[filled, at // ROWS] + low + np.uint64(at))
    return keys


def described(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, with_fp: bool = False) -> DataFrame:
    """Saved: digest (d1, d2), size and keys of each document's (doc_id, rk) set and, if ``with_fp``, the fingerprint (fp) of
    operator 4 on the same shingles, so that texts are read once for both."""

    def run(batches):
        for batch in slices(batches, SLICE):
            hashes, bounds = shingle_sets(batch.column("text"), shingle_words)
            digests, keys = set_digests(hashes, bounds), set_keys(hashes, bounds)
            at = np.arange(0, keys.size + 1, BANDS, dtype=np.int32)
            halves = [pa.array(digests[:, n].copy()) for n in (0, 1)]
            columns = [batch.column("doc_id"), batch.column("rk"), *halves, pa.array(np.diff(bounds)), pa.ListArray.from_arrays(at, keys.ravel().view(np.int64))]
            columns += [fingerprints_of(batch.column("text"), shingle_words)] if with_fp else []
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "rk", "d1", "d2", "size", "keys", "fp"][: len(columns)])

    ddl = "doc_id long, rk long, d1 long, d2 long, size long, keys array<long>" + ", fp long" * with_fp
    return saved(keyed_texts(docs, id_col, text_col).mapInArrow(run, ddl), "described")


def _sets(shingle_words: int):
    def run(batches):
        for batch in slices(batches, SLICE):
            hashes, bounds = shingle_sets(batch.column("text"), shingle_words)
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.ListArray.from_arrays(bounds.astype(np.int32), hashes.view(np.int64))], names=["node", "shingles"])

    return run


def similar_rows(hashes: np.ndarray, row: np.ndarray, size: np.ndarray, percent: int) -> np.ndarray:
    """Which of n sets, given as (hash, row) pairs, are similar to which: a boolean matrix. Common members are counted
    by products of membership matrices, some members at a time."""
    n = len(size)
    order = np.argsort(hashes, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = hashes[order[1:]] != hashes[order[:-1]]
    member = np.cumsum(new) - 1
    shared = np.bincount(member)[member] > 1
    member, of = np.unique(member[shared], return_inverse=True)[1], row[order[shared]]
    common = np.zeros((n, n), np.float32)  # whole numbers, exact
    cuts = np.searchsorted(member, np.arange(0, (member[-1] + 1 if len(member) else 0) + COLUMNS, COLUMNS))
    for n_part, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
        part = np.zeros((n, COLUMNS), np.float32)
        part[of[a:b], member[a:b] - n_part * COLUMNS] = 1
        common += part @ part.T
    return 100 * common >= percent * (size[:, None] + size[None, :] - common)


def _tiled(percent: int):
    """Links within one tile of a key: rows of two blocks of its sets, or of one."""

    def tile(table: pa.Table) -> pa.Table:
        node, at = np.unique(table.column("node").to_numpy(), return_index=True)
        table = table.take(pa.array(at))
        label, size = table.column("label").to_numpy(), table.column("size").to_numpy()
        lists = table.column("shingles").combine_chunks()
        similar = similar_rows(lists.flatten().to_numpy(), np.repeat(np.arange(len(node)), size), size, percent)
        a, b = np.nonzero(similar & (label[:, None] < label[None, :]))
        root = forest(len(node), a, b)
        far = np.flatnonzero(root != np.arange(len(node)))
        return pa.table({"a": pa.array(node[root[far]]), "b": pa.array(node[far])})

    return tile


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets have a Jaccard index of at least ``percent`` / 100."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("left"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("right"))
    both = pairs.join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("left", "right")).cast("long")
    return both.where(100 * common >= percent * (F.size("left") + F.size("right") - common)).select("a", "b")


def similar_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, percent: int = 80, marked: DataFrame | None = None) -> DataFrame:
    """One row per document: doc_id, rk and component, a key of the documents reachable by links.

    Documents link if the Jaccard index of their shingle sets is at least ``percent`` / 100; texts without words link
    among themselves. Rows that repeat an id are separate documents of one name. An empty table gives an empty result.
    ``marked`` is what ``described`` saved of the documents, if it has been called before. Only texts that may be of a set
    which meets another travel, told by a map of bits.
    """
    texts = keyed_texts(docs, id_col, text_col)
    marked = described(docs, id_col, text_col, shingle_words) if marked is None else marked
    distinct = saved(marked.where("size > 0").dropDuplicates(["d1", "d2"]).withColumn("node", F.monotonically_increasing_id()), "distinct")
    keyed = distinct.select("node", "size", F.posexplode("keys").alias("band", "key"))
    keyed = keyed.select(F.xxhash64("band", "key").alias("key"), "node", "size")
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    keyed = saved(keyed.join(shared, "key", "left_semi"), "keyed")
    meeting = saved(distinct.join(keyed.select("node").distinct(), "node", "left_semi").select("node", "doc_id", "rk"), "meeting")
    texts = may_be_among(texts, meeting).where("maybe")
    sets = texts.join(meeting, same_doc(texts, meeting)).select("node", "text").dropDuplicates(["node"]).mapInArrow(_sets(shingle_words), "node long, shingles array<long>")
    sets = saved(sets, "sets")

    def chain(batches):
        key, node, size = -1, 0, 0
        for batch in batches:
            keys, nodes, sizes = (np.append(x, batch.column(c).to_numpy()) for x, c in ((key, "key"), (node, "node"), (size, "size")))
            same = (keys[1:] == keys[:-1]) & (nodes[1:] != nodes[:-1])
            same &= 100 * np.minimum(sizes[1:], sizes[:-1]) >= percent * np.maximum(sizes[1:], sizes[:-1])
            a, b = nodes[:-1][same], nodes[1:][same]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])
            if len(keys):
                key, node, size = keys[-1], nodes[-1], sizes[-1]

    ordered = keyed.repartition("key").withColumn("order", F.xxhash64("key", "node")).sortWithinPartitions("key", "order").select("key", "node", "size")
    links = saved(_verified(ordered.mapInArrow(chain, "a long, b long").distinct(), sets, percent), "links")
    labels = components(links).withColumnRenamed("node", "own")
    named = keyed.join(labels, keyed["node"] == labels["own"], "left").select("key", "node", "size", F.coalesce("root", "node").alias("label"))
    mixed_keys = named.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("key")
    open_keys = saved(named.join(mixed_keys, "key", "left_semi"), "open")
    per = open_keys.groupBy("key").agg(F.ceil(F.greatest(F.sum("size") / BLOCK, F.count("*") / BLOCK_SETS)).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    rows = open_keys.join(per, "key").withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "node", "size", "label")
    tiles = rows.join(sets, "node").groupBy("key", "low", "high").applyInArrow(_tiled(percent), "a long, b long")
    more = saved(tiles.distinct(), "links")
    roots = components(links.unionByName(more)).withColumnRenamed("node", "own")
    named = distinct.join(roots, distinct["node"] == roots["own"], "left").select("d1", "d2", F.coalesce("root", "node").alias("component"))
    return marked.select("doc_id", "rk", "d1", "d2").join(named, ["d1", "d2"], "left").select("doc_id", "rk", F.coalesce("component", F.lit(-1)).alias("component"))


def one_of_each_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay when each class of similar documents keeps one."""
    return first_of_each(docs, similar_classes(docs, id_col, text_col, shingle_words, percent), id_col, text_col)
