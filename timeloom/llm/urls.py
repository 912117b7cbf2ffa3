"""URL filters: longest-match host and path rules, and exact list membership by a Bloom filter cascade."""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

#: Keys in one shard of a cascade; bounds a task's memory.
SHARD_KEYS = 500_000
#: Bytes of filters that one pass over the keys may broadcast.
PASS_BYTES = 64 << 20


# ---- hosts, paths and rules ----------------------------------------------------------------------------------------


def host_of(url: Column) -> Column:
    """From the first :// to the next / ? # or the end, A-Z lower-cased; empty without ://."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    return F.coalesce(F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end; empty without ://."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    return F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules: dict[str, str]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls. A rule ``host/path`` fits its host and all its
    subdomains if the path starts with its own. Rules are a parameter of at most a few hundred entries."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text in sorted(rules, key=len):  # the longest comes last, so it is tested first
        name, slash, own = text.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(slash + own))
        rule = F.when(fits, text).otherwise(rule)
        verdict = F.when(fits, rules[text]).otherwise(verdict)
    return rule, verdict


# ---- the cascade ---------------------------------------------------------------------------------------------------


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _spots(h1: np.ndarray, h2: np.ndarray, level: int, bits: int, hashes: int) -> np.ndarray:
    """Bit numbers of each key in a level's filter, one column for each hash."""
    base = _scramble(h1 + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
    step = _scramble(h2 ^ base) | np.uint64(1)
    return np.stack([(base + np.uint64(n) * step) % np.uint64(bits) for n in range(hashes)], axis=1).astype(np.int64)


def _contains(packed: np.ndarray, h1, h2, level: int, bits: int, hashes: int) -> np.ndarray:
    at = _spots(h1, h2, level, bits, hashes)
    return (packed[at >> 3] >> (at & 7) & 1).all(axis=1)


def build_levels(h1: np.ndarray, h2: np.ndarray, listed: np.ndarray) -> list[tuple[int, int, bytes]]:
    """Filters (bits, hashes, content) of one shard's universe: level 0 encodes the listed keys, each further level
    the false positives of the one before, until there are none."""
    inside, outside = np.flatnonzero(listed), np.flatnonzero(~listed)
    levels: list[tuple[int, int, bytes]] = []
    while len(inside):
        rate = 0.5
        if not levels and len(outside):
            rate = min(0.5, len(inside) * 0.5**0.5 / len(outside))
        hashes = max(1, round(-np.log2(rate)))
        bits = max(64, int(np.ceil(len(inside) * hashes / np.log(2))))
        table = np.zeros(bits, np.uint8)
        table[_spots(h1[inside], h2[inside], len(levels), bits, hashes)] = 1
        packed = np.packbits(table, bitorder="little")
        wrong = outside[_contains(packed, h1[outside], h2[outside], len(levels), bits, hashes)]
        levels.append((bits, hashes, packed.tobytes()))
        inside, outside = wrong, inside
        if len(levels) % 64 == 0:
            if {*zip(h1[inside].tolist(), h2[inside].tolist())} & {*zip(h1[outside].tolist(), h2[outside].tolist())}:
                raise ValueError("a listed key and another have the same 128-bit hash, so no level tells them apart")
    return levels


def look_up(levels: list[tuple[int, int, bytes]], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Membership of keys of the universe: exact. The first level that lacks a key decides: odd ones say listed."""
    member = np.zeros(len(h1), bool)
    open_ = np.arange(len(h1))
    for level, (bits, hashes, content) in enumerate(levels):
        has = _contains(np.frombuffer(content, np.uint8), h1[open_], h2[open_], level, bits, hashes)
        member[open_[~has]] = level % 2 == 1
        open_ = open_[has]
    member[open_] = len(levels) % 2 == 1
    return member


def _hashed(keys: DataFrame, key: Column, shards: int) -> DataFrame:
    h1 = F.xxhash64(key)
    return keys.withColumns({"h1": h1, "h2": F.xxhash64(key, F.lit("second")), "shard": F.pmod(F.xxhash64(F.lit("shard"), key), F.lit(shards)).cast("int")})


def build_cascade(universe: DataFrame, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """A cascade over all keys of a corpus: ``universe`` has distinct rows (key, listed). One saved row for each shard:
    (shard, shards, levels); a shard is one hash range of keys, built in one task of bounded size."""
    shards = max(1, -(-universe.count() // shard_keys))

    def build(table: pa.Table) -> pa.Table:
        h1, h2 = (table.column(x).to_numpy().view(np.uint64) for x in ("h1", "h2"))
        levels = build_levels(h1, h2, table.column("listed").to_numpy(zero_copy_only=False))
        rows = [{"bits": b, "hashes": h, "content": c} for b, h, c in levels]
        kind = pa.list_(pa.struct([("bits", pa.int64()), ("hashes", pa.int32()), ("content", pa.binary())]))
        return pa.table({"shard": table.column("shard").slice(0, 1), "shards": pa.array([shards], pa.int32()), "levels": pa.array([rows], kind)})

    keyed = _hashed(universe, F.col("key"), shards).select("shard", "h1", "h2", "listed")
    return saved(keyed.groupBy("shard").applyInArrow(build, "shard int, shards int, levels array<struct<bits: long, hashes: int, content: binary>>"), "cascade")


def members(rows: DataFrame, key_col: str, cascade: DataFrame, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """Add ``listed`` to rows whose keys belong to the cascade's universe; no join, no shuffle.

    The filters are sent to the executors. Their size is summed first: if they exceed ``pass_bytes``, the shards are
    sent in several passes of at most that much, each pass over the rows of its shards only.
    """
    content = F.aggregate("levels", F.lit(0).cast("long"), lambda n, x: n + F.length(x["content"]))
    sizes = cascade.select("shard", "shards", content.alias("bytes")).orderBy("shard").collect()
    if not sizes:
        return rows.withColumn("listed", F.lit(False))
    shards, passes, room = sizes[0]["shards"], [[]], 0
    for row in sizes:
        if passes[-1] and room + row["bytes"] > pass_bytes:
            passes.append([])
            room = 0
        passes[-1].append(row["shard"])
        room += row["bytes"]
    keyed = _hashed(rows, F.col(key_col), shards)
    if len(passes) > 1:
        keyed = saved(keyed, "keys")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", listed boolean"
    columns, out = rows.columns, None
    for part in passes:
        got = cascade.where(F.col("shard").isin(part)).collect()
        sent = rows.sparkSession.sparkContext.broadcast({r["shard"]: [(x["bits"], x["hashes"], bytes(x["content"])) for x in r["levels"]] for r in got})

        def run(batches, sent=sent):
            for batch in batches:
                shard = batch.column("shard").to_numpy()
                h1, h2 = (batch.column(x).to_numpy().view(np.uint64) for x in ("h1", "h2"))
                listed = np.zeros(batch.num_rows, bool)
                for number in np.unique(shard):
                    at = np.flatnonzero(shard == number)
                    listed[at] = look_up(sent.value.get(int(number), []), h1[at], h2[at])
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in columns] + [pa.array(listed)], names=[*columns, "listed"])

        own = keyed if len(passes) == 1 else keyed.where(F.col("shard").isin(part))
        found = own.mapInArrow(run, fields)
        out = found if out is None else out.unionByName(found)
    return out


# ---- the operator --------------------------------------------------------------------------------------------------


def judge_urls(pages: DataFrame, listed_hosts: DataFrame, rules: dict[str, str], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict (allow or block).

    The longest rule that fits decides; where none fits, a page is blocked if its host is in ``listed_hosts`` (column
    host). Membership comes from a cascade over all hosts of the pages, so it is exact for every page.

    A null url, or one without ://, has an empty host and path, which are judged like others. Repeated rows are judged
    one by one; repeated and null list entries are of no matter; an empty list blocks nothing; further columns are not
    read. An empty table gives an empty result.
    """
    found = pages.select(F.col(id_col).cast("long").alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    found = saved(found, "urls")
    marks = found.select(F.col("host").alias("key"), F.lit(False).alias("listed"), F.lit(True).alias("seen"))
    marks = marks.unionByName(listed_hosts.where("host is not null").select(F.col("host").alias("key"), F.lit(True).alias("listed"), F.lit(False).alias("seen")))
    universe = marks.groupBy("key").agg(F.max("listed").alias("listed"), F.max("seen").alias("seen"))
    cascade = build_cascade(saved(universe.where("seen or listed").select("key", "listed"), "universe"))
    judged = members(found, "host", cascade)
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"))
