"""Connected components of a link table by alternating large and small stars; nothing is gathered in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, saved


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on distinct edges (u, v) with v < u."""
    if large:
        sides = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = sides.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        out = sides.where("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        lowest = edges.groupBy("u").agg(F.min("v").alias("m"))
        out = edges.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = out.unionAll(lowest.select("u", F.col("m").alias("v")))
    return out.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def settled(edges: DataFrame) -> bool:
    """Whether edges (u, v) are stars: every node has one link at most, to a node that has none."""
    ends = edges.select("u", F.lit(1).alias("up")).unionAll(edges.select(F.col("v").alias("u"), F.lit(0).alias("up")))
    return ends.groupBy("u").agg(F.sum("up").alias("ups"), F.min("up").alias("low")).where("ups > 1 or ups = 1 and low = 0").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (columns a, b) but the roots; the root is the smallest node reachable.

    Links in either direction, repeated links and loops are fine; an empty table gives an empty one.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = saved(edges, "edges")
    while not settled(edges):
        before, edges = edges, saved(_star(_star(edges, large=True), large=False), "edges")
        forget(before)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def joined(left: DataFrame, right: DataFrame) -> DataFrame:
    """Classes that hold together what either side does: both give doc_id, rk and component (long) for the same rows.

    A class of ``right`` links the classes of ``left`` that it meets, as a star; the result is one row for each of ``left``."""
    met = left.select("doc_id", "rk", "component")
    other = right.select("doc_id", "rk", F.col("component").alias("other")).distinct()
    both = saved(met.join(other, (met["rk"] == other["rk"]) & met["doc_id"].eqNullSafe(other["doc_id"])).select(met["doc_id"], met["rk"], "component", "other"), "classes")
    pairs = both.select("component", "other").distinct()
    centres = pairs.groupBy("other").agg(F.min("component").alias("a"), F.count("*").alias("n")).where("n > 1")
    links = pairs.join(centres, "other").where("a <> component").select("a", F.col("component").alias("b"))
    roots = components(links)
    named = both.join(roots, both["component"] == roots["node"], "left")
    return named.select("doc_id", "rk", F.coalesce("root", "component").alias("component"))
