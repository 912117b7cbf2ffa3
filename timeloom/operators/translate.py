"""Work around an external translator: batches and requests out, replies back in."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .timeline import Greedy, greedy_groups, numbered_in_blocks


def pack_batches(entries: DataFrame, batch_size: int = 50, text_split_size: int = 0) -> DataFrame:
    """Number batches of entries (media_id, seq, text): batch_no from 0, local_no from 1.

    A batch holds ``batch_size`` entries at most; with ``text_split_size`` it also closes before its texts, each with
    one separator, would come to that length.
    """
    if text_split_size <= 0:
        at = F.col("place") - 1
        rows = numbered_in_blocks(entries).withColumns({"batch_no": F.floor(at / batch_size).cast("int"), "local_no": (at % batch_size + 1).cast("int")})
    else:
        rule, never = Greedy(math.inf, math.inf, [batch_size, text_split_size - 1]), F.lit(0.0)
        rows = greedy_groups(entries, rule, never, never, sizes=[F.lit(1), F.length("text") + 1])
        rows = rows.withColumns({"batch_no": (F.col("group") - 1).cast("int"), "local_no": F.col("held").cast("int")})
    return rows.select(*entries.columns, "batch_no", "local_no")


def batch_requests(batched: DataFrame) -> DataFrame:
    """One request text for each batch: its entries as numbered lines."""
    line = F.concat(F.lit("["), F.col("local_no").cast("string"), F.lit("] "), F.col("text"))
    lists = batched.groupBy("media_id", "batch_no").agg(F.array_sort(F.collect_list(F.struct("local_no", line.alias("line")))).alias("l"))
    return lists.select("media_id", "batch_no", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("request"))


def parse_replies(replies: DataFrame, members: DataFrame, profile: str = "standalone") -> DataFrame:
    """Texts of entries out of replies (media_id, batch_no, reply); ``members`` has (media_id, batch_no, local_no, seq).

    A line "[n] x", "n. x" or "n) x" starts entry n of the batch, other lines go on with it; a number that the batch
    lacks discards what follows, and a number given twice counts as given last. ``standalone`` also parts labels that
    follow one another on a line and removes labels left in the text.
    """
    lines = F.filter(F.transform(F.split("reply", r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"), T.strip), lambda x: x != "")
    if profile == "standalone":
        parted = lambda x: F.when(x.rlike(r"(?U)^\d+[.)]\s+\[\d+\]\s+"), F.array(x)).otherwise(F.split(x, r"(?U)\s+(?=\[\d+\]\s+)"))
        lines = F.filter(F.transform(F.flatten(F.transform(lines, parted)), T.strip), lambda x: x != "")
    rows = replies.select("media_id", "batch_no", F.posexplode(lines).alias("at", "line"))
    strict, loose = r"(?Us)^\[(\d+)\]\s*(.*)$", r"(?Us)^(\d+)[.)]\s+(.*)$"
    group = lambda n: F.when(F.col("line").rlike(strict), F.regexp_extract("line", strict, n)).when(F.col("line").rlike(loose), F.regexp_extract("line", loose, n))
    order = Window.partitionBy("media_id", "batch_no").orderBy("at")
    rows = rows.select("media_id", "batch_no", "at", group(1).try_cast("int").alias("label"), F.coalesce(group(2), F.col("line")).alias("body"), group(1).isNotNull().alias("starts"))
    rows = rows.withColumn("block", F.count_if("starts").over(order))
    blocks = rows.where("block > 0").groupBy("media_id", "batch_no", "block").agg(F.max("label").alias("local_no"), F.array_sort(F.collect_list(F.struct("at", "body"))).alias("b"))
    text = F.array_join(F.filter(F.transform("b", lambda x: T.strip(x["body"])), lambda x: x != ""), " ")
    blocks = blocks.select("media_id", "batch_no", "block", "local_no", (T.clean_translation(text) if profile == "standalone" else T.strip(text)).alias("text"))
    latest = blocks.where("local_no is not null").groupBy("media_id", "batch_no", "local_no").agg(F.max_by("text", "block").alias("text"))
    return latest.join(members.select("media_id", "batch_no", "local_no", "seq"), ["media_id", "batch_no", "local_no"]).select("media_id", "seq", "text")


def merge_replies(entries: DataFrame, parsed: DataFrame) -> DataFrame:
    """Entries with their translation; fixed translations of short reactions go before replies."""
    rows = entries.join(parsed.withColumnRenamed("text", "reply"), ["media_id", "seq"], "left")
    return rows.withColumn("translation", F.coalesce(T.translation_override(F.col("text")), T.strip(F.col("reply")), F.lit(""))).drop("reply")


def missing_translations(merged: DataFrame) -> DataFrame:
    """Entries to be asked for again."""
    return merged.where(T.strip(F.col("translation")) == "")


def cardinality_check(expected: DataFrame, written: DataFrame) -> DataFrame:
    """Media whose numbers of rows differ: (media_id, expected, found)."""
    count = lambda rows, name: rows.groupBy("media_id").agg(F.count("*").alias(name))
    both = count(expected, "expected").join(count(written, "found"), "media_id", "full").na.fill(0, ["expected", "found"])
    return both.where("expected <> found")


def translation_metadata(merged: DataFrame, batch_size: int, model: str) -> DataFrame:
    """One row per media: what was translated, and what is still missing."""
    missing = F.count_if(T.strip(F.col("translation")) == "").alias("missing_count")
    return merged.groupBy("media_id").agg(F.count("*").alias("subtitle_count"), missing, F.lit(batch_size).alias("batch_size"), F.lit(model).alias("model"))
