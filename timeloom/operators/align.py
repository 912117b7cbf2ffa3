"""External alignments merged into cues."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def merge_alignment(cues: DataFrame, aligned: DataFrame, preserve_end: bool = True, min_s: float = 0.8) -> DataFrame:
    """Times of aligned segments (media_id, seq, start_s, end_s, text, words) for the cues with their number: the
    segment's own if they make sense, else those of its words, else the cue's. Cues without a segment stay."""
    found = aligned.select("media_id", "seq", F.lit(True).alias("found"), F.col("start_s").alias("a"), F.col("end_s").alias("b"), F.col("text").alias("said"), "words")
    rows = cues.join(found, ["media_id", "seq"], "left")
    sound = F.coalesce(F.col("b") > F.col("a"), F.lit(False))
    word = lambda pick, field: pick(F.transform("words", lambda w: w[field]))
    start = F.greatest(F.lit(0.0), F.when(sound, F.col("a")).otherwise(F.coalesce(word(F.array_min, "start_s"), F.col("start_s"))))
    end = F.when(sound, F.col("b")).otherwise(F.coalesce(word(F.array_max, "end_s"), F.col("end_s")))
    if preserve_end:
        end = F.when(F.col("end_s") > start, F.greatest(end, F.col("end_s"))).otherwise(end)
    end = F.greatest(start + min_s, end)
    said = T.clean_text(F.coalesce(F.when(F.col("said") != "", F.col("said")), F.col("text")))
    text = F.when(said != "", said).otherwise(F.col("text"))
    pick = lambda new, old: F.when(F.col("found"), new).otherwise(F.col(old)).alias(old)
    return rows.select("media_id", "seq", pick(start, "start_s"), pick(end, "end_s"), pick(text, "text"))


def alignment_report(cues: DataFrame, merged: DataFrame, aligned: DataFrame) -> DataFrame:
    """One row per media: counts, cues moved by 0.02 s or more, and old and new times of each cue."""
    new = merged.select("media_id", "seq", F.col("start_s").alias("new_start"), F.col("end_s").alias("new_end"), F.col("text").alias("new_text"))
    rows = cues.join(new, ["media_id", "seq"])
    moved = (F.abs(F.col("new_start") - F.col("start_s")) >= 0.02) | (F.abs(F.col("new_end") - F.col("end_s")) >= 0.02)
    entry = F.struct("seq", *[F.bround(c, 3).alias(n) for c, n in (("start_s", "original_start"), ("end_s", "original_end"), ("new_start", "aligned_start"), ("new_end", "aligned_end"))], F.col("new_text").alias("text"))
    out = rows.groupBy("media_id").agg(F.count("*").alias("input_count"), F.count_if(moved).alias("changed_count"), F.array_sort(F.collect_list(entry)).alias("segments"))
    counts = aligned.groupBy("media_id").agg(F.count("*").alias("aligned_count"))
    return out.join(counts, "media_id", "left").withColumn("aligned_count", F.coalesce("aligned_count", F.lit(0).cast("long")))
