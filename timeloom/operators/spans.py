"""Interval algebra on spans (media_id, seq, start_s, end_s) of silence and speech."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .timeline import Greedy, before, greedy_groups, in_order, renumbered


def parse_silence_log(lines: DataFrame) -> DataFrame:
    """Silences out of log lines (media_id, line_no, line): an end counts if the event before it is a start."""
    number = lambda kind: F.regexp_extract("line", rf"silence_{kind}:\s*([0-9.]+)", 1).try_cast("double")
    start = number("start")
    events = lines.select("media_id", F.col("line_no").alias("seq"), start.alias("start"), F.when(start.isNull(), number("end")).alias("end"))
    events = events.where("start is not null or end is not null").withColumn("start_s", F.lag("start").over(in_order()))
    found = events.where("end is not null and start_s is not null and end > start_s")
    return renumbered(found.select("media_id", "seq", "start_s", F.col("end").alias("end_s")), "seq")


def pad_span(start: Column, end: Column, duration: Column, padding_s: float) -> tuple[Column, Column]:
    return F.greatest(F.lit(0.0), start - padding_s), F.least(duration, end + padding_s)


def padded(spans: DataFrame, media: DataFrame, padding_s: float) -> DataFrame:
    joined = spans.join(media.select("media_id", "duration_s"), "media_id")
    start, end = pad_span(F.col("start_s"), F.col("end_s"), F.col("duration_s"), padding_s)
    return joined.select("media_id", "seq", start.alias("start_s"), end.alias("end_s"))


def long_enough(spans: DataFrame, min_duration_s: float) -> DataFrame:
    return spans.where(F.col("end_s") - F.col("start_s") >= min_duration_s)


def split_spans(spans: DataFrame, max_duration_s: float) -> DataFrame:
    """Pieces of ``max_duration_s`` and the rest."""
    size = F.col("end_s") - F.col("start_s")
    whole = F.greatest(F.lit(0), F.ceil(size / max_duration_s) - 1)
    pieces = spans.where("end_s > start_s").select("media_id", "seq", "start_s", "end_s", F.explode(F.sequence(F.lit(0).cast("long"), whole)).alias("n"), whole.alias("whole"))
    end = F.when(F.col("n") < F.col("whole"), F.col("start_s") + (F.col("n") + 1) * max_duration_s).otherwise(F.col("end_s"))
    cut = pieces.select("media_id", "seq", "n", (F.col("start_s") + F.col("n") * max_duration_s).alias("start_s"), end.alias("end_s"))
    return renumbered(cut, "seq", "n").select("media_id", "seq", "start_s", "end_s")


def merge_spans(spans: DataFrame, max_duration_s: float, merge_gap_s: float = 0.0, profile: str = "standalone") -> DataFrame:
    """Merge neighbours: the merged span ends where its last one does.

    ``standalone`` always merges spans that overlap or touch, others up to ``merge_gap_s`` apart if the whole stays
    within ``max_duration_s``; ``docker`` asks for both conditions always.
    """
    rule = Greedy(merge_gap_s, max_duration_s, [], glue=profile == "standalone")
    numbered = greedy_groups(spans.select("media_id", "seq", "start_s", "end_s"), rule, F.col("start_s"), F.col("end_s"))
    merged = numbered.groupBy("media_id", "group").agg(F.min_by("start_s", "seq").alias("start_s"), F.max_by("end_s", "seq").alias("end_s"))
    return merged.select("media_id", F.col("group").alias("seq"), "start_s", "end_s")


def normalize_spans(spans: DataFrame, media: DataFrame, min_duration_s: float, max_duration_s: float, padding_s: float = 0.0, merge_gap_s: float = 0.0, profile: str = "standalone") -> DataFrame:
    """Drop short spans, pad the others inside the media, merge neighbours, split long ones."""
    kept = padded(long_enough(spans, min_duration_s), media, padding_s)
    return split_spans(merge_spans(kept, max_duration_s, merge_gap_s, profile), max_duration_s)


def complement_spans(silences: DataFrame, media: DataFrame, min_duration_s: float, max_duration_s: float, padding_s: float = 0.0, merge_gap_s: float = 0.0, profile: str = "standalone") -> DataFrame:
    """Speech between silences: gaps of ``min_duration_s`` at least after everything before, then as ``normalize_spans``.

    ``standalone`` tests the shortest duration once more on padded spans, ``docker`` does not.
    """
    cursor = F.greatest(F.lit(0.0), F.coalesce(F.max("end_s").over(before()), F.lit(0.0)))
    gaps = silences.select("media_id", "seq", cursor.alias("from_s"), F.col("start_s").alias("to_s"))
    ends = silences.groupBy("media_id").agg(F.max("end_s").alias("end_s"), F.max("seq").alias("seq"))
    tails = media.join(ends, "media_id", "left").select("media_id", (F.coalesce("seq", F.lit(0)) + 1).alias("seq"), F.greatest(F.lit(0.0), F.coalesce("end_s", F.lit(0.0))).alias("from_s"), F.col("duration_s").alias("to_s"))
    speech = gaps.unionByName(tails).where(F.col("to_s") - F.col("from_s") >= min_duration_s)
    speech = padded(speech.select("media_id", "seq", F.col("from_s").alias("start_s"), F.col("to_s").alias("end_s")), media, padding_s)
    if profile == "standalone":
        speech = padded(long_enough(speech, min_duration_s), media, 0.0)
    return split_spans(merge_spans(speech, max_duration_s, merge_gap_s, profile), max_duration_s)


def merge_overlapping_spans(spans: DataFrame, tolerance_s: float = 0.05) -> DataFrame:
    """Union of spans sorted by (start, end) that start at most ``tolerance_s`` after everything before them ends."""
    ordered = renumbered(spans, "start_s", "end_s")
    reach = F.max("end_s").over(before())
    marked = ordered.withColumn("island", F.sum(F.when(reach.isNull() | (F.col("start_s") > reach + tolerance_s), 1).otherwise(0)).over(in_order()))
    merged = marked.groupBy("media_id", "island").agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"))
    return renumbered(merged, "island").select("media_id", "seq", "start_s", "end_s")


def chunk_grid(media: DataFrame, chunk_s: float = 1800.0, overlap_s: float = 1.0) -> DataFrame:
    """Overlapping frame ranges (media_id, chunk_no, first_frame, frames) of media (media_id, sample_rate, frames)."""
    rate, total = F.col("sample_rate"), F.col("frames")
    size = F.greatest(F.lit(1), F.floor(rate * chunk_s))
    stride = F.greatest(F.lit(1), size - F.floor(rate * overlap_s))
    count = F.greatest(F.lit(0), F.ceil((total - size) / stride)) + 1
    grid = media.where("frames > 0").select("media_id", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)).alias("chunk_no"), size.alias("size"), stride.alias("stride"), total.alias("total"))
    first = F.col("chunk_no") * F.col("stride")
    return grid.select("media_id", "chunk_no", first.alias("first_frame"), F.least(F.col("size"), F.col("total") - first).alias("frames"))


def span_report(spans: DataFrame, digits: int = 3, numbered: bool = False) -> DataFrame:
    """One row per media: its spans with rounded times and, if ``numbered``, their seq, which tells spans apart that
    rounding makes alike."""
    rounded = lambda c: F.bround(c, digits)
    entry = F.struct("seq", rounded(F.col("start_s")).alias("start"), rounded(F.col("end_s")).alias("end"), rounded(F.col("end_s") - F.col("start_s")).alias("duration"))
    listed = spans.groupBy("media_id").agg(F.array_sort(F.collect_list(entry)).alias("spans"))
    if numbered:
        return listed
    return listed.withColumn("spans", F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["duration"].alias("duration"))))
