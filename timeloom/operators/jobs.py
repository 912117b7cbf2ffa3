"""Pending work, coverage and outcomes over a whole archive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import translated_name
from ..functions.timing import realtime_factor
from .quality import stage_counters

#: Suffixes of supported media.
VIDEO = ("mp4", "mkv", "avi", "mov", "webm", "m4v", "ts", "m2ts")
AUDIO = ("mp3", "wav", "m4a", "flac", "aac", "ogg", "opus", "wma")


def last_end(cues: DataFrame) -> DataFrame:
    """End of each media's last cue by position, which need not be the latest end."""
    return cues.groupBy("media_id").agg(F.max_by("end_s", "seq").alias("last_end_s"))


def coverage_status(cues: DataFrame, media: DataFrame, min_ratio: float = 0.70, max_tail_s: float = 300.0, enabled: bool = True) -> DataFrame:
    """(media_id, duration_s, last_end_s, status): suspicious if cues end both early in proportion and long before."""
    rows = media.select("media_id", "duration_s").join(last_end(cues), "media_id", "left").withColumn("last_end_s", F.coalesce("last_end_s", F.lit(0.0)))
    duration, end = F.col("duration_s"), F.col("last_end_s")
    short = (duration > 0) & (end / duration < min_ratio) & (duration - end > max_tail_s) & F.lit(enabled)
    return rows.withColumn("status", F.when(F.coalesce(short, F.lit(False)), "suspicious_incomplete").otherwise("success"))


def disposition(status: Column, delete_on_success: Column, suspicious: str = "failed") -> Column:
    return F.when((status == "success") & delete_on_success, "deleted").when(status == "suspicious_incomplete", suspicious).otherwise("archive")


def stem(path: Column) -> Column:
    """File name without folder and suffix."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)\z", 1), r"\.[^.]+\z", "")


def name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)\z", 1)


def is_supported(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)\z", 1)).isin(*VIDEO, *AUDIO)


def ignored(path: Column) -> Column:
    """Hidden files and unfinished copies."""
    return F.startswith(name(path), F.lit(".")) | F.endswith(name(path), F.lit(".part"))


def folder(path: Column) -> Column:
    return F.regexp_replace(path, r"[^/]*\z", "")


def subtitles_for_media(media: DataFrame, subtitles: DataFrame, same_folder: bool = False) -> DataFrame:
    """Media (path) with the source subtitles of their stem: (media_path, subtitle_path). With ``same_folder`` they have
    to lie beside the media; else all subtitles are taken to be of one output folder, where names alone decide."""
    where = lambda path: [folder(path).alias("folder")] if same_folder else []
    path = F.col("path")
    left = media.where(is_supported(path)).select(path.alias("media_path"), stem(path).alias("stem"), *where(path))
    right = subtitles.where(F.endswith("path", F.lit(".ja.srt"))).select(path.alias("subtitle_path"), F.regexp_replace(name(path), r"\.ja\.srt\z", "").alias("stem"), *where(path))
    return left.join(right, ["stem", "folder"] if same_folder else "stem").select("media_path", "subtitle_path")


def pending_translations(pairs: DataFrame, outputs: DataFrame) -> DataFrame:
    """Pairs (media_path, subtitle_path) without a translation under any name it could have."""
    base = F.regexp_replace("media_path", r"\.[^./]+\z", "")
    names = F.array(translated_name(name(F.col("subtitle_path"))), F.concat(name(base), F.lit(".srt")), F.concat(name(base), F.lit(".ko.srt")))
    asked = pairs.select("media_path", "subtitle_path", F.explode(F.array_distinct(names)).alias("name"))
    done = asked.join(outputs.select(name(F.col("path")).alias("name")).distinct(), "name", "left_semi").select("media_path", "subtitle_path").distinct()
    return pairs.join(done, ["media_path", "subtitle_path"], "left_anti")


def distinct_paths(paths: DataFrame, order: str = "position") -> DataFrame:
    """Each path once, at its first place."""
    return paths.groupBy("path").agg(F.min(order).alias(order))


def outcome_rollup(reports: DataFrame, by: str = "status") -> DataFrame:
    return reports.groupBy(by).agg(F.count("*").alias("files"))


def process_report(cues: DataFrame, issues: DataFrame, media: DataFrame, runs: DataFrame, **stages: DataFrame) -> DataFrame:
    """One row per media: status, durations, speed and counts. ``runs`` has (media_id, processing_seconds); issues are
    also counted by action. Each further table by name, such as silences, spans, dropped, tail_refined, split or aligned,
    gives its rows of the media as <name>_count; what a table does not mention is 0."""
    counts = [cues.groupBy("media_id").agg(F.count("*").alias("subtitle_count")), stage_counters(issues), runs.select("media_id", "processing_seconds")]
    counts += [rows.groupBy("media_id").agg(F.count("*").alias(f"{name}_count")) for name, rows in stages.items()]
    report = coverage_status(cues, media)
    for own in counts:
        report = report.join(own, "media_id", "left")
    report = report.na.fill(0, [c for c in report.columns if c.endswith("_count")])
    return report.withColumn("realtime_factor", realtime_factor(F.col("processing_seconds"), F.col("duration_s")))


def split_failures(rows: DataFrame, error: Column) -> tuple[DataFrame, DataFrame]:
    """(good rows, rows with a reason): ``error`` is null for good ones."""
    marked = rows.withColumn("reason", error)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")
