"""Run reports and job options in JSON, read and written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PROCESS = "status string, asr_backend string, media_duration_seconds string, audio_duration_seconds string, processing_seconds string, realtime_factor string, _corrupt_record string"
TRANSLATION = "status string, subtitle_count string, processing_seconds string, model string, batch_translate boolean, batch_size string, korean_style string, _corrupt_record string"


def _scan(spark: SparkSession, root: str, pattern: str, schema: str) -> DataFrame:
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").option("pathGlobFilter", pattern).json(root)
    meta = [F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("mtime")]
    return rows.select(*meta, *[c for c in rows.columns if c != "_corrupt_record"], F.col("_corrupt_record").isNotNull().alias("corrupt")).where("not corrupt").drop("corrupt")


def scan_process_history(spark: SparkSession, root: str) -> DataFrame:
    """Transcription reports of a folder; files that are no JSON objects are left out."""
    return _scan(spark, root, "*.process.json", PROCESS)


def scan_translation_history(spark: SparkSession, root: str) -> DataFrame:
    return _scan(spark, root, "*.translation.json", TRANSLATION)


def parse_job_options(jobs: DataFrame) -> DataFrame:
    """Options of jobs (media_id, options: JSON): typed columns, and reason for those that are not valid."""
    raw = F.col("options")
    get = lambda key: F.get_json_object(raw, f"$.{key}")
    keys = F.json_object_keys(raw)
    threshold, least = get("silence_threshold_db"), get("min_silence_duration_s")
    seconds = least.try_cast("double")
    truth = lambda key: F.when(F.array_contains(keys, key), ~F.coalesce(get(key), F.lit("")).isin("false", "0", "", "null", "[]", "{}", "0.0"))
    reason = (
        F.when(keys.isNull(), "expected object")
        .when(F.array_contains(keys, "silence_threshold_db") & ~F.coalesce(threshold.rlike(r"^-?\d+(\.\d+)?dB$"), F.lit(False)), "silence_threshold_db must look like -35dB")
        .when(F.array_contains(keys, "min_silence_duration_s") & ~F.coalesce(seconds > 0, F.lit(False)), "min_silence_duration_s must be > 0")
    )
    ok: Column = reason.isNull()
    return jobs.select(
        "media_id",
        F.when(ok, threshold).alias("silence_threshold_db"),
        F.when(ok, seconds).alias("min_silence_duration_s"),
        F.when(ok, truth("auto_silence_threshold")).alias("auto_silence_threshold"),
        F.when(ok, truth("delete_source_on_success")).alias("delete_source_on_success"),
        reason.alias("reason"),
    )


def vad_report(raw_spans: DataFrame, spans: DataFrame, parameters: dict[str, str], digits: int = 3, numbered: bool = False) -> DataFrame:
    """One row per media: parameters, detected spans and the spans that are transcribed, ``numbered`` with their seq."""
    from ..operators.spans import span_report

    listed = lambda rows, name: span_report(rows, digits, numbered).withColumnRenamed("spans", name)
    both = listed(raw_spans, "speech_spans").join(listed(spans, "transcription_spans"), "media_id", "full")
    return both.withColumn("parameters", F.create_map(*[F.lit(x) for pair in sorted(parameters.items()) for x in pair]) if parameters else F.lit(None).cast("map<string, string>"))


def write_reports(reports: DataFrame, root: str, mode: str = "errorifexists") -> None:
    reports.write.mode(mode).json(root)


def write_quarantine(failures: DataFrame, root: str, mode: str = "append") -> None:
    """Rows with their reason, by reason."""
    failures.write.mode(mode).partitionBy("reason").json(root)
