"""Views of the driver's tables as timelines: projections that Spark and DuckDB spell alike.

Times come from whole numbers by one division, so both engines get the same doubles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _timed(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("media_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("n").over(order), F.lit(0)) / 15.0
    return rows.withColumn("start_s", start).select("media_id", "seq", "start_s", (F.col("start_s") + F.col("n") / 20.0).alias("end_s"), "text")


def conversation_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as cues: each starts 1/15 s later for every character before it, and lasts 1/20 s for each of its own."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("media_id"), F.col("turn").alias("seq"), F.length("text").cast("long").alias("n"), "text")
    return _timed(rows)


CONVERSATION_CUES = """conversation_cues AS (
  SELECT media_id, seq, start_s, start_s + n / 20.0::DOUBLE AS end_s, text FROM (
    SELECT conv_id AS media_id, turn AS seq, length(text) AS n, text,
           coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE / 15.0::DOUBLE AS start_s
    FROM conversations))"""


def line_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as cues."""
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("media_id"), F.posexplode(F.split("text", "\n", -1)).alias("at", "text"))
    return _timed(lines.select("media_id", F.col("at").cast("long").alias("seq"), F.length("text").cast("long").alias("n"), "text"))


LINE_CUES = """line_cues AS (
  SELECT media_id, seq, start_s, start_s + n / 20.0::DOUBLE AS end_s, text FROM (
    SELECT media_id, seq, length(text) AS n, text,
           coalesce(sum(length(text)) OVER (PARTITION BY media_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE / 15.0::DOUBLE AS start_s
    FROM (SELECT doc_id AS media_id, unnest(l) AS text, unnest(range(len(l))) AS seq FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))))"""


def event_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as spans: kilo-seconds since 2024, a tenth of their value long."""
    micros = F.timestamp_diff("MICROSECOND", F.lit("2024-01-01").cast("timestamp_ntz"), "ts")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("media_id"), F.row_number().over(order).cast("long").alias("seq"), (micros / 1e9).alias("start_s"), "value", "event_type")
    return rows.select("media_id", "seq", "start_s", (F.col("start_s") + F.col("value") / 10.0).alias("end_s"), "value", "event_type")


EVENT_SPANS = """event_spans AS (
  SELECT media_id, seq, start_s, start_s + value / 10.0::DOUBLE AS end_s, value, event_type FROM (
    SELECT user_id AS media_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq,
           (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01'))::DOUBLE / 1e9::DOUBLE AS start_s, value, event_type
    FROM events))"""


def span_media(spans: DataFrame) -> DataFrame:
    """A media of each timeline, ten seconds longer than its spans."""
    return spans.groupBy("media_id").agg((F.max("end_s") + 10.0).alias("duration_s"))


def run_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as run reports."""
    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("path"),
        F.struct("l_shipdate", "l_orderkey", "l_linenumber").alias("mtime"),
        F.when(F.col("l_linestatus") == "O", "success").otherwise("suspicious_incomplete").alias("status"),
        F.col("l_returnflag").alias("asr_backend"),
        F.col("l_extendedprice").alias("media_duration_seconds"),
        F.lit(None).cast("double").alias("audio_duration_seconds"),
        F.col("l_quantity").alias("processing_seconds"),
        F.lit(None).cast("double").alias("realtime_factor"),
        F.col("l_suppkey").alias("folder"),
    )
