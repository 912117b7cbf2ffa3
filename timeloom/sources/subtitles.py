"""Subtitle files, read leniently as cues or strictly as entries, and written back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.timing import format_srt_time, parse_srt_time
from ..operators.jobs import stem
from .sinks import write_texts

_LINES = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def read_texts(spark: SparkSession, root: str, recurse: bool = False) -> DataFrame:
    """(media_id, path, body) of the .srt files under a folder."""
    files = spark.read.option("pathGlobFilter", "*.srt").option("recursiveFileLookup", recurse).text(root, wholetext=True)
    path = F.col("_metadata.file_path")
    return files.select(stem(path).alias("media_id"), path.alias("path"), F.col("value").alias("body"))


def parse_srt(texts: DataFrame) -> DataFrame:
    """Cues of subtitle texts (media_id, body): blocks with a time line and text after it; a time line that cannot be
    read leaves start_s or end_s null."""
    blocks = texts.select("media_id", F.posexplode(F.split(T.strip(F.col("body")), r"(?U)\r?\n\s*\r?\n")).alias("block", "b"))
    blocks = blocks.withColumn("lines", F.transform(F.split("b", _LINES), lambda x: F.regexp_replace(x, r"(?U)\s+\z", ""))).where(F.size("lines") >= 2)
    at = F.array_position(F.transform("lines", lambda x: F.contains(x, F.lit("-->"))), True).cast("int")
    blocks = blocks.withColumn("at", at).where("at > 0")
    timing = F.element_at("lines", F.col("at"))
    body = T.clean_text(F.array_join(F.slice("lines", F.col("at") + 1, F.size("lines")), "\n"))
    rows = blocks.select("media_id", "block", parse_srt_time(F.substring_index(timing, "-->", 1)).alias("start_s"), parse_srt_time(F.regexp_extract(timing, r"-->(.*)\z", 1)).alias("end_s"), body.alias("text")).where("text <> ''")
    return rows.select("media_id", F.row_number().over(Window.partitionBy("media_id").orderBy("block")).cast("long").alias("seq"), "start_s", "end_s", "text")


def parse_srt_entries(texts: DataFrame) -> DataFrame:
    """Entries (media_id, seq, timecode, text) of subtitle texts: blocks of three lines at least with the time code,
    kept as it is, on the second; text lines are joined by a space."""
    body = F.regexp_replace(F.regexp_replace("body", "^\ufeff", ""), "\r\n", "\n")
    blocks = texts.select("media_id", F.posexplode(F.split(T.strip(body), r"(?U)\n\s*\n")).alias("block", "b")).withColumn("lines", F.split("b", _LINES))
    blocks = blocks.where((F.size("lines") >= 3) & F.contains(F.get("lines", F.lit(1)), F.lit("-->")))
    text = T.strip(F.array_join(F.transform(F.slice("lines", F.lit(3), F.size("lines")), T.strip), " "))
    seq = F.row_number().over(Window.partitionBy("media_id").orderBy("block")).cast("long")
    return blocks.select("media_id", seq.alias("seq"), T.strip(F.get("lines", F.lit(1))).alias("timecode"), text.alias("text"))


def strict_entries(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries, errors): subtitle texts (media_id, body) without any entry, null ones too, are errors (media_id, reason),
    where one file would stop a run."""
    entries = parse_srt_entries(texts)
    bad = texts.join(entries.select("media_id").distinct(), "media_id", "left_anti")
    return entries, bad.select("media_id", F.lit("no subtitle entries").alias("reason"))


def count_srt_blocks(body: Column) -> Column:
    """Blocks with a time line; none is null."""
    blocks = F.split(F.regexp_replace(F.regexp_replace(body, "^\ufeff", ""), "\r\n", "\n"), "\n\n")
    return F.nullif(F.size(F.filter(blocks, lambda b: F.contains(b, F.lit("-->")))), F.lit(0))


def _joined(rows: DataFrame, block: Column, separator: str, ending: str) -> DataFrame:
    """(media_id, body): blocks of each media in order."""
    number = F.row_number().over(Window.partitionBy("media_id").orderBy("seq"))
    lists = rows.withColumn("n", number).select("media_id", "n", block.alias("block"))
    lists = lists.groupBy("media_id").agg(F.array_sort(F.collect_list(F.struct("n", "block"))).alias("b"))
    return lists.select("media_id", F.concat(F.array_join(F.transform("b", lambda x: x["block"]), separator), F.lit(ending)).alias("body"))


def render_srt(cues: DataFrame) -> DataFrame:
    """Subtitle texts of cues, numbered from 1."""
    times = F.concat(format_srt_time(F.col("start_s")), F.lit(" --> "), format_srt_time(F.col("end_s")))
    return _joined(cues, F.concat_ws("\n", F.col("n").cast("string"), times, F.col("text")), "\n\n", "\n")


def render_translated_srt(merged: DataFrame) -> DataFrame:
    """Subtitle texts of entries (media_id, seq, timecode, translation) under their own time codes."""
    return _joined(merged, F.concat_ws("\n", F.col("n").cast("string"), F.col("timecode"), T.clean_translation(F.col("translation"))), "\n\n", "\n")


def render_txt(cues: DataFrame) -> DataFrame:
    return _joined(cues, F.col("text"), "\n", "\n")


def render_json(cues: DataFrame) -> DataFrame:
    """One JSON list of cues for each media."""
    cue = F.struct(F.col("start_s").alias("start"), F.col("end_s").alias("end"), "text")
    lists = cues.groupBy("media_id").agg(F.array_sort(F.collect_list(F.struct("seq", cue.alias("cue")))).alias("c"))
    return lists.select("media_id", F.to_json(F.transform("c", lambda x: x["cue"])).alias("body"))


def write_srt(cues: DataFrame, root: str, suffix: str = ".srt", mode: str = "append") -> None:
    """Cues of each media as a subtitle file of its name."""
    write_texts(render_srt(cues), root, suffix, mode)


def write_translated_srt(merged: DataFrame, root: str, suffix: str = ".ko.srt", mode: str = "append") -> None:
    """Translated entries as subtitle files; a file that does not have one block for each entry fails the job."""
    counts = merged.groupBy("media_id").agg(F.count("*").alias("expected"))
    write_texts(render_translated_srt(merged).join(counts, "media_id"), root, suffix, mode)
