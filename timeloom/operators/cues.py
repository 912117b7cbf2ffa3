"""Cues (media_id, seq, start_s, end_s, text): repair, grouping, splitting, retiming and filtering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .timeline import Greedy, greedy_groups, interval_cells, point_cells, pushed_on, renumbered

FIELDS = ["start_s", "end_s", "text"]
#: Seconds that a cue without duration gets.
SLIVER = 0.01


def _cue(start: Column, end: Column, text: Column) -> Column:
    return F.struct(start.alias("start_s"), end.alias("end_s"), text.alias("text"))


def repair_chunks(chunks: DataFrame) -> DataFrame:
    """Raw chunks (times may be null) as valid cues in input order: texts cleaned, blank ones and repeats of the text
    before dropped, times above zero, every cue longer than nothing and none starting before the one before ends."""
    start = F.greatest(F.lit(0.0), F.coalesce("start_s", F.lit(0.0)))
    end = F.greatest(F.lit(0.0), F.coalesce("end_s", "start_s", F.lit(0.0)))
    said = chunks.where(T.strip(F.col("text")) != "")  # cleaning leaves nothing of these alone, and is not done twice
    rows = said.select("media_id", "seq", start.alias("start_s"), end.alias("end_s"), T.clean_text(F.col("text")).alias("text"))
    rows = rows.withColumn("end_s", F.when(F.col("end_s") <= F.col("start_s"), F.col("start_s") + SLIVER).otherwise(F.col("end_s")))
    return pushed_on(rows, SLIVER).select("media_id", "seq", *FIELDS)


def group_cues(cues: DataFrame, max_gap_s: float = 0.5, max_duration_s: float = 6.0, max_chars: int = 42, cleaned: bool = False) -> DataFrame:
    """Merge cues into longer ones until a pause, the end of a sentence, or a limit on duration or length. Texts are
    cleaned first, unless they are ``cleaned``, so what joining adds is known from neighbours alone; times must not be null."""
    text = F.col("text")
    rows = cues.select("media_id", "seq", "start_s", "end_s", (text if cleaned else T.clean_text(text)).alias("text"))
    rule = Greedy(max_gap_s, max_duration_s, [max_chars])
    numbered = greedy_groups(rows, rule, F.col("start_s"), F.col("end_s"), T.ends_sentence(text), T.starts_alnum(text), T.ends_alnum(text), [F.length("text")])
    parts = F.array_sort(F.collect_list(F.struct("seq", F.when(F.col("spaced"), F.concat(F.lit(" "), text)).otherwise(text).alias("text"))))
    merged = numbered.groupBy("media_id", "group").agg(F.min_by("start_s", "seq").alias("start_s"), F.max_by("end_s", "seq").alias("end_s"), parts.alias("parts"))
    return merged.select("media_id", F.col("group").alias("seq"), "start_s", "end_s", F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text"))


# ---- splitting -----------------------------------------------------------------------------------------------------


def silences_inside(cues: DataFrame, silences: DataFrame, min_s: float, base_s: float = 16.0) -> DataFrame:
    """Silences strictly inside a cue with ``min_s`` of it on either side: an interval join over cells of time, whose
    widths follow the cues' lengths."""
    left = interval_cells(cues.select("media_id", "seq", "start_s", "end_s"), base_s)
    right = silences.select("media_id", F.col("seq").alias("silence_seq"), F.col("start_s").alias("quiet_from"), F.col("end_s").alias("quiet_to"))
    inside = (F.col("quiet_from") > F.col("start_s")) & (F.col("quiet_to") < F.col("end_s"))
    wide = (F.col("quiet_from") - F.col("start_s") >= min_s) & (F.col("end_s") - F.col("quiet_to") >= min_s)
    return left.join(point_cells(right, left, base_s, "quiet_from"), ["media_id", "level", "cell"]).where(inside & wide).drop("level", "cell")


def split_cues_on_silence(cues: DataFrame, silences: DataFrame, min_s: float = 0.8) -> DataFrame:
    """Cut cues at the silences inside them; the text is dealt to the pieces by their durations."""
    pairs = silences_inside(cues, silences, min_s)
    order = Window.partitionBy("media_id", "seq").orderBy("silence_seq")
    cursor = F.greatest(F.col("start_s"), F.coalesce(F.max("quiet_to").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.col("start_s")))
    gaps = pairs.select("media_id", "seq", "silence_seq", cursor.alias("from_s"), F.col("quiet_from").alias("to_s"))
    tails = pairs.groupBy("media_id", "seq").agg(F.max("silence_seq").alias("silence_seq"), F.max("quiet_to").alias("from_s"), F.first("end_s").alias("to_s"))
    tails = tails.withColumn("silence_seq", F.col("silence_seq") + 1)
    spans = gaps.unionByName(tails).where(F.col("to_s") - F.col("from_s") >= min_s)
    spans = spans.groupBy("media_id", "seq").agg(F.array_sort(F.collect_list(F.struct("silence_seq", "from_s", "to_s"))).alias("spans")).where(F.size("spans") > 1)
    joined = cues.join(spans, ["media_id", "seq"], "left")
    pieces = T.allocate_text(F.col("text"), F.transform("spans", lambda s: s["to_s"] - s["from_s"]))
    cut = F.transform(F.arrays_zip(F.col("spans").alias("spans"), pieces.alias("pieces")), lambda x: _cue(x["spans"]["from_s"], x["spans"]["to_s"], T.clean_text(x["pieces"])))
    whole = F.array(_cue(F.col("start_s"), F.col("end_s"), F.col("text")))
    out = joined.select("media_id", "seq", F.posexplode(F.when(F.col("spans").isNull(), whole).otherwise(F.filter(cut, lambda c: c["text"] != ""))).alias("at", "c"))
    return renumbered(out, "seq", "at").select("media_id", "seq", "c.*")


def distribute_time(start: Column, end: Column, parts: Column) -> Column:
    """Parts as an array of cues; durations follow their lengths, and the last ends where the whole does."""

    def timed(own: Column) -> Column:
        weights = F.transform(own, lambda p: F.greatest(F.lit(1), F.length(T.normalize_phrase(p))))

        def placed(weight: Column) -> Column:
            total = F.aggregate(weight, F.lit(0), lambda s, w: s + w)
            upto = lambda n: F.aggregate(F.slice(weight, 1, n), F.lit(0), lambda s, w: s + w)
            at = lambda n: start + (end - start) * upto(n) / total
            return F.transform(own, lambda p, n: _cue(at(n), F.when(n == F.size(own) - 1, end).otherwise(at(n + 1)), p))

        return T.let(weights, placed)

    return T.let(parts, timed)


def split_long_cues(cues: DataFrame, issues: DataFrame, target_duration_s: float = 8.0, max_chars: int = 28) -> tuple[DataFrame, DataFrame]:
    """Cut the cues whose issue (media_id, idx, recommended_action) asks for it; also returns what was cut in how many
    parts: (media_id, idx, start_s, end_s, text, part_count)."""
    asked = issues.where("recommended_action = 'split_candidate'").select("media_id", F.col("idx").alias("seq"), F.lit(True).alias("asked"))
    most = F.greatest(F.lit(2), F.ceil((F.col("end_s") - F.col("start_s")) / target_duration_s).cast("int"))
    rows = cues.join(asked, ["media_id", "seq"], "left")
    rows = rows.withColumn("parts", F.when(F.col("asked"), T.split_long_text(F.col("text"), most, max_chars)).otherwise(F.array("text")))
    applied = rows.where(F.size("parts") > 1).select("media_id", F.col("seq").alias("idx"), "start_s", "end_s", "text", F.size("parts").alias("part_count"))
    whole = F.array(_cue(F.col("start_s"), F.col("end_s"), F.col("text")))
    cut = F.when(F.size("parts") > 1, distribute_time(F.col("start_s"), F.col("end_s"), F.col("parts"))).otherwise(whole)
    out = rows.select("media_id", "seq", F.posexplode(cut).alias("at", "c"))
    return renumbered(out, "seq", "at").select("media_id", "seq", "c.*"), applied


# ---- retiming ------------------------------------------------------------------------------------------------------


def offset_chunks(chunks: DataFrame, spans: DataFrame, minimum_start: bool = False) -> DataFrame:
    """Move each segment's chunks (media_id, segment_no, seq, ...) by the start of its span (media_id, segment_no,
    start_s); chunks without a start stay out. ``minimum_start`` also holds them back to minimum_start_s of the span."""
    shift = spans.select("media_id", "segment_no", F.col("start_s").alias("offset_s"), *(["minimum_start_s"] if minimum_start else []))
    rows = chunks.join(shift, ["media_id", "segment_no"])
    start = F.coalesce("start_s", F.lit(0.0)) + F.col("offset_s")
    end = F.coalesce("end_s", "start_s", F.lit(0.0)) + F.col("offset_s")
    if minimum_start:
        late = F.greatest(start, F.coalesce("minimum_start_s", start))
        end = F.when((late > start) & (end <= late), late + SLIVER).otherwise(end)
        start = late
    return rows.select("media_id", "segment_no", "seq", start.alias("start_s"), end.alias("end_s"), "text")


def concat_segments(chunks: DataFrame) -> DataFrame:
    """Chunks of all segments of a media as one list, in the order of segments."""
    return renumbered(chunks, "segment_no", "seq").drop("segment_no")


def shift_cues(cues: DataFrame, offset_s: float) -> DataFrame:
    return cues.withColumns({c: F.greatest(F.lit(0.0), F.col(c) + offset_s) for c in ("start_s", "end_s")}) if offset_s else cues


def fallback_delay(vad_engine: str, delay_s: float) -> float:
    """The shift is for spans found by level only."""
    return delay_s if vad_engine == "ffmpeg" else 0.0


def clamp_cues(cues: DataFrame, media: DataFrame) -> DataFrame:
    """Cut cues at the end of their media (media_id, duration_s); media of unknown duration are left alone."""
    rows = cues.join(media.select("media_id", "duration_s"), "media_id", "left")
    known = F.coalesce(F.col("duration_s") > 0, F.lit(False))
    end = F.when(known, F.least("end_s", "duration_s")).otherwise(F.col("end_s"))
    return rows.withColumn("end_s", end).where(~known | (F.col("end_s") > F.col("start_s"))).drop("duration_s")


def tighten_cues(cues: DataFrame, min_s: float = 0.8, max_s: float = 5.0, chars_per_second: float = 5.0, padding_s: float = 0.4) -> DataFrame:
    """Shorten cues that stand longer than their text takes to read, by a tenth of a second at least."""
    chars = F.length(F.regexp_replace(T.clean_text(F.col("text")), r"(?U)\s+", ""))
    target = F.greatest(F.lit(min_s), F.least(F.lit(max_s), chars / chars_per_second + padding_s))
    spare = F.col("end_s") - F.col("start_s") - target
    return cues.withColumn("end_s", F.when((spare > 0) & (spare >= 0.1), F.col("start_s") + target).otherwise(F.col("end_s")))


# ---- filters -------------------------------------------------------------------------------------------------------


def _phrases(cues: DataFrame, phrases: list[str] | DataFrame) -> DataFrame:
    """Normalised phrases of a list, or of a table with a column phrase."""
    listed = phrases if isinstance(phrases, DataFrame) else cues.sparkSession.createDataFrame([(p,) for p in phrases], "phrase string")
    return listed.select(T.normalize_phrase(F.col("phrase"), "docker").alias("norm")).distinct()


def drop_short_phrases(cues: DataFrame, phrases: list[str] | DataFrame, max_duration_s: float) -> DataFrame:
    """Without cues of at most ``max_duration_s`` that say nothing but one of ``phrases``."""
    rows = cues.withColumn("norm", T.normalize_phrase(F.col("text"), "docker"))
    listed = _phrases(cues, phrases)
    met = (rows["norm"] == listed["norm"]) & (rows["end_s"] - rows["start_s"] <= max_duration_s)
    return rows.join(listed, met, "left_anti").drop("norm")


def drop_phrases(cues: DataFrame, phrases: list[str] | DataFrame) -> DataFrame:
    return cues.withColumn("norm", T.normalize_phrase(F.col("text"), "docker")).join(_phrases(cues, phrases), "norm", "left_anti").select(cues.columns)


def drop_punctuation_only(cues: DataFrame, profile: str = "docker") -> DataFrame:
    return cues.where(~T.is_punctuation_only(F.col("text"), profile))
