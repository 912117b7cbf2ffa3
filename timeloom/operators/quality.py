"""Suspicious cues: why, what to do about them, and what became of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .timeline import renumbered


def _flags(*tests: tuple[str, Column]) -> Column:
    """Names of the tests that hold, in this order."""
    return F.filter(F.array(*[F.when(test, name) for name, test in tests]), lambda f: f.isNotNull())


def _timed(cues: DataFrame) -> DataFrame:
    return cues.withColumn("duration_s", F.col("end_s") - F.col("start_s"))


def _flagged(rows: DataFrame, tests) -> DataFrame:
    """Add flags; ``tests`` takes the normalised text, which is worked out once a row."""
    return rows.withColumn("flags", T.let(T.normalize_phrase(F.col("text")), lambda norm: _flags(*tests(norm))))


def _text_tests(norm: Column) -> list[tuple[str, Column]]:
    duration = F.col("duration_s")
    return [
        ("near_zero_duration", duration < 0.3),
        ("punctuation_only", T.is_punctuation_only(F.col("text"))),
        ("blocked_phrase", norm.isin(*T.BLOCKED_PHRASES)),
        ("long_duration_short_text", (duration >= 8.0) & (F.length(norm) <= 30)),
        ("possible_garbage_cjk", T.looks_like_garbage_cjk(norm)),
    ]


def hallucination_flags(cues: DataFrame) -> DataFrame:
    """Add flags that need no audio."""
    return _flagged(_timed(cues), _text_tests).drop("duration_s")


#: A mark of its own beside the flags, taken off again.
_SAYS_MUCH = "says_much"


def split_hallucinations(cues: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept cues renumbered, dropped ones with idx, their number before, flags and action): blocked phrases, bare
    punctuation, and texts of five characters or more on next to no time."""
    rows = _flagged(_timed(cues), lambda norm: [*_text_tests(norm), (_SAYS_MUCH, F.length(norm) >= 5)])
    has = lambda flag: F.array_contains("flags", flag)
    rows = rows.withColumn("gone", has("blocked_phrase") | has("punctuation_only") | (has("near_zero_duration") & has(_SAYS_MUCH)))
    rows = rows.withColumn("flags", F.array_remove("flags", _SAYS_MUCH))
    kept = renumbered(rows.where("not gone").select(cues.columns), "seq")
    dropped = rows.where("gone").select("media_id", F.col("seq").alias("idx"), "start_s", "end_s", "duration_s", "text", "flags", F.lit("drop").alias("recommended_action"))
    return kept, dropped


def recommended_action(flags: Column) -> Column:
    has = lambda flag: F.array_contains(flags, flag)
    slow, strong, broken = has("low_chars_per_second"), has("strong_audio"), has("fragmented_energy")
    return (
        F.when(has("blocked_phrase") | has("punctuation_only") | has("near_zero_duration"), "drop")
        .when(slow & (has("flat_audio") | has("weak_audio_peak") | (broken & ~strong)), "drop_candidate")
        .when(slow & strong & broken, "resegment_candidate")
        .when(has("long_subtitle_split_candidate"), "split_candidate")
        .when(has("early_start_candidate"), "refine_start_candidate")
        .otherwise("review")
    )


def quality_issues(cues: DataFrame, audio_stats: DataFrame | None = None) -> DataFrame:
    """One row per flagged cue: media_id, idx, start_s, end_s, duration_s, text, flags, recommended_action and, with
    ``audio_stats`` (media_id, seq, audio), audio. idx is the cue's number in its media."""
    rows = _timed(renumbered(cues, "seq"))
    if audio_stats is None:
        rows = rows.withColumn("audio", F.lit(None).cast("struct<max_db: double, p90_db: double, speech_ratio: double, longest_island_s: double, leading_quiet_s: double>"))
    else:
        rows = rows.join(audio_stats, ["media_id", "seq"], "left")
    duration = F.col("duration_s")
    loudest, p90, island = F.col("audio.max_db"), F.col("audio.p90_db"), F.col("audio.longest_island_s")
    long_ = duration >= 8.0

    def tests(norm: Column) -> list[tuple[str, Column]]:
        return [
            *_text_tests(norm),
            ("long_subtitle_split_candidate", (duration >= 12.0) & (F.length(norm) >= 25)),
            ("low_chars_per_second", long_ & (F.length(norm) / duration < 2.0)),
            ("flat_audio", (duration <= 3.0) & (loudest < -45.0)),
            ("weak_audio_peak", long_ & (loudest < -22.0) & (p90 < -30.0)),
            ("strong_audio", long_ & (loudest >= -22.0) & (p90 >= -30.0)),
            ("low_speech_density", long_ & (F.col("audio.speech_ratio") < 0.18) & (island < 0.8)),
            ("fragmented_energy", long_ & (island < 0.8)),
            ("early_start_candidate", (duration >= 1.5) & (duration < 8.0) & (F.col("audio.leading_quiet_s") >= 0.7) & ~norm.isin(*T.BLOCKED_PHRASES)),
        ]

    flagged = _flagged(rows, tests).where(F.size("flags") > 0)
    return flagged.select("media_id", F.col("seq").alias("idx"), "start_s", "end_s", "duration_s", "text", "flags", recommended_action(F.col("flags")).alias("recommended_action"), "audio")


def annotate_cues(cues: DataFrame, issues: DataFrame) -> DataFrame:
    """Append each issue's action and flags to the text of its cue."""
    tag = F.concat(F.lit("\n[quality: "), F.col("recommended_action"), F.lit("; "), F.array_join("flags", ", "), F.lit("]"))
    tags = issues.select("media_id", F.col("idx").alias("seq"), tag.alias("tag"))
    return cues.join(tags, ["media_id", "seq"], "left").withColumn("text", F.concat("text", F.coalesce("tag", F.lit("")))).drop("tag")


def stage_counters(issues: DataFrame) -> DataFrame:
    """Issues of each media by action, and in all."""
    count = lambda action: F.count_if(F.col("recommended_action") == action).alias(f"{action}_count")
    actions = ("drop", "drop_candidate", "resegment_candidate", "split_candidate", "refine_start_candidate", "review")
    return issues.groupBy("media_id").agg(F.count("*").alias("issue_count"), *[count(a) for a in actions])


def quality_report(cues: DataFrame, issues: DataFrame, dropped: DataFrame, tail: DataFrame, split: DataFrame) -> DataFrame:
    """One row per media: counts and lists of issues, dropped cues, tail refinements and splits."""
    out = cues.groupBy("media_id").agg(F.count("*").alias("cue_count"))
    for name, rows in (("issues", issues), ("dropped", dropped), ("tail_refined", tail), ("split", split)):
        fields = ["idx", *[c for c in rows.columns if c not in ("media_id", "idx", "audio")]]
        listed = rows.groupBy("media_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))
        out = out.join(listed, "media_id", "left").withColumn(f"{name}_count", F.coalesce(F.size(name), F.lit(0)))
        out = out.withColumn(f"{name}_count", F.greatest(F.col(f"{name}_count"), F.lit(0)))
    return out


# ---- tails ---------------------------------------------------------------------------------------------------------


def tail_candidates(issues: DataFrame) -> DataFrame:
    has = lambda flag: F.array_contains("flags", flag)
    long_ = F.col("duration_s").between(10.0, 30.0) & F.col("recommended_action").isin("drop_candidate", "resegment_candidate")
    return issues.where(long_ & ~has("blocked_phrase") & ~has("near_zero_duration"))


def top_tail_candidates(issues: DataFrame, k: int = 20) -> DataFrame:
    """The first ``k`` candidates of each media (all if k <= 0): resegmenting first, then the longest."""
    order = Window.partitionBy("media_id").orderBy(F.when(F.col("recommended_action") == "resegment_candidate", 0).otherwise(1), F.col("duration_s").desc(), "idx")
    ranked = tail_candidates(issues).withColumn("priority", F.row_number().over(order))
    return ranked.where(F.col("priority") <= k) if k > 0 else ranked


def tail_requests(candidates: DataFrame, window_s: float = 5.0) -> DataFrame:
    """What is to be recognised again: the last ``window_s`` of each candidate."""
    return candidates.select("media_id", "idx", F.greatest(F.col("start_s"), F.col("end_s") - window_s).alias("tail_start_s"), "end_s")


def tail_attempts(cues: DataFrame, requests: DataFrame, tails: DataFrame, min_similarity: float = 0.45, min_chars: int = 4, min_ratio: float = 0.35) -> DataFrame:
    """Compare the texts of recognised tails (media_id, idx, seq, start_s, text) with their cues; accepted ones get a
    new start."""
    heard = tails.groupBy("media_id", "idx").agg(F.array_sort(F.collect_list(F.struct("seq", "start_s", "text"))).alias("t"))
    heard = heard.select("media_id", "idx", F.array_join(F.transform("t", lambda x: x["text"]), "").alias("tail_text"), F.get("t", F.lit(0))["start_s"].alias("first_s"))
    rows = requests.select("media_id", "idx", "tail_start_s").join(cues.withColumnRenamed("seq", "idx"), ["media_id", "idx"]).join(heard, ["media_id", "idx"], "left")
    rows = rows.withColumn("tail_text", F.coalesce("tail_text", F.lit("")))
    length = F.length(T.normalize_phrase(F.col("tail_text")))
    source = F.length(T.normalize_phrase(F.col("text")))
    rows = rows.withColumns({"tail_text_length": length, "tail_text_ratio": F.when(source > 0, length / source).otherwise(0.0), "similarity": T.text_similarity(F.col("text"), F.col("tail_text"))})
    accepted = F.col("first_s").isNotNull() & (F.col("tail_text_length") >= min_chars) & (F.col("tail_text_ratio") >= min_ratio) & (F.col("similarity") >= min_similarity)
    rows = rows.withColumn("accepted", accepted)
    return rows.withColumn("new_start_s", F.when(F.col("accepted"), F.col("tail_start_s") + F.col("first_s"))).drop("first_s")


def apply_tail(cues: DataFrame, refinements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Move starts to new_start_s where that lies strictly inside the cue; also returns the moves made."""
    found = refinements.where("new_start_s is not null").select("media_id", F.col("idx").alias("seq"), "new_start_s", "tail_start_s", "similarity")
    rows = cues.join(found, ["media_id", "seq"], "left")
    inside = F.coalesce((F.col("new_start_s") > F.col("start_s")) & (F.col("new_start_s") < F.col("end_s")), F.lit(False))
    applied = rows.where(inside).select("media_id", F.col("seq").alias("idx"), "start_s", "end_s", "text", *[F.bround(c, 3).alias(c) for c in ("new_start_s", "tail_start_s", "similarity")])
    return rows.withColumn("start_s", F.when(inside, F.col("new_start_s")).otherwise(F.col("start_s"))).select(cues.columns), applied
