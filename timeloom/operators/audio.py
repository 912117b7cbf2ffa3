"""PCM audio in blocks (media_id, block_no, sample_rate, first_sample, samples) and frame levels."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import timing
from ..functions.text import let
from .timeline import in_blocks, interval_cells, numbered_in_blocks, point_cells


def audio_duration(blocks: DataFrame) -> DataFrame:
    """(media_id, sample_rate, frames, duration_s); duration is null where the rate is not above zero."""
    per = blocks.groupBy("media_id").agg(F.max("sample_rate").alias("sample_rate"), F.sum(F.size("samples").cast("long")).alias("frames"))
    return per.withColumn("duration_s", F.when(F.col("sample_rate") > 0, F.col("frames") / F.col("sample_rate")))


def slice_audio(blocks: DataFrame, spans: DataFrame, rounded: bool = True) -> DataFrame:
    """Samples under each span (media_id, seq, start_s, end_s): (media_id, seq, sample_rate, samples).

    Only the blocks that a span touches are read: block numbers are the join's key. Bounds are clamped to the media and
    rounded to samples, or cut down if not ``rounded``.
    """
    facts = blocks.groupBy("media_id").agg(F.max("sample_rate").alias("sample_rate"), F.max(F.size("samples")).alias("size"), F.max(F.col("first_sample") + F.size("samples")).alias("total"))
    whole = F.bround if rounded else F.floor
    bound = lambda c: F.least(F.greatest(whole(F.col(c) * F.col("sample_rate")).cast("long"), F.lit(0)), F.col("total"))
    rows = spans.join(facts, "media_id").select("media_id", "seq", "sample_rate", "size", bound("start_s").alias("first"), bound("end_s").alias("stop")).where("stop > first")
    rows = rows.withColumn("block_no", F.explode(F.sequence(F.floor(F.col("first") / F.col("size")), F.floor((F.col("stop") - 1) / F.col("size")))))
    cut = rows.join(blocks.select("media_id", "block_no", "first_sample", "samples"), ["media_id", "block_no"])
    low = F.greatest(F.col("first") - F.col("first_sample"), F.lit(0))
    high = F.least(F.col("stop") - F.col("first_sample"), F.size("samples").cast("long"))
    cut = cut.select("media_id", "seq", "sample_rate", "block_no", F.slice("samples", (low + 1).cast("int"), F.greatest(high - low, F.lit(0)).cast("int")).alias("part"))
    parts = cut.groupBy("media_id", "seq", "sample_rate").agg(F.array_sort(F.collect_list(F.struct("block_no", "part"))).alias("parts"))
    return parts.select("media_id", "seq", "sample_rate", F.flatten(F.transform("parts", lambda p: p["part"])).alias("samples"))


def frame_levels(samples: Column, per_frame: Column, floor_rms: float = 0.0) -> Column:
    """Levels of consecutive frames of ``per_frame`` samples; a last short one counts."""
    frames = F.when(F.size(samples) > 0, F.sequence(F.lit(1), F.size(samples), per_frame)).otherwise(F.array().cast("array<int>"))
    return F.transform(frames, lambda at: timing.dbfs(F.slice(samples, at, per_frame), floor_rms))


def square_sums(blocks: DataFrame) -> DataFrame:
    """Blocks with sums, the squares of their samples added up from the block's start (one number more than samples), in
    place of samples: any stretch of a block then costs two look-ups. Rows without samples are left out."""
    kept = ["media_id", "block_no", "sample_rate", "first_sample"]

    def run(batches):
        for batch in batches:
            samples = batch.column("samples")
            lengths = samples.value_lengths().to_numpy()
            squares = samples.flatten().to_numpy().astype(np.int64) ** 2
            running = np.concatenate([[0], np.cumsum(squares)])
            ends = np.cumsum(lengths)
            at = np.arange(len(squares) + len(lengths)) - np.repeat(np.arange(len(lengths)), lengths + 1)
            sums = running[at] - np.repeat(running[ends - lengths], lengths + 1)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths + 1)]), pa.int32()), pa.array(sums))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [lists], names=[*kept, "sums"])

    rows = blocks.where("size(samples) > 0").select(*kept, "samples")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in kept) + ", sums array<long>")


def framed_levels(spans: DataFrame, blocks: DataFrame, frame_s: float, floor_rms: float = 0.0) -> DataFrame:
    """Levels of the frames of each span (media_id, seq, first, stop: samples), counted from its own first sample:
    (media_id, seq, sample_rate, per, levels). A span meets the square sums of the blocks it touches, and each block
    gives one row with its sums of the span's frames, so neither samples nor rows of frames are moved."""
    facts = blocks.groupBy("media_id").agg(F.max("sample_rate").alias("sample_rate"), F.max(F.size("samples")).alias("size"))
    per = F.greatest(F.floor(F.col("sample_rate") * frame_s), F.lit(1)).cast("long")
    rows = spans.where("stop > first").join(facts.withColumn("per", per), "media_id")
    rows = rows.withColumn("block_no", F.explode(F.sequence(F.floor(F.col("first") / F.col("size")), F.floor((F.col("stop") - 1) / F.col("size")))))
    met = rows.drop("sample_rate").join(square_sums(blocks).withColumnRenamed("sample_rate", "rate"), ["media_id", "block_no"])
    low = F.greatest(F.col("first"), F.col("first_sample"))
    high = F.least(F.col("stop"), F.col("first_sample") + F.size("sums") - 1)
    met = met.withColumns({"low": low, "high": high}).where("high > low")
    number = lambda at: F.floor((at - F.col("first")) / F.col("per"))
    edge = lambda n, low, high: F.least(F.greatest(F.col("first") + n * F.col("per"), low), high)
    look_up = lambda at: F.element_at("sums", (at - F.col("first_sample") + 1).cast("int"))
    own = lambda n: look_up(edge(n, F.col("low"), F.col("high")))
    squares = F.transform(F.sequence(number(F.col("low")), number(F.col("high") - 1)), lambda k: own(k + 1) - own(k))
    parts = met.select("media_id", "seq", F.col("rate").alias("sample_rate"), "per", "first", F.struct("low", "high", squares.alias("squares")).alias("part"))
    lists = parts.groupBy("media_id", "seq", "sample_rate", "per", "first").agg(F.array_sort(F.collect_list("part")).alias("parts"))

    def frames_of(part: Column) -> Column:
        def frame(square: Column, at: Column) -> Column:
            k = number(part["low"]) + at
            n = edge(k + 1, part["low"], part["high"]) - edge(k, part["low"], part["high"])
            return F.struct(k.alias("frame_no"), square.alias("square"), n.alias("n"))

        return F.transform(part["squares"], frame)

    def level(square: Column, n: Column) -> Column:
        return let(F.greatest(F.sqrt(square.cast("double") / n), F.lit(floor_rms)), lambda rms: F.when(rms <= 0, -100.0).otherwise(20 * F.log10(rms / 32768.0)))

    def levels(frames: Column) -> Column:
        """A frame that blocks share stands in each of them, one after the other."""
        starts = F.filter(F.sequence(F.lit(1), F.size(frames)), lambda at: (at == 1) | (F.get(frames, at - 1)["frame_no"] != F.get(frames, at - 2)["frame_no"]))

        def summed(starts: Column) -> Column:
            def whole(at: Column, n: Column) -> Column:
                same = F.slice(frames, at, F.coalesce(F.get(starts, n + 1), F.size(frames) + 1) - at)
                total = lambda name: F.aggregate(same, F.lit(0).cast("long"), lambda s, x: s + x[name])
                return level(total("square"), total("n"))

            return F.transform(starts, whole)

        return let(starts, summed)

    return lists.select("media_id", "seq", "sample_rate", "per", let(F.flatten(F.transform("parts", frames_of)), levels).alias("levels"))


def _totals(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("media_id").agg(F.max("sample_rate").alias("rate"), F.max(F.col("first_sample") + F.size("samples")).alias("total"))


def media_levels(blocks: DataFrame, frame_s: float = 0.03) -> DataFrame:
    """Frame levels of whole media (media_id, frame_no, start_s, level_db), frames counted from the first sample.

    A frame's square sums are added up over the blocks it touches, so no media is ever gathered in one place."""
    per = F.greatest(F.floor(F.col("sample_rate") * frame_s), F.lit(1))
    rows = blocks.where(F.size("samples") > 0).withColumn("per", per)
    rows = rows.withColumn("frame_no", F.explode(F.sequence(F.floor(F.col("first_sample") / F.col("per")), F.floor((F.col("first_sample") + F.size("samples") - 1) / F.col("per")))))
    low = F.greatest(F.col("frame_no") * F.col("per") - F.col("first_sample"), F.lit(0))
    high = F.least((F.col("frame_no") + 1) * F.col("per") - F.col("first_sample"), F.size("samples").cast("long"))
    part = F.slice("samples", (low + 1).cast("int"), (high - low).cast("int"))
    sums = rows.select("media_id", "frame_no", "per", "sample_rate", F.aggregate(part, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")).alias("square"), F.size(part).alias("n"))
    frames = sums.groupBy("media_id", "frame_no", "per", "sample_rate").agg(F.sum("square").alias("square"), F.sum("n").alias("n"))
    rms = F.sqrt(F.col("square") / F.col("n"))
    level = F.when(rms <= 0, -100.0).otherwise(20 * F.log10(rms / 32768.0))
    return frames.select("media_id", "frame_no", (F.col("frame_no") * F.col("per") / F.col("sample_rate")).alias("start_s"), level.alias("level_db"))


def silence_threshold(levels: DataFrame, media: DataFrame | None = None, min_db: float = -42.0, max_db: float = -28.0) -> DataFrame:
    """Threshold of each media between its noise floor (20th percentile) and speech level (85th); with ``media``, those
    without any frame get the lowest threshold."""
    per = levels.groupBy("media_id").agg(F.percentile("level_db", F.array(F.lit(0.2), F.lit(0.85))).alias("p"), F.count("*").alias("analyzed_frame_count"))
    floor, speech = F.col("p")[0], F.col("p")[1]
    lift = F.greatest(F.lit(6.0), F.least(F.lit(14.0), F.greatest(F.lit(0.0), speech - floor) * 0.35))
    threshold = F.greatest(F.lit(min_db), F.least(F.lit(max_db), floor + lift))
    out = per.select("media_id", timing.format_db(threshold).alias("threshold_db"), F.bround(floor, 2).alias("noise_floor_db"), F.bround(speech, 2).alias("speech_level_db"), "analyzed_frame_count")
    if media is None:
        return out
    fill = {"threshold_db": timing.format_db(F.lit(min_db)), "noise_floor_db": F.lit(min_db), "speech_level_db": F.lit(min_db), "analyzed_frame_count": F.lit(0).cast("long")}
    return media.select("media_id").join(out, "media_id", "left").withColumns({c: F.coalesce(F.col(c), v) for c, v in fill.items()})


def _stats(levels: Column, frame_s: float) -> Column:
    """Statistics of a cue's frame levels, in order."""

    def of(own: Column) -> Column:
        level, sorted_, n = own["level"], own["sorted"], F.size(own["level"])
        middle = (F.element_at(sorted_, F.floor((n + 1) / 2).cast("int")) + F.element_at(sorted_, F.floor(n / 2).cast("int") + 1)) / 2

        def rest(median: Column) -> Column:
            runs = F.struct(F.lit(0).alias("run"), F.lit(0).alias("best"))
            step = lambda acc, x: let(F.when(x > median + 8.0, acc["run"] + 1).otherwise(0), lambda r: F.struct(r.alias("run"), F.greatest(acc["best"], r).alias("best")))
            longest = F.aggregate(level, runs, step, lambda acc: acc["best"])
            first = F.coalesce(F.array_position(F.transform(level, lambda x: x > median + 8.0), True), F.lit(0))
            return F.struct(
                n.alias("frame_count"),
                F.bround(median, 3).alias("median_db"),
                F.bround(F.element_at(sorted_, -1), 3).alias("max_db"),
                F.bround(F.element_at(sorted_, F.least(n, F.floor(n * 0.9).cast("int") + 1)), 3).alias("p90_db"),
                F.bround(F.size(F.filter(level, lambda x: x > median + 8.0)) / n, 3).alias("speech_ratio"),
                F.bround(longest * frame_s, 3).alias("longest_island_s"),
                F.bround(F.when(first > 0, first - 1).otherwise(n) * frame_s, 3).alias("leading_quiet_s"),
            )

        return let(middle, rest)

    quiet = [F.lit(-120.0).alias(c) for c in ("median_db", "max_db", "p90_db")] + [F.lit(0.0).alias(c) for c in ("speech_ratio", "longest_island_s", "leading_quiet_s")]
    empty = F.struct(F.lit(0).alias("frame_count"), *quiet)
    return let(F.struct(levels.alias("level"), F.array_sort(levels).alias("sorted")), lambda own: F.when(F.coalesce(F.size(own["level"]), F.lit(0)) <= 0, empty).otherwise(of(own)))


def audio_stats(cues: DataFrame, blocks: DataFrame, frame_s: float = 0.05) -> DataFrame:
    """(media_id, seq, audio) of every cue; frames are counted from the cue's own start, and a cue that lasts at all has
    one sample at least. A cue behind the media's end has no frames."""
    spans = cues.select("media_id", "seq", "start_s", "end_s")
    first = F.greatest(F.floor(F.col("start_s") * F.col("rate")), F.lit(0))
    length = F.greatest(F.floor((F.col("end_s") - F.col("start_s")) * F.col("rate")), F.lit(1))
    asked = spans.where("end_s > start_s").join(_totals(blocks), "media_id").select("media_id", "seq", first.alias("first"), F.least(first + length, F.col("total")).alias("stop"))
    levels = framed_levels(asked, blocks, frame_s, floor_rms=1.0).select("media_id", "seq", "levels")
    return spans.join(levels, ["media_id", "seq"], "left").select("media_id", "seq", _stats(F.col("levels"), frame_s).alias("audio"))


def audio_stats_from_levels(cues: DataFrame, levels: DataFrame, frame_s: float, base_s: float = 16.0) -> DataFrame:
    """The same from a table of levels (media_id, frame_no, start_s, level_db): frames that start inside the cue, found
    by an interval join over cells of time, whose widths follow the cues' lengths."""
    spans = cues.select("media_id", "seq", "start_s", "end_s")
    frames = levels.select("media_id", "frame_no", F.col("start_s").alias("at_s"), "level_db")
    cells = interval_cells(spans, base_s)
    met = cells.join(point_cells(frames, cells, base_s, "at_s"), ["media_id", "level", "cell"]).where("at_s >= start_s and at_s < end_s")
    lists = met.groupBy("media_id", "seq").agg(F.array_sort(F.collect_list(F.struct("at_s", "frame_no", "level_db"))).alias("f"))
    lists = lists.select("media_id", "seq", F.transform("f", lambda x: x["level_db"]).alias("levels"))
    return spans.join(lists, ["media_id", "seq"], "left").select("media_id", "seq", _stats(F.col("levels"), frame_s).alias("audio"))


def refine_span_starts(spans: DataFrame, blocks: DataFrame, threshold_db: float, offset_db: float = 0.0, pre_roll_s: float = 0.1, frame_s: float = 0.03, consecutive: int = 3, max_adjustment_s: float = 3.0) -> tuple[DataFrame, DataFrame]:
    """Move span starts up to the first run of loud frames within ``max_adjustment_s``, less ``pre_roll_s``; also returns
    (media_id, adjusted_count, average_adjustment_s, max_adjustment_s)."""
    if frame_s <= 0 or consecutive < 1 or max_adjustment_s <= 0:
        moved = spans.withColumn("moved_s", F.lit(0.0))
    else:
        search = spans.select("media_id", "seq", "start_s", F.least("end_s", F.col("start_s") + max_adjustment_s).alias("end_s"))
        bound = lambda c: F.least(F.greatest(F.floor(F.col(c) * F.col("rate")), F.lit(0)), F.col("total"))
        asked = search.join(_totals(blocks), "media_id").select("media_id", "seq", bound("start_s").alias("first"), bound("end_s").alias("stop"))
        heard = framed_levels(asked, blocks, frame_s).withColumn("loud", F.transform("levels", lambda x: (x >= threshold_db + offset_db).cast("int")))
        spots = F.sequence(F.lit(0), F.greatest(F.size("loud") - consecutive, F.lit(0)))
        first = F.array_min(F.filter(spots, lambda at: F.aggregate(F.slice("loud", at + 1, consecutive), F.lit(0), lambda s, x: s + x) == consecutive))
        heard = heard.select("media_id", "seq", (first * F.col("per") / F.col("sample_rate")).alias("lead_s"), "sample_rate")
        rows = spans.join(heard, ["media_id", "seq"], "left")
        onset = F.greatest(F.col("start_s"), F.floor(F.col("start_s") * F.col("sample_rate")) / F.col("sample_rate") + F.col("lead_s"))
        new = F.greatest(F.col("start_s"), F.least(onset - pre_roll_s, F.col("end_s")))
        moves = F.coalesce((F.col("lead_s").isNotNull()) & (new > F.col("start_s")) & (new < F.col("end_s")), F.lit(False))
        moved = rows.select(*spans.columns, F.when(moves, new - F.col("start_s")).otherwise(0.0).alias("moved_s"))
    amount = F.when(F.col("moved_s") > 0, F.col("moved_s"))
    stats = moved.groupBy("media_id").agg(F.count(amount).alias("adjusted_count"), F.coalesce(F.bround(F.avg(amount), 3), F.lit(0.0)).alias("average_adjustment_s"), F.coalesce(F.bround(F.max(amount), 3), F.lit(0.0)).alias("max_adjustment_s"))
    return moved.withColumn("start_s", F.col("start_s") + F.col("moved_s")).drop("moved_s"), stats


def active_runs(levels: DataFrame, threshold_db: float) -> DataFrame:
    """Runs of consecutive frames at or above a level: (media_id, first_frame, last_frame, frames). Frames are numbered
    block by block, and a run is what frame number and number of loud frames before it have in common."""
    loud = numbered_in_blocks(levels.where(F.col("level_db") >= threshold_db).select("media_id", F.col("frame_no").cast("long").alias("seq")))
    runs = loud.groupBy("media_id", (F.col("seq") - F.col("place")).alias("run"))
    return runs.agg(F.min("seq").alias("first_frame"), F.max("seq").alias("last_frame"), F.count("*").alias("frames")).drop("run")


def longest_runs(levels: DataFrame, threshold_db: float) -> DataFrame:
    """(media_id, frames, loud_frames, longest_run): the longest run of consecutive frames at or above a level.

    Each block of frames is one state - first and last frame, frames at its ends that belong to one run, best run inside -
    and states of neighbours merge: a run that ends one block and one that begins the next are one. A gap in the
    numbers of frames ends a run. No task sees more than the frames of a block, or the states of a media."""
    rows = in_blocks(levels.select("media_id", F.col("frame_no").cast("long").alias("seq"), (F.col("level_db") >= threshold_db).alias("loud")))
    extent = rows.groupBy("media_id", "block").agg(F.min("seq").alias("first"), F.max("seq").alias("last"), F.count("*").alias("frames"), F.count_if("loud").alias("loud_frames"))
    order = Window.partitionBy("media_id", "block").orderBy("seq")
    inside = rows.where("loud").withColumn("run", F.col("seq") - F.row_number().over(order))
    inside = inside.groupBy("media_id", "block", "run").agg(F.min("seq").alias("from"), F.max("seq").alias("to"))
    ends = inside.join(extent, ["media_id", "block"]).groupBy("media_id", "block")
    length = F.col("to") - F.col("from") + 1
    ends = ends.agg(F.max(F.when(F.col("from") == F.col("first"), length)).alias("leading"), F.max(F.when(F.col("to") == F.col("last"), length)).alias("trailing"), F.max(length).alias("best"))
    states = extent.join(ends, ["media_id", "block"], "left").na.fill(0, ["leading", "trailing", "best"])
    listed = states.groupBy("media_id").agg(F.array_sort(F.collect_list(F.struct("first", "last", "leading", "trailing", "best"))).alias("states"), F.sum("frames").alias("frames"), F.sum("loud_frames").alias("loud_frames"))
    none = F.struct(F.lit(None).cast("long").alias("last"), F.lit(0).cast("long").alias("trailing"), F.lit(0).cast("long").alias("best"))

    def merged(acc: Column, state: Column) -> Column:
        carried = F.when(acc["last"] + 1 == state["first"], acc["trailing"]).otherwise(0)
        through = state["leading"] == state["last"] - state["first"] + 1
        trailing = F.when(through, carried + state["leading"]).otherwise(state["trailing"])
        return F.struct(state["last"].alias("last"), trailing.alias("trailing"), F.greatest(acc["best"], state["best"], carried + state["leading"]).alias("best"))

    return listed.select("media_id", "frames", "loud_frames", F.aggregate("states", none, merged, lambda acc: acc["best"]).alias("longest_run"))
