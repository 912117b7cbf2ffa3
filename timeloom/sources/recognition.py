"""Outputs of speech recognisers, in whatever shape, as raw chunks (media_id, segment_no, seq, start_s, end_s, text).

A JSON text is parsed once into a variant; what is looked up after that are paths in it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from ..operators.timeline import renumbered


def _text(value: Column, path: str = "$") -> Column:
    return F.try_variant_get(value, path, "string")


def _number(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "double")


def _list(value: Column, path: str = "$") -> Column:
    return F.try_variant_get(value, path, "array<variant>")


def _is_object(value: Column) -> Column:
    return F.startswith(F.schema_of_variant(value), F.lit("OBJECT"))


def decode_timestamp(item: Column) -> Column:
    """Struct of start_s, end_s and valid of an item's timestamp, or timestamps if that says nothing: a list of two, or
    start and end. A null start is 0, a null end the start. ``item`` is a variant."""

    def stamp_of(path: str) -> Column:
        return F.try_variant_get(item, path, "variant")

    given = _text(item, "$.timestamp")
    stamp = F.when(given.isNull() | given.isin("[]", "{}", "0", "false", ""), stamp_of("$.timestamps")).otherwise(stamp_of("$.timestamp"))
    pair, is_map = F.coalesce(F.size(_list(stamp)), F.lit(-1)), F.coalesce(_is_object(stamp), F.lit(False))
    start = F.coalesce(F.when(is_map, _number(stamp, "$.start")).otherwise(_number(stamp, "$[0]")), F.lit(0.0))
    end = F.coalesce(F.when(is_map, _number(stamp, "$.end")).otherwise(_number(stamp, "$[1]")), start)
    valid = is_map | (pair >= 2)
    return F.struct(F.when(valid, start).alias("start_s"), F.when(valid, end).alias("end_s"), valid.alias("valid"), _text(stamp).isNull().alias("absent"))


def explode_raw_chunks(raw: DataFrame) -> DataFrame:
    """Chunks of raw results (media_id, segment_no, raw): the list under ``chunks``, else those under every key that
    begins with it, in the order of keys. Items without any timestamp are skipped; one that cannot be read has valid
    false; a text that is no JSON has no chunks."""
    parsed = raw.select("media_id", "segment_no", "raw", F.try_parse_json("raw").alias("v"))
    whole, byname = _list(F.col("v"), "$.chunks"), F.try_variant_get("v", "$", "map<string,variant>")
    parsed = parsed.select("media_id", "segment_no", "raw", whole.alias("whole"), F.when(whole.isNull(), byname).alias("byname"))
    # a variant keeps keys by name; where their own order counts, the text tells it
    keys = F.filter(F.json_object_keys("raw"), lambda k: F.startswith(k, F.lit("chunks")))
    others = F.flatten(F.transform(keys, lambda k: F.coalesce(_list(F.col("byname")[k]), F.array().cast("array<variant>"))))
    items = F.coalesce("whole", F.when(F.col("byname").isNotNull(), F.filter(others, _is_object)))
    rows = parsed.select("media_id", "segment_no", F.posexplode(items).alias("at", "item"))
    stamp = decode_timestamp(F.col("item"))
    rows = rows.select("media_id", "segment_no", (F.col("at") + 1).cast("long").alias("seq"), stamp.alias("t"), F.coalesce(_text(F.col("item"), "$.text"), F.lit("")).alias("text"))
    return rows.where("not t.absent").select("media_id", "segment_no", "seq", "t.start_s", "t.end_s", "text", "t.valid")


def _fallback(df: DataFrame, chunks: DataFrame, length: Column) -> DataFrame:
    """One chunk of the whole text for media that have a text and no chunks."""
    text = strip(F.coalesce("text", F.lit("")))
    whole = df.join(chunks.select("media_id").distinct(), "media_id", "left_anti").where(text != "")
    whole = whole.select("media_id", F.lit(1).cast("long").alias("seq"), F.lit(0.0).alias("start_s"), length.alias("end_s"), text.alias("text"))
    return chunks.unionByName(whole)


def _length() -> Column:
    return F.coalesce(F.when(F.col("duration_s") != 0, F.col("duration_s")), F.lit(0.01))


def _times(item: Column, *, listed: Column | None = None, starts: list[str], ends: list[str]) -> tuple[Column, Column]:
    """Start and end of an item: the second and third of a list, else the first of the paths that is there, else a list of
    two under timestamp."""

    def first(paths: list[str]) -> tuple[Column, Column]:
        there = F.lit(False)
        value = F.lit(None).cast("double")
        for path in reversed(paths):
            here = _text(item, path).isNotNull()
            there, value = there | here, F.when(here, _number(item, path)).otherwise(value)
        return there, value

    (starts_there, start), (ends_there, end) = first(starts), first(ends)
    lacking = ~(starts_there & ends_there) & (F.coalesce(F.size(_list(item, "$.timestamp")), F.lit(0)) >= 2)
    start = F.when(lacking, _number(item, "$.timestamp[0]")).otherwise(start)
    end = F.when(lacking, _number(item, "$.timestamp[1]")).otherwise(end)
    if listed is not None:
        start, end = F.when(listed, _number(item, "$[1]")).otherwise(start), F.when(listed, _number(item, "$[2]")).otherwise(end)
    return start, end


def _items(df: DataFrame, items: Column) -> DataFrame:
    return df.select("media_id", F.posexplode(items).alias("at", "item")).withColumn("seq", (F.col("at") + 1).cast("long"))


def _valid(rows: DataFrame) -> DataFrame:
    """Without rows whose times are no numbers; none ends before it is longer than nothing."""
    rows = rows.where("start_s is not null and end_s is not null")
    return rows.withColumn("end_s", F.when(F.col("end_s") <= F.col("start_s"), F.col("start_s") + 0.01).otherwise(F.col("end_s")))


def adapt_word_timestamps(df: DataFrame) -> DataFrame:
    """Words (media_id, items: JSON list, text, duration_s): text, word or unit with start_time and end_time, start and
    end, a list of three, or a timestamp. Without any, the whole text is one chunk."""
    rows = _items(df, _list(F.try_parse_json("items")))
    item = F.col("item")
    listed = F.coalesce(F.size(_list(item)) >= 3, F.lit(False))
    named = F.coalesce(*[F.when(_text(item, f"$.{k}") != "", _text(item, f"$.{k}")) for k in ("text", "word", "unit")], F.lit(""))
    begin, stop = _times(item, listed=listed, starts=["$.start_time", "$.start"], ends=["$.end_time", "$.end"])
    rows = rows.select("media_id", "seq", begin.alias("start_s"), stop.alias("end_s"), F.when(listed, _text(item, "$[0]")).otherwise(named).alias("text"))
    return _fallback(df, renumbered(_valid(rows), "seq"), _length())


def adapt_segments(df: DataFrame) -> DataFrame:
    """Segments, else chunks (media_id, segments, chunks: JSON lists, text, duration_s); blank texts stay out."""
    said = lambda x: strip(F.coalesce(_text(x, "$.text"), F.lit("")))
    usable = lambda c: F.filter(F.coalesce(_list(F.try_parse_json(c)), F.array().cast("array<variant>")), lambda x: said(x) != "")
    parsed = df.withColumns({"segments": usable("segments"), "chunks": usable("chunks")})
    rows = _items(parsed, F.when(F.size("segments") > 0, F.col("segments")).otherwise(F.col("chunks")))
    begin, stop = _times(F.col("item"), starts=["$.start"], ends=["$.end"])
    rows = rows.select("media_id", "seq", begin.alias("start_s"), stop.alias("end_s"), said(F.col("item")).alias("text"))
    return _fallback(df, renumbered(_valid(rows), "seq"), _length())


def adapt_plain_segments(df: DataFrame, fallback: bool = True) -> DataFrame:
    """Segments (media_id, segments: JSON list, text) with start and end, null ones 0; blank texts stay out. With
    ``fallback`` a media without any gets its whole text as one chunk of 0.01 s."""
    rows = _items(df, _list(F.try_parse_json("segments")))
    number = lambda path: F.coalesce(_number(F.col("item"), path), F.lit(0.0))
    rows = rows.select("media_id", "seq", number("$.start").alias("start_s"), number("$.end").alias("end_s"), strip(F.coalesce(_text(F.col("item"), "$.text"), F.lit(""))).alias("text"))
    rows = renumbered(rows.where("text <> ''"), "seq")
    return _fallback(df, rows, F.lit(0.01)) if fallback else rows
