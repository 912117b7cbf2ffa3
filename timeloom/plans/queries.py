"""Registered queries over the driver's tables, each with the SQL it is compared with where SQL can express it.

Times are reported in whole milliseconds.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import timing
from ..operators import align, audio, cues, history, jobs, quality, spans, translate
from ..sources import recognition, reports, subtitles
from ..streaming import watch
from .views import CONVERSATION_CUES, EVENT_SPANS, LINE_CUES, conversation_cues, event_spans, line_cues, run_history, span_media, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return register


def ms(column: str | Column) -> Column:
    return F.floor((F.col(column) if isinstance(column, str) else column) * 1000.0 + 0.5).cast("long")


def _ms(expression: str) -> str:
    return f"CAST(floor(({expression}) * 1000.0::DOUBLE + 0.5::DOUBLE) AS BIGINT)"


def timed(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select("media_id", "seq", ms("start_s").alias("start_ms"), ms("end_s").alias("end_ms"), *more)


_CLEAN = r"regexp_replace(trim(text, ' ' || chr(9) || chr(10) || chr(13)), '\s+([。！？、,.!?])', '\1', 'g')"
_NORM = rf"regexp_replace(regexp_replace({_CLEAN}, '\s+', '', 'g'), '[。、，．,.!?！？…]+$', '')"


def _clean(value: str) -> str:
    return _CLEAN.replace("trim(text,", f"trim({value},")


def _norm(value: str) -> str:
    return _NORM.replace("trim(text,", f"trim({value},")


def _repaired(source: str) -> str:
    """CTEs (the last is ``repaired``) of repair_chunks, row by row."""
    return f"""said AS (SELECT media_id, seq, start_s, CASE WHEN end_s <= start_s THEN start_s + 0.01::DOUBLE ELSE end_s END AS end_s, {_CLEAN} AS text FROM {source}),
shown AS (SELECT *, lag(text) OVER (PARTITION BY media_id ORDER BY seq) AS before FROM said WHERE text <> ''),
numbered AS MATERIALIZED (SELECT media_id, row_number() OVER (PARTITION BY media_id ORDER BY seq) AS n, start_s, end_s, text FROM shown WHERE before IS NULL OR before <> text),
moved(media_id, n, a, b, text) AS (SELECT media_id, n, start_s, end_s, text FROM numbered WHERE n = 1 UNION ALL
  SELECT r.media_id, r.n, greatest(r.start_s, m.b), CASE WHEN r.end_s <= greatest(r.start_s, m.b) THEN greatest(r.start_s, m.b) + 0.01::DOUBLE ELSE r.end_s END, r.text
  FROM moved m JOIN numbered r ON r.media_id = m.media_id AND r.n = m.n + 1),
repaired AS MATERIALIZED (SELECT * FROM moved)"""


def _grouped(gap: float, duration: float, chars: int, source: str = "repaired") -> str:
    """CTEs (the last is ``grouped``) of group_cues on ``source``: ``own`` is a row's text, ``text`` what is open."""
    both = "o.text || CASE WHEN regexp_matches(o.text, '[A-Za-z0-9]$') AND regexp_matches(r.text, '^[A-Za-z0-9]') THEN ' ' ELSE '' END || r.text"
    both = _CLEAN.replace("trim(text,", f"trim({both},")
    new = f"r.a - o.b > {gap}::DOUBLE OR regexp_matches(o.own, '[。！？.!?]\\s*$') OR r.b - o.a > {duration}::DOUBLE OR length({both}) > {chars}"
    return f"""opened(media_id, n, part, a, b, own, text) AS (SELECT media_id, n, 1, a, b, text, text FROM {source} WHERE n = 1 UNION ALL
  SELECT r.media_id, r.n, CASE WHEN {new} THEN o.part + 1 ELSE o.part END, CASE WHEN {new} THEN r.a ELSE o.a END, r.b, r.text, CASE WHEN {new} THEN r.text ELSE {both} END
  FROM opened o JOIN {source} r ON r.media_id = o.media_id AND r.n = o.n + 1),
grouped AS (SELECT media_id, part AS seq, arg_max(a, n) AS start_s, arg_max(b, n) AS end_s, arg_max(text, n) AS text FROM opened GROUP BY media_id, part)"""


def _split_long(chars: int) -> str:
    """CTEs (the last is ``parts``) of split_long_text on the long texts of ``c`` (media_id, seq, most, text)."""
    return f"""l AS MATERIALIZED (SELECT *, list_filter(list_transform(string_split(regexp_replace(text, '([{T.SENTENCE_END}]+|{'|'.join(T.UNIT_ENDINGS)})', '\\1' || chr(1), 'g'), chr(1)), lambda x: {_clean('x')}), lambda x: x <> '') AS units FROM c WHERE length({_norm('text')}) > {chars}),
cut AS (SELECT media_id, seq, unnest(range(CAST(ceil(length(text)::DOUBLE / ceil(length(text) / most::DOUBLE)) AS BIGINT))) AS part, CAST(ceil(length(text) / most::DOUBLE) AS BIGINT) AS stride, text FROM l WHERE len(units) <= 1),
u AS MATERIALIZED (SELECT media_id, seq, most, unnest(range(1, len(units) + 1)) AS k, unnest(units) AS unit, len(units) AS n FROM l WHERE len(units) > 1),
t AS MATERIALIZED (SELECT media_id, seq, least(any_value(most), greatest(2, ceil(sum(length({_norm('unit')})) / {chars}.0::DOUBLE), least(any_value(most), max(n)))) AS goal, sum(length({_norm('unit')})) AS total FROM u GROUP BY media_id, seq),
w(media_id, seq, k, part, open, rest, goal) AS (SELECT media_id, seq, k, 0, unit, total - length({_norm('unit')}), goal FROM u JOIN t USING (media_id, seq) WHERE k = 1 UNION ALL
  SELECT media_id, seq, k, CASE WHEN close THEN part + 1 ELSE part END, CASE WHEN close THEN unit ELSE open || unit END, rest - length({_norm('unit')}), goal FROM (
    SELECT w.media_id, w.seq, u.k, w.part, w.open, u.unit, w.rest, w.goal,
      length({_norm("(w.open || u.unit)")}) > greatest(1, ceil(w.rest::DOUBLE / greatest(1, w.goal - w.part))) AND w.part < w.goal - 1 AS close FROM w JOIN u ON u.media_id = w.media_id AND u.seq = w.seq AND u.k = w.k + 1)),
parts AS (SELECT media_id, seq, part, substring(text, part * stride + 1, stride) AS text FROM cut UNION ALL SELECT media_id, seq, part, arg_max(open, k) FROM w GROUP BY media_id, seq, part)"""


_BARE = "regexp_replace(text, '\\s+', '', 'g') <> '' AND NOT regexp_matches(text, '[\\p{L}\\p{N}\\p{M}_]')"
_FLAGS = f"""f AS (SELECT *, end_s - start_s AS d, length({_NORM}) AS n FROM line_cues),
flagged AS (SELECT media_id, seq + 1 AS idx, d, list_filter([CASE WHEN d < 0.3::DOUBLE THEN 'near_zero_duration' END,
  CASE WHEN regexp_replace(text, '\\s+', '', 'g') <> '' AND NOT regexp_matches(text, '[\\p{{L}}\\p{{N}}\\p{{M}}_]') THEN 'punctuation_only' END,
  CASE WHEN d >= 8.0 AND n <= 30 THEN 'long_duration_short_text' END, CASE WHEN d >= 12.0 AND n >= 25 THEN 'long_subtitle_split_candidate' END,
  CASE WHEN d >= 8.0 AND n::DOUBLE / d < 2.0 THEN 'low_chars_per_second' END], lambda x: x IS NOT NULL) AS flags FROM f),
issues AS (SELECT *, CASE WHEN list_contains(flags, 'punctuation_only') OR list_contains(flags, 'near_zero_duration') THEN 'drop'
  WHEN list_contains(flags, 'long_subtitle_split_candidate') THEN 'split_candidate' ELSE 'review' END AS action FROM flagged WHERE len(flags) > 0)"""
_COUNTERS = """SELECT media_id, count(*) AS issue_count, count(*) FILTER (WHERE action = 'drop') AS drop_count, 0::BIGINT AS drop_candidate_count, 0::BIGINT AS resegment_candidate_count,
count(*) FILTER (WHERE action = 'split_candidate') AS split_candidate_count, 0::BIGINT AS refine_start_candidate_count, count(*) FILTER (WHERE action = 'review') AS review_count FROM issues GROUP BY media_id"""


# ---- whole chains --------------------------------------------------------------------------------------------------


@query(f"""WITH RECURSIVE {CONVERSATION_CUES}, {_repaired('conversation_cues')}, {_grouped(0.5, 20.0, 400)}, {_FLAGS.replace('FROM line_cues', 'FROM grouped')} {_COUNTERS}""")
def timeline_health(spark, sf_dir):
    """Which timelines hold suspicious cues, and why: repair, group, flag, count."""
    grouped = cues.group_cues(cues.repair_chunks(conversation_cues(spark, sf_dir)), max_gap_s=0.5, max_duration_s=20.0, max_chars=400, cleaned=True)
    return quality.stage_counters(quality.quality_issues(grouped))


@query(f"""WITH RECURSIVE {LINE_CUES}, {_repaired('line_cues')}, {_grouped(0.5, 12.0, 120)}
SELECT media_id, seq, {_ms('start_s')} AS start_ms, {_ms('end_s')} AS end_ms, text FROM grouped""")
def line_grouping(spark, sf_dir):
    """Lines of all documents repaired and grouped into cues."""
    return timed(cues.group_cues(cues.repair_chunks(line_cues(spark, sf_dir)), 0.5, 12.0, 120, cleaned=True), "text")


@query(f"""WITH {LINE_CUES}, shown AS (SELECT * FROM line_cues WHERE trim(text, ' ' || chr(9) || chr(13)) <> ''),
marked AS (SELECT *, lag(text) OVER (PARTITION BY media_id ORDER BY seq) AS before FROM shown)
SELECT media_id, count(*) AS cues, count(*) FILTER (WHERE before = text) AS repeats FROM marked GROUP BY media_id""")
def repeated_lines(spark, sf_dir):
    rows = line_cues(spark, sf_dir).where(T.strip(F.col("text")) != "")
    rows = rows.withColumn("before", F.lag("text").over(Window.partitionBy("media_id").orderBy("seq")))
    return rows.groupBy("media_id").agg(F.count("*").alias("cues"), F.count_if(F.col("before") == F.col("text")).alias("repeats"))


@query(f"""WITH RECURSIVE {CONVERSATION_CUES}, {_repaired('conversation_cues')}, {_grouped(0.5, 30.0, 400)},
said_so AS (SELECT *, end_s - start_s AS d, length({_NORM}) AS size, {_BARE} AS bare FROM grouped),
kept AS MATERIALIZED (SELECT media_id, row_number() OVER (PARTITION BY media_id ORDER BY seq) AS seq, start_s, end_s, text, d, size FROM said_so WHERE NOT (bare OR (d < 0.3::DOUBLE AND size >= 5))),
c AS MATERIALIZED (SELECT media_id, seq, greatest(2, ceil(d / 8.0::DOUBLE)) AS most, {_CLEAN} AS text FROM kept WHERE d >= 12.0 AND size >= 25), {_split_long(28)},
weighed AS (SELECT *, greatest(1, length({_norm('text')})) AS weight, count(*) OVER (PARTITION BY media_id, seq) AS part_count FROM parts),
placed AS (SELECT media_id, seq, part, part_count, text, coalesce(sum(weight) OVER (PARTITION BY media_id, seq ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS upto, weight, sum(weight) OVER (PARTITION BY media_id, seq) AS total FROM weighed),
done AS (SELECT k.media_id, k.seq, coalesce(p.part, 0) AS part, CASE WHEN p.part IS NULL THEN k.start_s ELSE k.start_s + (k.end_s - k.start_s) * upto::DOUBLE / total::DOUBLE END AS start_s,
  CASE WHEN p.part IS NULL OR p.part = part_count - 1 THEN k.end_s ELSE k.start_s + (k.end_s - k.start_s) * (upto + weight)::DOUBLE / total::DOUBLE END AS end_s, coalesce(p.text, k.text) AS text
  FROM kept k LEFT JOIN placed p ON p.media_id = k.media_id AND p.seq = k.seq AND part_count > 1)
SELECT media_id, row_number() OVER (PARTITION BY media_id ORDER BY seq, part) AS seq, {_ms('start_s')} AS start_ms, {_ms('end_s')} AS end_ms, text FROM done""")
def standalone_chain(spark, sf_dir):
    """Repair, group, drop, flag, split, flag again: what is left of each timeline."""
    grouped = cues.group_cues(cues.repair_chunks(conversation_cues(spark, sf_dir)), 0.5, 30.0, 400, cleaned=True)
    kept, _ = quality.split_hallucinations(grouped)
    split, _ = cues.split_long_cues(kept, quality.quality_issues(kept))
    return timed(split, "text")


_CUT = lambda i: f"CAST(round_even(length(text) * {i} / pieces::DOUBLE, 0) AS BIGINT)"


@query(f"""WITH RECURSIVE {EVENT_SPANS}, spoken AS (SELECT media_id, seq, start_s, end_s, event_type || ' ' || round_even(value, 0)::VARCHAR || ' said.' AS text FROM event_spans WHERE event_type <> 'error'), {_repaired('spoken')},
quiet AS (SELECT media_id, seq AS s, start_s AS qa, end_s AS qb FROM event_spans WHERE event_type = 'error'),
inside AS (SELECT r.media_id, r.n, r.a, r.b, s, qa, qb, greatest(r.a, coalesce(max(qb) OVER (PARTITION BY r.media_id, r.n ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), r.a)) AS from_s
  FROM repaired r JOIN quiet q ON q.media_id = r.media_id AND qa > r.a AND qb < r.b AND qa - r.a >= 0.8::DOUBLE AND r.b - qb >= 0.8::DOUBLE),
stretches AS (SELECT media_id, n, s, from_s, qa AS to_s FROM inside UNION ALL SELECT media_id, n, max(s) + 1, max(qb), any_value(b) FROM inside GROUP BY media_id, n),
dealt AS (SELECT *, row_number() OVER (PARTITION BY media_id, n ORDER BY s) - 1 AS piece, count(*) OVER (PARTITION BY media_id, n) AS pieces FROM stretches WHERE to_s - from_s >= 0.8::DOUBLE),
pieced AS (SELECT r.media_id, r.n, coalesce(piece, 0) AS piece, coalesce(from_s, r.a) AS a, coalesce(to_s, r.b) AS b,
  CASE WHEN piece IS NULL THEN text ELSE {_clean(f"substring(text, {_CUT('piece')} + 1, {_CUT('(piece + 1)')} - {_CUT('piece')})")} END AS text
  FROM repaired r LEFT JOIN dealt d ON d.media_id = r.media_id AND d.n = r.n AND pieces > 1),
cut_cues AS MATERIALIZED (SELECT media_id, row_number() OVER (PARTITION BY media_id ORDER BY n, piece) AS n, a, b, text FROM pieced WHERE text <> ''), {_grouped(0.5, 6.0, 42, 'cut_cues')},
read AS (SELECT *, greatest(0.8::DOUBLE, least(5.0::DOUBLE, length(regexp_replace({_CLEAN}, '\\s+', '', 'g'))::DOUBLE / 5.0::DOUBLE + 0.4::DOUBLE)) AS target FROM grouped),
tight AS (SELECT media_id, seq, start_s, CASE WHEN end_s - start_s - target > 0 AND end_s - start_s - target >= 0.1::DOUBLE THEN start_s + target ELSE end_s END AS end_s, text FROM read),
late AS (SELECT media_id, seq, greatest(0.0::DOUBLE, start_s + 0.5::DOUBLE) AS start_s, greatest(0.0::DOUBLE, end_s + 0.5::DOUBLE) AS end_s, text, regexp_replace({_CLEAN}, '\\s+', '', 'g') AS norm FROM tight),
left_over AS (SELECT * FROM late WHERE NOT (norm = 'click1.0said.' AND end_s - start_s <= 2.0::DOUBLE) AND norm <> 'view2.0said.' AND (norm = '' OR regexp_matches(norm, '[\\p{{L}}\\p{{N}}]'))),
known AS (SELECT media_id, max(end_s) + 10.0::DOUBLE AS duration_s FROM event_spans GROUP BY media_id),
clamped AS (SELECT media_id, seq, start_s, least(end_s, duration_s) AS end_s, text FROM left_over JOIN known USING (media_id))
SELECT media_id, seq, {_ms('start_s')} AS start_ms, {_ms('end_s')} AS end_ms, text FROM clamped WHERE end_s > start_s""")
def docker_chain(spark, sf_dir):
    """Repair, cut at silences, group, tighten, shift, filter, clamp: the older chain."""
    rows = event_spans(spark, sf_dir)
    said = rows.where("event_type <> 'error'").withColumn("text", F.concat_ws(" ", "event_type", F.bround("value").cast("string"), F.lit("said.")))
    cut = cues.split_cues_on_silence(cues.repair_chunks(said), rows.where("event_type = 'error'"), 0.8)
    tight = cues.shift_cues(cues.tighten_cues(cues.group_cues(cut, cleaned=True)), 0.5)
    filtered = cues.drop_punctuation_only(cues.drop_phrases(cues.drop_short_phrases(tight, ["click 1.0 said."], 2.0), ["view 2.0 said."]))
    return timed(cues.clamp_cues(filtered, span_media(rows)), "text")


# ---- text ----------------------------------------------------------------------------------------------------------

@query(f"""WITH {LINE_CUES} SELECT media_id, seq, {_CLEAN} AS clean, length({_NORM}) AS norm_length,
regexp_matches(text, '[。！？.!?]\\s*$') AS ends, length({_NORM}) > 0 AND NOT regexp_matches(text, '[\\p{{L}}\\p{{N}}_]') AS bare FROM line_cues""")
def cue_texts(spark, sf_dir):
    text = F.col("text")
    bare = (F.length(T.normalize_phrase(text)) > 0) & T.is_punctuation_only(text)
    return line_cues(spark, sf_dir).select("media_id", "seq", T.clean_text(text).alias("clean"), F.length(T.normalize_phrase(text)).cast("long").alias("norm_length"), T.ends_sentence(text).alias("ends"), bare.alias("bare"))


@query(f"""WITH {CONVERSATION_CUES}, norm AS (SELECT media_id, seq, {_NORM} AS a, lead({_NORM}) OVER (PARTITION BY media_id ORDER BY seq) AS b FROM conversation_cues),
grams AS (SELECT *, CASE WHEN length(a) <= 2 THEN [a] ELSE list_distinct(list_transform(range(1, length(a)), lambda i: substring(a, i, 2))) END AS x,
  CASE WHEN length(b) <= 2 THEN [b] ELSE list_distinct(list_transform(range(1, length(b)), lambda i: substring(b, i, 2))) END AS y FROM norm WHERE b IS NOT NULL)
SELECT media_id, seq, CAST(floor((CASE WHEN a = '' OR b = '' THEN 0.0 WHEN contains(a, b) OR contains(b, a) THEN 1.0
  ELSE len(list_intersect(x, y))::DOUBLE / len(list_distinct(list_concat(x, y)))::DOUBLE END) * 1000000) AS BIGINT) AS similarity FROM grams""")
def turn_similarity(spark, sf_dir):
    rows = conversation_cues(spark, sf_dir).withColumn("after", F.lead("text").over(Window.partitionBy("media_id").orderBy("seq"))).where("after is not null")
    return rows.select("media_id", "seq", F.floor(T.text_similarity(F.col("text"), F.col("after")) * 1000000).cast("long").alias("similarity"))


@query(f"""WITH RECURSIVE {CONVERSATION_CUES}, c AS MATERIALIZED (SELECT media_id, seq, 4 AS most, {_CLEAN} AS text FROM conversation_cues), {_split_long(60)}
SELECT media_id, seq, CAST(0 AS INTEGER) AS part, text FROM c WHERE length({_norm('text')}) <= 60 UNION ALL SELECT media_id, seq, CAST(part AS INTEGER), text FROM parts""")
def long_text_parts(spark, sf_dir):
    rows = conversation_cues(spark, sf_dir)
    parts = T.split_long_text(F.col("text"), F.lit(4), 60)
    return rows.select("media_id", "seq", F.posexplode(parts).alias("part", "text"))


@query(f"""WITH RECURSIVE {CONVERSATION_CUES}, l AS MATERIALIZED (SELECT media_id, seq, text,
  list_filter(list_transform(regexp_extract_all(text, '.+?[。！？!?]+|.+?[、,]+|.+'), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13))), lambda x: x <> '') AS units FROM conversation_cues),
cut AS (SELECT media_id, seq, part, substring(text, CAST(round_even(length(text) * part / 3.0::DOUBLE, 0) AS BIGINT) + 1,
  CAST(round_even(length(text) * (part + 1) / 3.0::DOUBLE, 0) AS BIGINT) - CAST(round_even(length(text) * part / 3.0::DOUBLE, 0) AS BIGINT)) AS text FROM l, range(3) r(part) WHERE len(units) < 3),
u AS MATERIALIZED (SELECT media_id, seq, unnest(range(len(units))) AS k, unnest(units) AS unit, len(units) AS n, list_sum(list_transform(units, lambda x: length(x))) AS chars FROM l WHERE len(units) >= 3),
w(media_id, seq, k, part, used) AS (SELECT media_id, seq, k, 0, length(unit) FROM u WHERE k = 0 UNION ALL
  SELECT media_id, seq, k, CASE WHEN stays THEN part ELSE part + 1 END, CASE WHEN stays THEN used + length(unit) ELSE length(unit) END FROM (
    SELECT u.media_id, u.seq, u.k, w.part, w.used, u.unit, w.part >= 2 OR (u.k < u.n - (3 - w.part - 1)
      AND w.used + length(u.unit) <= greatest(1, round_even(u.chars * CASE w.part WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 2.5::DOUBLE ELSE 0.5::DOUBLE END / 4.0::DOUBLE, 0))) AS stays
    FROM w JOIN u ON u.media_id = w.media_id AND u.seq = w.seq AND u.k = w.k + 1))
SELECT media_id, seq, CAST(part AS INTEGER) AS part, text FROM cut UNION ALL
SELECT media_id, seq, CAST(part AS INTEGER), string_agg(unit, '' ORDER BY k) FROM w JOIN u USING (media_id, seq, k) GROUP BY media_id, seq, part""")
def allocated_texts(spark, sf_dir):
    rows = conversation_cues(spark, sf_dir)
    return rows.select("media_id", "seq", F.posexplode(T.allocate_text(F.col("text"), F.array(F.lit(1.0), F.lit(2.5), F.lit(0.5)))).alias("part", "text"))


_TIME = lambda c: f"printf('%02d:%02d:%02d,%03d', ms_{c} // 3600000, ms_{c} // 60000 % 60, ms_{c} // 1000 % 60, ms_{c} % 1000)"


@query(f"""WITH {CONVERSATION_CUES}, t AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY seq) AS n,
  CAST(round_even(start_s * 1000, 0) AS BIGINT) AS ms_a, CAST(round_even(end_s * 1000, 0) AS BIGINT) AS ms_b FROM conversation_cues)
SELECT media_id, string_agg(n || chr(10) || {_TIME('a')} || ' --> ' || {_TIME('b')} || chr(10) || text, chr(10) || chr(10) ORDER BY n) || chr(10) AS body FROM t GROUP BY media_id""")
def srt_texts(spark, sf_dir):
    return subtitles.render_srt(conversation_cues(spark, sf_dir))


@query(f"""WITH {CONVERSATION_CUES} SELECT media_id, row_number() OVER (PARTITION BY media_id ORDER BY seq) AS seq, CAST(round_even(start_s * 1000, 0) AS BIGINT) AS start_ms,
  CAST(round_even(end_s * 1000, 0) AS BIGINT) AS end_ms, {_CLEAN} AS text FROM conversation_cues WHERE {_CLEAN} <> ''""")
def srt_round_trip(spark, sf_dir):
    texts = subtitles.render_srt(conversation_cues(spark, sf_dir))
    return timed(subtitles.parse_srt(texts), "text")


@query(f"""WITH {LINE_CUES} SELECT media_id, string_agg(text, chr(10) ORDER BY seq) || chr(10) AS body FROM line_cues GROUP BY media_id""")
def txt_texts(spark, sf_dir):
    return subtitles.render_txt(line_cues(spark, sf_dir))


# ---- spans ---------------------------------------------------------------------------------------------------------


@query(f"""WITH {EVENT_SPANS}, m AS (SELECT *, max(end_s) OVER (PARTITION BY media_id ORDER BY start_s, end_s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM event_spans),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_s > reach + 0.05::DOUBLE THEN 1 ELSE 0 END) OVER (PARTITION BY media_id ORDER BY start_s, end_s ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT media_id, row_number() OVER (PARTITION BY media_id ORDER BY island) AS seq, {_ms('min(start_s)')} AS start_ms, {_ms('max(end_s)')} AS end_ms FROM i GROUP BY media_id, island""")
def merged_overlaps(spark, sf_dir):
    return timed(spans.merge_overlapping_spans(event_spans(spark, sf_dir)))


_ISLANDS = """i AS (SELECT *, sum(CASE WHEN before IS NULL OR start_s > before THEN 1 ELSE 0 END) OVER (PARTITION BY media_id ORDER BY seq) AS island
  FROM (SELECT *, lag(end_s) OVER (PARTITION BY media_id ORDER BY seq) AS before FROM g)),
mm AS (SELECT media_id, island, arg_min(start_s, seq) AS start_s, arg_max(end_s, seq) AS end_s FROM i GROUP BY media_id, island),
p AS (SELECT *, unnest(range(CAST(greatest(0, ceil((end_s - start_s) / 30.0::DOUBLE) - 1) AS BIGINT) + 1)) AS k, greatest(0, ceil((end_s - start_s) / 30.0::DOUBLE) - 1) AS whole FROM mm WHERE end_s > start_s)"""


@query(f"""WITH {EVENT_SPANS}, media AS (SELECT media_id, max(end_s) + 10.0::DOUBLE AS duration_s FROM event_spans GROUP BY media_id),
g AS (SELECT media_id, seq, greatest(0.0::DOUBLE, start_s - 0.4::DOUBLE) AS start_s, least(duration_s, end_s + 0.4::DOUBLE) AS end_s FROM event_spans JOIN media USING (media_id) WHERE end_s - start_s >= 0.25::DOUBLE), {_ISLANDS}
SELECT media_id, row_number() OVER (PARTITION BY media_id ORDER BY island, k) AS seq, {_ms('start_s + k * 30.0::DOUBLE')} AS start_ms,
  {_ms('CASE WHEN k < whole THEN start_s + (k + 1) * 30.0::DOUBLE ELSE end_s END')} AS end_ms FROM p""")
def normalized_spans(spark, sf_dir):
    rows = event_spans(spark, sf_dir)
    return timed(spans.normalize_spans(rows, span_media(rows), 0.25, 30.0, 0.4))


@query(f"""WITH {EVENT_SPANS}, media AS (SELECT media_id, max(end_s) + 10.0::DOUBLE AS duration_s FROM event_spans GROUP BY media_id),
q AS (SELECT *, greatest(0.0::DOUBLE, coalesce(max(end_s) OVER (PARTITION BY media_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE)) AS from_s FROM event_spans WHERE event_type = 'error'),
e AS (SELECT media_id, max(end_s) AS from_s, max(seq) + 1 AS seq FROM q GROUP BY media_id),
a AS (SELECT media_id, seq, from_s, start_s AS to_s FROM q UNION ALL SELECT media_id, coalesce(seq, 1), greatest(0.0::DOUBLE, coalesce(from_s, 0.0::DOUBLE)), duration_s FROM media LEFT JOIN e USING (media_id)),
g AS (SELECT media_id, seq, greatest(0.0::DOUBLE, from_s) AS start_s, least(duration_s, to_s) AS end_s FROM a JOIN media USING (media_id) WHERE to_s - from_s >= 0.25::DOUBLE AND least(duration_s, to_s) - greatest(0.0::DOUBLE, from_s) >= 0.25::DOUBLE), {_ISLANDS}
SELECT media_id, row_number() OVER (PARTITION BY media_id ORDER BY island, k) AS seq, {_ms('start_s + k * 30.0::DOUBLE')} AS start_ms,
  {_ms('CASE WHEN k < whole THEN start_s + (k + 1) * 30.0::DOUBLE ELSE end_s END')} AS end_ms FROM p""")
def speech_between_silences(spark, sf_dir):
    rows = event_spans(spark, sf_dir)
    return timed(spans.complement_spans(rows.where("event_type = 'error'"), span_media(rows), 0.25, 30.0))


@query(f"""WITH RECURSIVE {EVENT_SPANS}, r AS MATERIALIZED (SELECT media_id, row_number() OVER (PARTITION BY media_id ORDER BY seq) AS n, start_s, end_s FROM event_spans),
m(media_id, n, part, a, b) AS (SELECT media_id, n, 1, start_s, end_s FROM r WHERE n = 1 UNION ALL
  SELECT r.media_id, r.n, CASE WHEN start_s - b <= 5.0::DOUBLE AND end_s - a <= 60.0::DOUBLE THEN part ELSE part + 1 END, CASE WHEN start_s - b <= 5.0::DOUBLE AND end_s - a <= 60.0::DOUBLE THEN a ELSE start_s END, end_s
  FROM m JOIN r ON r.media_id = m.media_id AND r.n = m.n + 1)
SELECT media_id, part AS seq, {_ms('arg_max(a, n)')} AS start_ms, {_ms('arg_max(b, n)')} AS end_ms FROM m GROUP BY media_id, part""")
def docker_merged_spans(spark, sf_dir):
    return timed(spans.merge_spans(event_spans(spark, sf_dir), 60.0, 5.0, "docker"))


@query("""WITH m AS (SELECT doc_id AS media_id, length(text) * 160 AS total FROM documents WHERE length(text) > 0),
g AS (SELECT *, greatest(0, ceil((total - 160000)::DOUBLE / 144000::DOUBLE)) + 1 AS n FROM m)
SELECT media_id, k AS chunk_no, k * 144000 AS first_frame, least(160000, total - k * 144000) AS frames FROM (SELECT *, unnest(range(CAST(n AS BIGINT))) AS k FROM g)""")
def work_grid(spark, sf_dir):
    media = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("media_id"), F.lit(16000).alias("sample_rate"), (F.length("text").cast("long") * 160).alias("frames"))
    return spans.chunk_grid(media, 10.0, 1.0)


@query(f"""WITH {EVENT_SPANS}, q AS (SELECT media_id, seq AS s, start_s AS a, end_s AS b FROM event_spans WHERE event_type = 'error')
SELECT c.media_id, c.seq, s AS silence_seq FROM event_spans c JOIN q ON c.media_id = q.media_id AND a > c.start_s AND b < c.end_s AND a - c.start_s >= 0.8::DOUBLE AND c.end_s - b >= 0.8::DOUBLE WHERE event_type <> 'error'""")
def silences_in_cues(spark, sf_dir):
    rows = event_spans(spark, sf_dir)
    return cues.silences_inside(rows.where("event_type <> 'error'"), rows.where("event_type = 'error'"), 0.8).select("media_id", "seq", "silence_seq")


# ---- cues ----------------------------------------------------------------------------------------------------------


@query(f"""WITH {CONVERSATION_CUES}, t AS (SELECT *, greatest(0.8::DOUBLE, least(5.0::DOUBLE, length(regexp_replace({_CLEAN}, '\\s+', '', 'g'))::DOUBLE / 5.0::DOUBLE + 0.4::DOUBLE)) AS target FROM conversation_cues),
u AS (SELECT media_id, seq, start_s, CASE WHEN end_s - start_s - target > 0 AND end_s - start_s - target >= 0.1::DOUBLE THEN start_s + target ELSE end_s END AS end_s FROM t),
v AS (SELECT media_id, seq, greatest(0.0::DOUBLE, start_s + 0.5::DOUBLE) AS start_s, greatest(0.0::DOUBLE, end_s + 0.5::DOUBLE) AS end_s FROM u),
d AS (SELECT media_id, max(start_s) * 0.75::DOUBLE AS duration_s FROM conversation_cues GROUP BY media_id),
w AS (SELECT media_id, seq, start_s, CASE WHEN duration_s > 0 THEN least(end_s, duration_s) ELSE end_s END AS end_s, duration_s FROM v JOIN d USING (media_id))
SELECT media_id, seq, {_ms('start_s')} AS start_ms, {_ms('end_s')} AS end_ms FROM w WHERE NOT duration_s > 0 OR end_s > start_s""")
def retimed_cues(spark, sf_dir):
    rows = conversation_cues(spark, sf_dir)
    media = rows.groupBy("media_id").agg((F.max("start_s") * 0.75).alias("duration_s"))
    return timed(cues.clamp_cues(cues.shift_cues(cues.tighten_cues(rows), 0.5), media))


@query(f"""WITH {LINE_CUES}, {_FLAGS} SELECT media_id, idx, {_ms('d')} AS duration_ms, array_to_string(flags, ',') AS flags, action AS recommended_action FROM issues""")
def line_issues(spark, sf_dir):
    found = quality.quality_issues(line_cues(spark, sf_dir))
    return found.select("media_id", "idx", ms("duration_s").alias("duration_ms"), F.array_join("flags", ",").alias("flags"), "recommended_action")


@query(f"""WITH {LINE_CUES}, {_FLAGS} {_COUNTERS}""")
def issue_counters(spark, sf_dir):
    return quality.stage_counters(quality.quality_issues(line_cues(spark, sf_dir)))


@query(f"""WITH {EVENT_SPANS}, c AS (SELECT media_id, seq AS idx, end_s - start_s AS d, CASE WHEN event_type = 'click' THEN 0 ELSE 1 END AS p FROM event_spans WHERE end_s - start_s BETWEEN 10.0 AND 30.0)
SELECT media_id, idx, priority FROM (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY p, d DESC, idx) AS priority FROM c) WHERE priority <= 5""")
def top_tails(spark, sf_dir):
    rows = event_spans(spark, sf_dir)
    issues = rows.select("media_id", F.col("seq").alias("idx"), (F.col("end_s") - F.col("start_s")).alias("duration_s"), F.when(F.col("event_type") == "click", "resegment_candidate").otherwise("drop_candidate").alias("recommended_action"), F.array(F.lit("low_chars_per_second")).alias("flags"))
    return quality.top_tail_candidates(issues, 5).select("media_id", "idx", F.col("priority").cast("long").alias("priority"))


@query(f"""WITH {CONVERSATION_CUES}, d AS (SELECT conv_id AS media_id, turn AS seq, text AS phrase FROM conversations WHERE turn = 0 AND conv_id % 7 = 0),
p AS (SELECT DISTINCT regexp_replace({_CLEAN.replace('(text', '(phrase')}, '\\s+', '', 'g') AS norm FROM d)
SELECT media_id, seq FROM conversation_cues WHERE regexp_replace({_CLEAN}, '\\s+', '', 'g') NOT IN (SELECT norm FROM p)""")
def without_known_openers(spark, sf_dir):
    """Cues whose text is none of a list of known ones: an anti-join on normalised text."""
    rows = conversation_cues(spark, sf_dir)
    known = table(spark, sf_dir, "conversations").where("turn = 0 and conv_id % 7 = 0").select(F.col("text").alias("phrase"))
    return cues.drop_phrases(rows, known).select("media_id", "seq")


@query(f"""WITH {CONVERSATION_CUES}, a AS (SELECT media_id, seq, start_s + 0.2::DOUBLE AS a, end_s - 0.3::DOUBLE AS b FROM conversation_cues WHERE seq % 3 <> 2),
j AS (SELECT c.*, a.a, a.b, a.seq IS NOT NULL AS found FROM conversation_cues c LEFT JOIN a ON c.media_id = a.media_id AND c.seq = a.seq),
s AS (SELECT *, CASE WHEN NOT found THEN start_s ELSE greatest(0.0::DOUBLE, CASE WHEN b > a THEN a ELSE start_s END) END AS ns FROM j),
e AS (SELECT *, CASE WHEN NOT found THEN end_s ELSE greatest(ns + 0.8::DOUBLE, CASE WHEN end_s > ns THEN greatest(CASE WHEN b > a THEN b ELSE end_s END, end_s) ELSE CASE WHEN b > a THEN b ELSE end_s END END) END AS ne FROM s)
SELECT media_id, count(*) AS input_count, count(*) FILTER (WHERE abs(ns - start_s) >= 0.02::DOUBLE OR abs(ne - end_s) >= 0.02::DOUBLE) AS changed_count, count(*) FILTER (WHERE found) AS aligned_count, {_ms('sum(ns)')} // 1000 AS starts FROM e GROUP BY media_id""")
def alignment_changes(spark, sf_dir):
    rows = conversation_cues(spark, sf_dir)
    aligned = rows.where("seq % 3 <> 2").select("media_id", "seq", (F.col("start_s") + 0.2).alias("start_s"), (F.col("end_s") - 0.3).alias("end_s"), "text", F.lit(None).cast("array<struct<start_s: double, end_s: double>>").alias("words"))
    merged = align.merge_alignment(rows, aligned)
    starts = merged.groupBy("media_id").agg(F.floor(ms(F.sum("start_s")) / 1000).alias("starts"))
    return align.alignment_report(rows, merged, aligned).drop("segments").join(starts, "media_id")


# ---- audio ---------------------------------------------------------------------------------------------------------


def _levels(spark, sf_dir) -> DataFrame:
    rows = event_spans(spark, sf_dir)
    return rows.select("media_id", F.col("seq").alias("frame_no"), "start_s", (F.col("value") / 5.0 - 60.0).alias("level_db"))


@query(f"""WITH {EVENT_SPANS}, l AS (SELECT media_id, value / 5.0::DOUBLE - 60.0::DOUBLE AS x FROM event_spans),
p AS (SELECT media_id, quantile_cont(x, 0.2) AS lo, quantile_cont(x, 0.85) AS hi, count(*) AS n FROM l GROUP BY media_id)
SELECT media_id, CAST(CAST(round_even(greatest(-42.0, least(-28.0, lo + greatest(6.0, least(14.0, greatest(0.0, hi - lo) * 0.35::DOUBLE)))), 0) AS INTEGER) AS VARCHAR) || 'dB' AS threshold_db,
  CAST(floor(lo * 100 + 0.5) AS BIGINT) AS floor_cdb, n AS analyzed_frame_count FROM p""")
def media_thresholds(spark, sf_dir):
    found = audio.silence_threshold(_levels(spark, sf_dir))
    return found.select("media_id", "threshold_db", F.floor(F.col("noise_floor_db") * 100 + 0.5).cast("long").alias("floor_cdb"), "analyzed_frame_count")


@query(f"""WITH {EVENT_SPANS}, f AS (SELECT media_id, start_s AS at, value / 5.0::DOUBLE - 60.0::DOUBLE AS x FROM event_spans)
SELECT c.media_id, c.seq, count(x) AS frame_count, CAST(floor(coalesce(max(x), -120.0::DOUBLE) * 100 + 0.5) AS BIGINT) AS max_cdb
FROM event_spans c LEFT JOIN f ON c.media_id = f.media_id AND f.at >= c.start_s AND f.at < c.end_s WHERE event_type <> 'error' GROUP BY c.media_id, c.seq""")
def cue_audio(spark, sf_dir):
    rows = event_spans(spark, sf_dir).where("event_type <> 'error'")
    found = audio.audio_stats_from_levels(rows, _levels(spark, sf_dir), 0.05)
    return found.select("media_id", "seq", F.col("audio.frame_count").cast("long").alias("frame_count"), F.floor(F.col("audio.max_db") * 100 + 0.5).cast("long").alias("max_cdb"))


_STATS = """ranked AS (SELECT media_id, seq, k, x, median(x) OVER w AS med, count(*) OVER w AS n FROM frames WINDOW w AS (PARTITION BY media_id, seq)),
loud AS (SELECT *, x > med + 8.0::DOUBLE AS active FROM ranked),
islands AS (SELECT media_id, seq, count(*) AS size FROM (SELECT *, k - row_number() OVER (PARTITION BY media_id, seq ORDER BY k) AS run FROM loud WHERE active) GROUP BY media_id, seq, run),
best AS (SELECT media_id, seq, max(size) AS island FROM islands GROUP BY media_id, seq),
stats AS (SELECT media_id, seq, any_value(n) AS n, any_value(med) AS med, max(x) AS top, list_sort(list(x))[least(any_value(n), CAST(floor(any_value(n) * 0.9::DOUBLE) AS BIGINT) + 1)] AS p90,
  count(*) FILTER (WHERE active) AS actives, coalesce(min(k) FILTER (WHERE active), any_value(n)) AS lead FROM loud GROUP BY media_id, seq)"""
_CENTI = lambda c: f"CAST(floor(round_even({c}, 3) * 100 + 0.5) AS BIGINT)"
_STAT_COLUMNS = lambda frame_s: f"""coalesce(n, 0) AS frame_count, {_CENTI('coalesce(med, -120.0::DOUBLE)')} AS median_cdb, {_CENTI('coalesce(top, -120.0::DOUBLE)')} AS max_cdb, {_CENTI('coalesce(p90, -120.0::DOUBLE)')} AS p90_cdb,
{_CENTI('coalesce(actives::DOUBLE / n::DOUBLE, 0.0::DOUBLE)')} AS speech_percent, {_CENTI(f'coalesce(island, 0) * {frame_s}::DOUBLE')} AS island_cs, {_CENTI(f'coalesce(lead, 0) * {frame_s}::DOUBLE')} AS leading_cs"""  # noqa: E731


def _stat_columns(found: DataFrame) -> DataFrame:
    centi = lambda field: F.floor(F.col(f"audio.{field}") * 100 + 0.5).cast("long")
    named = {"median_db": "median_cdb", "max_db": "max_cdb", "p90_db": "p90_cdb", "speech_ratio": "speech_percent", "longest_island_s": "island_cs", "leading_quiet_s": "leading_cs"}
    return found.select("media_id", "seq", F.col("audio.frame_count").cast("long").alias("frame_count"), *[centi(field).alias(name) for field, name in named.items()])


@query(f"""WITH {EVENT_SPANS}, f AS (SELECT media_id, seq AS frame_no, start_s AS t, value / 5.0::DOUBLE - 60.0::DOUBLE AS x FROM event_spans),
frames AS (SELECT c.media_id, c.seq, row_number() OVER (PARTITION BY c.media_id, c.seq ORDER BY t, frame_no) - 1 AS k, x FROM event_spans c JOIN f ON c.media_id = f.media_id AND f.t >= c.start_s AND f.t < c.end_s WHERE event_type <> 'error'), {_STATS}
SELECT c.media_id, c.seq, {_STAT_COLUMNS(0.05)} FROM event_spans c LEFT JOIN stats USING (media_id, seq) LEFT JOIN best USING (media_id, seq) WHERE event_type <> 'error'""")
def cue_audio_statistics(spark, sf_dir):
    """All statistics of the levels under each cue."""
    rows = event_spans(spark, sf_dir).where("event_type <> 'error'")
    return _stat_columns(audio.audio_stats_from_levels(rows, _levels(spark, sf_dir), 0.05))


def _blocks(spark, sf_dir) -> DataFrame:
    """Events of a user as samples, ten a second, in blocks of 16."""
    rows = event_spans(spark, sf_dir).select("media_id", (F.col("seq") - 1).alias("i"), F.least(F.lit(32767), F.floor(F.col("value") * 100)).cast("short").alias("x"))
    lists = rows.groupBy("media_id", F.floor(F.col("i") / 16).alias("block_no")).agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("s"))
    return lists.select("media_id", "block_no", F.lit(10).alias("sample_rate"), (F.col("block_no") * 16).alias("first_sample"), F.transform("s", lambda x: x["x"]).alias("samples"))


_SAMPLES = "samples AS (SELECT media_id, seq - 1 AS i, least(32767, CAST(floor(value * 100) AS BIGINT)) AS s FROM event_spans), totals AS (SELECT media_id, count(*) AS total FROM samples GROUP BY media_id)"


def _sample_cues(spark, sf_dir) -> DataFrame:
    at = (F.col("seq") - 1) / 10.0
    return event_spans(spark, sf_dir).select("media_id", "seq", at.alias("start_s"), (at + F.col("seq") % 29 / 4.0).alias("end_s"))


_SAMPLE_CUES = "sample_cues AS (SELECT media_id, seq, (seq - 1)::DOUBLE / 10.0::DOUBLE AS start_s, (seq - 1)::DOUBLE / 10.0::DOUBLE + (seq % 29)::DOUBLE / 4.0::DOUBLE AS end_s FROM event_spans)"


@query(f"""WITH {EVENT_SPANS}, {_SAMPLES}, {_SAMPLE_CUES},
asked AS (SELECT media_id, seq, CAST(floor(start_s * 10) AS BIGINT) AS first, least(CAST(floor(start_s * 10) AS BIGINT) + greatest(1, CAST(floor((end_s - start_s) * 10) AS BIGINT)), total) AS stop FROM sample_cues JOIN totals USING (media_id) WHERE end_s > start_s),
frames AS (SELECT a.media_id, a.seq, (i - first) // 3 AS k, 20 * log10(greatest(sqrt(sum(s * s)::DOUBLE / count(*)::DOUBLE), 1.0::DOUBLE) / 32768.0::DOUBLE) AS x FROM asked a JOIN samples m ON m.media_id = a.media_id AND i >= first AND i < stop GROUP BY ALL), {_STATS}
SELECT media_id, seq, {_STAT_COLUMNS(0.3)} FROM sample_cues LEFT JOIN stats USING (media_id, seq) LEFT JOIN best USING (media_id, seq)""")
def sample_statistics(spark, sf_dir):
    """The same statistics out of samples: frames count from each cue's start and cross blocks."""
    return _stat_columns(audio.audio_stats(_sample_cues(spark, sf_dir), _blocks(spark, sf_dir), 0.3))


@query(f"""WITH {EVENT_SPANS}, {_SAMPLES}, {_SAMPLE_CUES},
asked AS (SELECT media_id, seq, CAST(floor(start_s * 10) AS BIGINT) AS first, least(CAST(floor(least(end_s, start_s + 2.0::DOUBLE) * 10) AS BIGINT), total) AS stop FROM sample_cues JOIN totals USING (media_id)),
frames AS (SELECT a.media_id, a.seq, (i - first) // 2 AS k, sum(s * s)::DOUBLE / count(*)::DOUBLE AS square FROM asked a JOIN samples m ON m.media_id = a.media_id AND i >= first AND i < stop GROUP BY ALL),
loud AS (SELECT *, 20 * log10(sqrt(square) / 32768.0::DOUBLE) >= -22.0::DOUBLE AS up FROM frames WHERE square > 0),
onset AS (SELECT x.media_id, x.seq, min(x.k) AS k FROM loud x JOIN loud y ON x.media_id = y.media_id AND x.seq = y.seq AND y.k = x.k + 1 AND x.up AND y.up GROUP BY ALL),
moved AS (SELECT c.*, greatest(start_s, least(greatest(start_s, floor(start_s * 10) / 10 + k * 2 / 10.0::DOUBLE) - 0.1::DOUBLE, end_s)) AS late FROM sample_cues c LEFT JOIN onset USING (media_id, seq))
SELECT media_id, seq, {_ms('CASE WHEN late > start_s AND late < end_s THEN late ELSE start_s END')} AS start_ms, {_ms('end_s')} AS end_ms FROM moved""")
def refined_starts(spark, sf_dir):
    """Starts moved up to where two loud frames follow one another."""
    moved, _ = audio.refine_span_starts(_sample_cues(spark, sf_dir), _blocks(spark, sf_dir), -25.0, 3.0, 0.1, 0.2, 2, 2.0)
    return timed(moved)


@query(f"""WITH {EVENT_SPANS}, l AS (SELECT media_id, seq, value / 5.0::DOUBLE - 60.0::DOUBLE >= -50.0::DOUBLE AS loud FROM event_spans),
r AS (SELECT media_id, count(*) AS size FROM (SELECT *, seq - row_number() OVER (PARTITION BY media_id ORDER BY seq) AS run FROM l WHERE loud) GROUP BY media_id, run)
SELECT media_id, frames, loud_frames, coalesce(longest, 0) AS longest_run, coalesce(runs, 0) AS runs FROM (SELECT media_id, count(*) AS frames, count(*) FILTER (WHERE loud) AS loud_frames FROM l GROUP BY media_id)
  LEFT JOIN (SELECT media_id, max(size) AS longest, count(*) AS runs FROM r GROUP BY media_id) USING (media_id)""")
def loud_runs(spark, sf_dir):
    """Runs of loud frames of each media, and the longest, out of states of blocks."""
    levels = _levels(spark, sf_dir)
    runs = audio.active_runs(levels, -50.0).groupBy("media_id").agg(F.count("*").alias("runs"))
    return audio.longest_runs(levels, -50.0).join(runs, "media_id", "left").na.fill(0, ["runs"])


def _slowed(cues_: DataFrame) -> DataFrame:
    """Cues with the texts of every other turn cut down to twelve characters, so that some are slow."""
    return cues_.withColumn("text", F.when(F.col("seq") % 2 == 1, F.substring("text", 1, 12)).otherwise(F.col("text")))


@query(f"""WITH {CONVERSATION_CUES}, slowed AS (SELECT media_id, seq, start_s, end_s, CASE WHEN seq % 2 = 1 THEN substring(text, 1, 12) ELSE text END AS text FROM conversation_cues),
f AS (SELECT *, end_s - start_s AS d, length({_NORM}) AS n, {_BARE} AS bare, length(text) AS size,
  (-10 - (length(text) + 7 * media_id) % 50)::DOUBLE AS top, (-10 - (length(text) + 7 * media_id) % 50 - seq % 20)::DOUBLE AS p90, (length(text) % 10)::DOUBLE / 20.0::DOUBLE AS ratio, (seq % 5)::DOUBLE / 4.0::DOUBLE AS island, (length(text) % 4)::DOUBLE / 3.0::DOUBLE AS lead FROM slowed),
g AS (SELECT media_id, row_number() OVER (PARTITION BY media_id ORDER BY seq) AS idx, list_filter([CASE WHEN d < 0.3::DOUBLE THEN 'near_zero_duration' END, CASE WHEN bare THEN 'punctuation_only' END, CASE WHEN d >= 8.0 AND n <= 30 THEN 'long_duration_short_text' END,
  CASE WHEN d >= 12.0 AND n >= 25 THEN 'long_subtitle_split_candidate' END, CASE WHEN d >= 8.0 AND n::DOUBLE / d < 2.0 THEN 'low_chars_per_second' END, CASE WHEN d <= 3.0 AND top < -45.0 THEN 'flat_audio' END,
  CASE WHEN d >= 8.0 AND top < -22.0 AND p90 < -30.0 THEN 'weak_audio_peak' END, CASE WHEN d >= 8.0 AND top >= -22.0 AND p90 >= -30.0 THEN 'strong_audio' END, CASE WHEN d >= 8.0 AND ratio < 0.18::DOUBLE AND island < 0.8::DOUBLE THEN 'low_speech_density' END,
  CASE WHEN d >= 8.0 AND island < 0.8::DOUBLE THEN 'fragmented_energy' END, CASE WHEN d >= 1.5 AND d < 8.0 AND lead >= 0.7::DOUBLE THEN 'early_start_candidate' END], lambda x: x IS NOT NULL) AS flags FROM f),
h AS (SELECT *, list_contains(flags, 'low_chars_per_second') AS slow, list_contains(flags, 'strong_audio') AS strong, list_contains(flags, 'fragmented_energy') AS broken FROM g WHERE len(flags) > 0)
SELECT media_id, idx, array_to_string(flags, ',') AS flags, CASE WHEN list_contains(flags, 'punctuation_only') OR list_contains(flags, 'near_zero_duration') THEN 'drop'
  WHEN slow AND (list_contains(flags, 'flat_audio') OR list_contains(flags, 'weak_audio_peak') OR (broken AND NOT strong)) THEN 'drop_candidate' WHEN slow AND strong AND broken THEN 'resegment_candidate'
  WHEN list_contains(flags, 'long_subtitle_split_candidate') THEN 'split_candidate' WHEN list_contains(flags, 'early_start_candidate') THEN 'refine_start_candidate' ELSE 'review' END AS recommended_action FROM h""")
def audio_issues(spark, sf_dir):
    """Flags and actions where text and audio speak together."""
    rows = _slowed(conversation_cues(spark, sf_dir))
    size, seq = F.length("text"), F.col("seq")
    loudest = (-10 - (size + 7 * F.col("media_id")) % 50).cast("double")
    stats = F.struct(loudest.alias("max_db"), (loudest - seq % 20).alias("p90_db"), (size % 10 / 20.0).alias("speech_ratio"), (seq % 5 / 4.0).alias("longest_island_s"), (size % 4 / 3.0).alias("leading_quiet_s"))
    number = F.row_number().over(Window.partitionBy("media_id").orderBy("seq")).cast("long")
    found = quality.quality_issues(rows, rows.select("media_id", number.alias("seq"), stats.alias("audio")))
    return found.select("media_id", "idx", F.array_join("flags", ",").alias("flags"), "recommended_action")


# ---- translation ---------------------------------------------------------------------------------------------------


@query("""WITH b AS (SELECT doc_id AS media_id, k AS seq, t AS text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(len(string_split(text, chr(10))))) AS k FROM documents)),
n AS (SELECT *, (row_number() OVER (PARTITION BY media_id ORDER BY seq) - 1) AS place FROM b)
SELECT media_id, CAST(place // 5 AS INTEGER) AS batch_no, string_agg('[' || (place % 5 + 1) || '] ' || text, chr(10) ORDER BY place) AS request FROM n GROUP BY media_id, place // 5""")
def translation_requests(spark, sf_dir):
    return translate.batch_requests(translate.pack_batches(line_cues(spark, sf_dir), 5))


@query(f"""WITH RECURSIVE {LINE_CUES}, r AS (SELECT media_id, row_number() OVER (PARTITION BY media_id ORDER BY seq) AS n, length(text) + 1 AS c FROM line_cues),
w(media_id, n, batch, size, used) AS (SELECT media_id, n, 0, 1, c FROM r WHERE n = 1 UNION ALL
  SELECT r.media_id, r.n, CASE WHEN w.size >= 10 OR w.used + r.c >= 600 THEN batch + 1 ELSE batch END, CASE WHEN w.size >= 10 OR w.used + r.c >= 600 THEN 1 ELSE size + 1 END,
    CASE WHEN w.size >= 10 OR w.used + r.c >= 600 THEN r.c ELSE w.used + r.c END FROM w JOIN r ON r.media_id = w.media_id AND r.n = w.n + 1)
SELECT media_id, CAST(batch AS INTEGER) AS batch_no, count(*) AS entries FROM w GROUP BY media_id, batch""")
def sized_batches(spark, sf_dir):
    packed = translate.pack_batches(line_cues(spark, sf_dir), 10, 600)
    return packed.groupBy("media_id", "batch_no").agg(F.count("*").alias("entries"))


@query("""WITH t AS (SELECT conv_id AS media_id, turn AS seq, text, turn % 5 <> 4 AS answered FROM conversations)
SELECT media_id, count(*) AS subtitle_count, count(*) FILTER (WHERE NOT answered) AS missing_count FROM t GROUP BY media_id""")
def reply_gaps(spark, sf_dir):
    """Numbered replies in which every fifth entry was left out, parsed and merged."""
    entries = conversation_cues(spark, sf_dir)
    batched = translate.pack_batches(entries, 50)
    answered = batched.where("seq % 5 <> 4").withColumn("text", F.regexp_replace("text", "\\s+", " "))
    replies = translate.batch_requests(answered).withColumnRenamed("request", "reply")
    merged = translate.merge_replies(entries, translate.parse_replies(replies, batched))
    return translate.translation_metadata(merged, 50, "external").select("media_id", "subtitle_count", "missing_count")


# ---- history and jobs ----------------------------------------------------------------------------------------------

_MICRO = lambda c: f"CAST(floor(({c}) * 1000000 + 0.5) AS BIGINT)"


@query(f"""WITH s AS (SELECT l_returnflag AS asr_backend, l_quantity / l_extendedprice AS r FROM lineitem)
SELECT asr_backend, count(r) AS samples, {_MICRO('median(r)')} AS median, {_MICRO('quantile_cont(r, 0.75)')} AS p75, {_MICRO('min(r)')} AS fastest, {_MICRO('max(r)')} AS slowest FROM s GROUP BY asr_backend""")
def run_summary(spark, sf_dir):
    found = history.history_summary(history.transcription_samples(run_history(spark, sf_dir)), by=["asr_backend"])
    return found.select("asr_backend", "samples", *[F.floor(F.col(c) * 1000000 + 0.5).cast("long").alias(c) for c in ("median", "p75", "fastest", "slowest")])


@query(f"""WITH s AS (SELECT l_returnflag AS asr_backend, l_quantity / l_extendedprice AS r, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC) AS n FROM lineitem)
SELECT asr_backend, {_MICRO('avg(r)')} AS recent_average, count(*) AS samples FROM s WHERE n <= 10 GROUP BY asr_backend""")
def recent_speed(spark, sf_dir):
    found = history.recent_average(history.history_ratios(run_history(spark, sf_dir), None), "ratio", by=["asr_backend"])
    return found.select("asr_backend", F.floor(F.col("recent_average") * 1000000 + 0.5).cast("long").alias("recent_average"), "samples")


@query("""SELECT l_suppkey AS folder, CAST(round(sum(l_quantity)) AS BIGINT) AS processing_seconds, CAST(floor(sum(l_extendedprice) + 0.5) AS BIGINT) AS media_duration_seconds FROM lineitem GROUP BY l_suppkey""")
def folder_work(spark, sf_dir):
    found = history.folder_totals(run_history(spark, sf_dir), ["processing_seconds", "media_duration_seconds"])
    return found.select("folder", *[F.floor(F.col(c) + 0.5).cast("long").alias(c) for c in ("processing_seconds", "media_duration_seconds")])


@query(f"""WITH {CONVERSATION_CUES}, m AS (SELECT conv_id AS media_id, 400.0::DOUBLE + (conv_id % 5)::DOUBLE * 20.0::DOUBLE AS duration_s FROM (SELECT DISTINCT conv_id FROM conversations)),
l AS (SELECT media_id, arg_max(end_s, seq) AS e FROM conversation_cues GROUP BY media_id)
SELECT media_id, {_ms('e')} AS last_end_ms, CASE WHEN e / duration_s < 0.7::DOUBLE AND duration_s - e > 300.0 THEN 'suspicious_incomplete' ELSE 'success' END AS status FROM m JOIN l USING (media_id)""")
def coverage(spark, sf_dir):
    rows = conversation_cues(spark, sf_dir)
    media = rows.select("media_id").distinct().withColumn("duration_s", F.lit(400.0) + (F.col("media_id") % 5).cast("double") * 20.0)
    return jobs.coverage_status(rows, media).select("media_id", ms("last_end_s").alias("last_end_ms"), "status")


@query("""SELECT '/in/' || lang || '/' || doc_id || '.mp4' AS media_path, '/in/' || lang || '/' || doc_id || '.ja.srt' AS subtitle_path FROM documents
WHERE doc_id % 2 = 0 AND doc_id % 6 <> 0 AND doc_id % 10 <> 0""")
def pending_work(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    base = F.concat_ws("/", F.lit("/in"), "lang", "doc_id")
    media = docs.select(F.concat(base, F.lit(".mp4")).alias("path"))
    found = docs.where("doc_id % 2 = 0").select(F.concat(base, F.lit(".ja.srt")).alias("path"))
    done = docs.where("doc_id % 6 = 0 or doc_id % 10 = 0").select(F.concat(base, F.when(F.col("doc_id") % 6 == 0, ".ko.srt").otherwise(".srt")).alias("path"))
    return jobs.pending_translations(jobs.subtitles_for_media(media, found, same_folder=True), done)


@query("""WITH o AS (SELECT user_id || '/' || event_type || '.mp4' AS path, CAST(floor(value / 20) AS BIGINT) AS size, ts, event_id FROM events),
w AS (SELECT *, min(size) OVER z AS lo, max(size) OVER z AS hi, count(*) OVER z AS n FROM o WINDOW z AS (PARTITION BY path ORDER BY ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))
SELECT path, arg_min(size, ts) AS size FROM w WHERE lo = hi AND n = 3 AND size > 0 GROUP BY path""")
def stable_uploads(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    seen = rows.select(F.concat_ws("/", "user_id", F.concat("event_type", F.lit(".mp4"))).alias("path"), F.floor(F.col("value") / 20).cast("long").alias("size"), F.lit("2020-01-01").cast("timestamp").alias("mtime"), F.col("ts").cast("timestamp").alias("observed_at"))
    return watch.stable_files(seen, checks=2, min_age_s=10.0).select("path", "size")


@query("""SELECT user_id || '' AS name, count(*) AS attempts, count(*) > 60 AS failed FROM events GROUP BY user_id""")
def attempts(spark, sf_dir):
    return watch.attempt_counts(table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("name")), 60)


@query("""SELECT user_id AS job_id, arg_max(event_type, (ts, event_id)) AS stage, CAST(arg_max(floor(value), (ts, event_id)) AS BIGINT) AS current FROM events GROUP BY user_id""")
def progress(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), F.col("event_type").alias("stage"), F.lit("").alias("message"), F.floor("value").cast("long").alias("current"), F.lit(500).alias("total"), F.lit(0.0).alias("elapsed_seconds"), F.struct("ts", "event_id").alias("updated_at"))
    return watch.latest_progress(rows).select("job_id", "stage", "current")


@query("""SELECT media_id, segment_no, seq, start_ms, end_ms, text FROM (SELECT conv_id AS media_id, 0 AS segment_no, turn + 1 AS seq, turn * 1000 AS start_ms, turn * 1000 + 500 AS end_ms, text FROM conversations)""")
def raw_results(spark, sf_dir):
    """Recogniser output as JSON, taken apart again."""
    chunk = F.struct(F.array(F.col("turn").cast("double"), F.col("turn") + 0.5).alias("timestamp"), "text")
    raw = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", chunk.alias("c")))).alias("l"))
    raw = raw.select(F.col("conv_id").alias("media_id"), F.lit(0).alias("segment_no"), F.to_json(F.struct(F.transform("l", lambda x: x["c"]).alias("chunks"))).alias("raw"))
    found = recognition.explode_raw_chunks(raw)
    return found.select("media_id", "segment_no", "seq", ms("start_s").alias("start_ms"), ms("end_s").alias("end_ms"), "text")


def _listed(spark, sf_dir, item: Column) -> DataFrame:
    """Turns of each conversation as a JSON list, and all of its text."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", item.alias("item"))
    lists = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "item", "text"))).alias("l"))
    joined = F.concat(F.lit("["), F.array_join(F.transform("l", lambda x: x["item"]), ","), F.lit("]"))
    kept = F.col("conv_id") % 5 != 0  # one in five has no list, so its text stands for all
    return lists.select(F.col("conv_id").alias("media_id"), F.when(kept, joined).alias("items"), F.array_join(F.transform("l", lambda x: x["text"]), " ").alias("text"), F.lit(7.5).alias("duration_s"))


_WHOLE_TEXT = lambda length: f"SELECT conv_id AS media_id, 1 AS seq, 0 AS start_ms, {length} AS end_ms, trim(string_agg(text, ' ' ORDER BY turn), ' ' || chr(10)) AS text FROM conversations WHERE conv_id % 5 = 0 GROUP BY conv_id"


@query(f"""WITH i AS (SELECT conv_id AS media_id, turn, text, turn * 1000 AS a, CASE turn % 4 WHEN 2 THEN turn * 1000 ELSE turn * 1000 + 250 END AS b FROM conversations WHERE conv_id % 5 <> 0 AND turn % 7 <> 3)
SELECT media_id, row_number() OVER (PARTITION BY media_id ORDER BY turn) AS seq, a AS start_ms, CASE WHEN b <= a THEN a + 10 ELSE b END AS end_ms, text FROM i UNION ALL {_WHOLE_TEXT(7500)}""")
def word_results(spark, sf_dir):
    """Words in four shapes, some without a readable time; conversations without words fall back to their text."""
    turn, text = F.col("turn"), F.col("text")
    a, b = turn * 1.0, turn + 0.25
    shape = lambda n, value: F.when((turn % 4 == n) & (turn % 7 != 3), value)
    named = F.struct(
        F.when((turn % 4 == 0) | (turn % 7 == 3), text).alias("text"), shape(1, text).alias("word"), shape(2, text).alias("unit"), shape(0, a).alias("start_time"), shape(0, b).alias("end_time"),
        F.when(turn % 7 == 3, F.lit("soon")).otherwise(shape(1, a.cast("string"))).alias("start"), F.when(turn % 7 == 3, F.lit("later")).otherwise(shape(1, b.cast("string"))).alias("end"), shape(2, F.array(a, a)).alias("timestamp"),
    )
    triple = F.to_json(F.array(text, a.cast("string"), b.cast("string")))
    return timed(recognition.adapt_word_timestamps(_listed(spark, sf_dir, F.when((turn % 4 == 3) & (turn % 7 != 3), triple).otherwise(F.to_json(named)))), "text")


@query(f"""WITH i AS (SELECT conv_id AS media_id, turn, trim(text, ' ' || chr(10)) AS text, turn * 1000 AS a, turn * 1000 + 500 AS b FROM conversations WHERE conv_id % 5 <> 0 AND turn % 3 <> 1)
SELECT media_id, row_number() OVER (PARTITION BY media_id ORDER BY turn) AS seq, a AS start_ms, b AS end_ms, text FROM i WHERE text <> '' UNION ALL {_WHOLE_TEXT(7500)}""")
def segment_results(spark, sf_dir):
    """Segments by start and end or by timestamp, blank ones left out."""
    turn = F.col("turn")
    text = F.when(turn % 3 == 1, F.lit("  ")).otherwise(F.concat(F.lit(" "), "text"))
    item = F.struct(text.alias("text"), F.when(turn % 2 == 0, turn * 1.0).alias("start"), F.when(turn % 2 == 0, turn + 0.5).alias("end"), F.when(turn % 2 == 1, F.array(turn * 1.0, turn + 0.5)).alias("timestamp"))
    listed = _listed(spark, sf_dir, F.to_json(item))
    even = F.col("media_id") % 2 == 0  # odd ones come as chunks
    found = recognition.adapt_segments(listed.select("media_id", "text", "duration_s", F.when(even, F.col("items")).alias("segments"), F.when(~even, F.col("items")).alias("chunks")))
    return timed(found, "text")


@query(f"""WITH i AS (SELECT conv_id AS media_id, turn, trim(text, ' ' || chr(10)) AS text, CASE WHEN turn % 2 = 0 THEN turn * 1000 ELSE 0 END AS a, turn * 1000 + 500 AS b FROM conversations WHERE conv_id % 5 <> 0)
SELECT media_id, row_number() OVER (PARTITION BY media_id ORDER BY turn) AS seq, a AS start_ms, b AS end_ms, text FROM i WHERE text <> '' UNION ALL {_WHOLE_TEXT(10)}""")
def plain_results(spark, sf_dir):
    """Segments with some starts missing."""
    turn = F.col("turn")
    listed = _listed(spark, sf_dir, F.to_json(F.struct("text", F.when(turn % 2 == 0, turn * 1.0).alias("start"), (turn + 0.5).alias("end"))))
    return timed(recognition.adapt_plain_segments(listed.withColumnRenamed("items", "segments")), "text")


@query("""SELECT conv_id AS media_id, turn AS segment_no, 1 AS seq, turn * 1000 AS start_ms, CASE turn % 3 WHEN 1 THEN turn * 1000 ELSE turn * 1000 + 500 END AS end_ms, text FROM conversations WHERE turn % 5 <> 4""")
def stamped_results(spark, sf_dir):
    """Results of a speaker each, with time stamps as lists, as maps, with an open end, and unreadable."""
    turn = F.col("turn")
    pair = F.when(turn % 3 == 0, F.array(turn * 1.0, turn + 0.5)).when(turn % 3 == 1, F.array(turn * 1.0, F.lit(None).cast("double")))
    chunk = F.struct(F.when(turn % 5 != 4, pair).alias("timestamp"), F.when((turn % 3 == 2) & (turn % 5 != 4), F.struct((turn * 1.0).alias("start"), (turn + 0.5).alias("end"))).alias("timestamps"), F.col("text"))
    raw = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("media_id"), turn.alias("segment_no"), F.to_json(F.struct(F.lit(1).alias("version"), F.array(chunk).alias("chunks/SPEAKER_00"))).alias("raw"))
    found = recognition.explode_raw_chunks(raw).where("valid")
    return found.select("media_id", F.col("segment_no").cast("long").alias("segment_no"), "seq", ms("start_s").alias("start_ms"), ms("end_s").alias("end_ms"), "text")


@query(f"""WITH {CONVERSATION_CUES}, i AS (SELECT *, CAST(round_even(greatest(start_s, 0.0) * 1000, 0) AS BIGINT) AS ms_a FROM conversation_cues) SELECT media_id, seq, {_TIME('a')} AS code, ms_a AS back_ms FROM i""")
def time_codes(spark, sf_dir):
    rows = conversation_cues(spark, sf_dir).withColumn("code", timing.format_srt_time(F.col("start_s")))
    return rows.select("media_id", "seq", "code", ms(timing.parse_srt_time(F.col("code"))).alias("back_ms"))


# ---- further operators ---------------------------------------------------------------------------------------------


@query("""WITH l AS (SELECT user_id AS media_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, event_type FROM events),
e AS (SELECT *, lag(event_type) OVER (PARTITION BY media_id ORDER BY n) AS before, lag(n) OVER (PARTITION BY media_id ORDER BY n) AS from_n FROM l WHERE event_type IN ('click', 'view'))
SELECT media_id, row_number() OVER (PARTITION BY media_id ORDER BY n) AS seq, from_n * 1000 AS start_ms, n * 1000 + 500 AS end_ms FROM e WHERE event_type = 'view' AND before = 'click'""")
def silence_log(spark, sf_dir):
    """Log lines of silences, most of them unpaired or of something else."""
    rows = event_spans(spark, sf_dir)
    n = F.col("seq").cast("string")
    line = F.when(F.col("event_type") == "click", F.concat(F.lit("[x @ 0] silence_start: "), n)).when(F.col("event_type") == "view", F.concat(F.lit("[x @ 0] silence_end: "), n, F.lit(".5 | silence_duration: 1"))).otherwise("frame")
    return timed(spans.parse_silence_log(rows.select("media_id", F.col("seq").alias("line_no"), line.alias("line"))))


@query("""SELECT conv_id AS media_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS seq, (turn % 3) * 1500 + (turn // 3) * 10000 AS start_ms,
  CASE WHEN turn % 3 = 2 THEN (turn % 3) * 1500 ELSE (turn % 3) * 1500 + 1000 END + (turn // 3) * 10000 AS end_ms, text FROM conversations""")
def joined_segments(spark, sf_dir):
    """Chunks of segments moved to the starts of their spans and put in one list; the third of each has no end."""
    rows = table(spark, sf_dir, "conversations").withColumn("segment_no", F.floor(F.col("turn") / 3))
    at = (F.col("turn") % 3) * 1.5
    chunks = rows.select(F.col("conv_id").alias("media_id"), "segment_no", (F.col("turn") % 3).alias("seq"), at.alias("start_s"), F.when(F.col("turn") % 3 != 2, at + 1.0).alias("end_s"), "text")
    starts = chunks.select("media_id", "segment_no", (F.col("segment_no") * 10.0).alias("start_s")).distinct()
    return timed(cues.concat_segments(cues.offset_chunks(chunks, starts)), "text")


@query(f"""WITH {LINE_CUES}, {_FLAGS}, gone AS (SELECT media_id, idx FROM flagged JOIN f ON flagged.media_id = f.media_id AND flagged.idx = f.seq + 1 WHERE list_contains(flags, 'punctuation_only') OR (list_contains(flags, 'near_zero_duration') AND n >= 5))
SELECT media_id, count(*) AS dropped, min(idx) AS first_idx FROM gone GROUP BY media_id""".replace("SELECT media_id, idx FROM flagged", "SELECT flagged.media_id, idx FROM flagged"))
def dropped_lines(spark, sf_dir):
    _, dropped = quality.split_hallucinations(line_cues(spark, sf_dir).withColumn("seq", F.col("seq") + 1))
    return dropped.groupBy("media_id").agg(F.count("*").alias("dropped"), F.min("idx").alias("first_idx"))


@query(f"""WITH {LINE_CUES}, {_FLAGS} SELECT l.media_id, l.seq + 1 AS seq, l.text || coalesce(chr(10) || '[quality: ' || action || '; ' || array_to_string(flags, ', ') || ']', '') AS text
FROM line_cues l LEFT JOIN issues i ON l.media_id = i.media_id AND l.seq + 1 = i.idx""")
def annotated_lines(spark, sf_dir):
    rows = line_cues(spark, sf_dir).withColumn("seq", F.col("seq") + 1)
    return quality.annotate_cues(rows, quality.quality_issues(rows)).select("media_id", "seq", "text")


@query(f"""WITH {CONVERSATION_CUES}, t AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY seq) AS n,
  CAST(round_even(start_s * 1000, 0) AS BIGINT) AS ms_a, CAST(round_even(end_s * 1000, 0) AS BIGINT) AS ms_b FROM conversation_cues)
SELECT media_id, n AS seq, {_TIME('a')} || ' --> ' || {_TIME('b')} AS timecode,
  array_to_string(list_transform(string_split(trim(text), chr(10)), lambda x: trim(x)), ' ') AS text, count(*) OVER (PARTITION BY media_id) AS blocks FROM t""")
def strict_entries(spark, sf_dir):
    """Entries of written subtitles with their time codes as they are, and the number of blocks of their text."""
    texts = subtitles.render_srt(conversation_cues(spark, sf_dir))
    counts = texts.select("media_id", subtitles.count_srt_blocks(F.col("body")).cast("long").alias("blocks"))
    return subtitles.parse_srt_entries(texts).join(counts, "media_id")


@query("""SELECT conv_id AS media_id, string_agg((turn + 1) || chr(10) || turn || ' --> ' || (turn + 1) || chr(10) || trim(text), chr(10) || chr(10) ORDER BY turn) || chr(10) AS body FROM conversations GROUP BY conv_id""")
def translated_texts(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("media_id"), F.col("turn").alias("seq"), F.concat(F.col("turn").cast("string"), F.lit(" --> "), (F.col("turn") + 1).cast("string")).alias("timecode"), F.concat(F.lit("[7] [12] "), "text").alias("translation"))
    return subtitles.render_translated_srt(rows)


@query("""SELECT conv_id AS media_id, turn AS seq, CAST(floor(20 * log10(sqrt((2.0 * length(text) * length(text) + turn * turn) / 3) / 32768) * 1000 + 0.5) AS BIGINT) AS level FROM conversations WHERE length(text) > 0""")
def sample_levels(spark, sf_dir):
    n = F.length("text")
    rows = table(spark, sf_dir, "conversations").where(n > 0)
    return rows.select(F.col("conv_id").alias("media_id"), F.col("turn").alias("seq"), F.floor(timing.dbfs(F.array(n.cast("int"), -n.cast("int"), F.col("turn").cast("int"))) * 1000 + 0.5).cast("long").alias("level"))


@query("""WITH s AS (SELECT avg(l_quantity / l_extendedprice) AS mean, median(l_quantity / l_extendedprice) AS mid, max(l_quantity / l_extendedprice) AS slow FROM lineitem)
SELECT doc_id AS media_id, CAST(floor(n_chars * mean * 1000 + 0.5) AS BIGINT) AS average_ms, CAST(floor(n_chars * mid * 1000 + 0.5) AS BIGINT) AS median_ms, CAST(floor(n_chars * slow * 1000 + 0.5) AS BIGINT) AS slowest_ms FROM documents, s""")
def work_estimates(spark, sf_dir):
    """What recognising each document's length of media would take by the statistics of earlier runs."""
    summary = history.history_summary(history.transcription_samples(run_history(spark, sf_dir)))
    targets = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("media_id"), F.col("n_chars").cast("double").alias("work"))
    found = history.work_estimate(targets, summary, "work")
    return found.select("media_id", *[F.floor(F.col(f"{c}_based_s") * 1000 + 0.5).cast("long").alias(f"{c}_ms") for c in ("average", "median", "slowest")])


@query("""SELECT CASE WHEN l_linestatus = 'O' AND l_linenumber % 2 = 0 THEN 'deleted' WHEN l_linestatus = 'O' THEN 'archive' ELSE 'failed' END AS disposition, count(*) AS files FROM lineitem GROUP BY 1""")
def dispositions(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    status = F.when(F.col("l_linestatus") == "O", "success").otherwise("suspicious_incomplete")
    return jobs.outcome_rollup(rows.select(jobs.disposition(status, F.col("l_linenumber") % 2 == 0).alias("disposition")), "disposition")


@query("""SELECT user_id || '/' || event_type AS path, min(event_id) AS position FROM events GROUP BY user_id, event_type""")
def first_paths(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    return jobs.distinct_paths(rows.select(F.concat_ws("/", "user_id", "event_type").alias("path"), F.col("event_id").alias("position")))


_TRUTH = "(CASE WHEN turn % 4 = 0 THEN true WHEN turn % 4 = 1 THEN false END)"


@query(f"""WITH {CONVERSATION_CUES}, m AS (SELECT media_id, count(*) AS subtitle_count, max(end_s) + 1.0::DOUBLE AS d, arg_max(end_s, seq) AS e FROM conversation_cues GROUP BY media_id), {_FLAGS.replace('FROM line_cues', 'FROM conversation_cues')},
n AS ({_COUNTERS}), q AS (SELECT media_id, count(*) AS k FROM conversation_cues WHERE length(text) % 3 = 0 GROUP BY media_id)
SELECT media_id, subtitle_count, CASE WHEN e / d < 0.7::DOUBLE AND d - e > 300.0 THEN 'suspicious_incomplete' ELSE 'success' END AS status, CAST(floor(round_even(30.0 / d, 6) * 1000000 + 0.5) AS BIGINT) AS speed,
  {_ms('e')} AS last_end_ms, coalesce(issue_count, 0) AS issue_count, coalesce(split_candidate_count, 0) AS split_candidate_count, coalesce(drop_count, 0) AS drop_count, coalesce(review_count, 0) AS review_count, coalesce(k, 0) AS tail_refined_count, 0::BIGINT AS aligned_count
FROM m LEFT JOIN n USING (media_id) LEFT JOIN q USING (media_id)""")
def process_reports(spark, sf_dir):
    rows = conversation_cues(spark, sf_dir)
    media = rows.groupBy("media_id").agg((F.max("end_s") + 1.0).alias("duration_s"))
    stages = {"tail_refined": rows.where(F.length("text") % 3 == 0), "aligned": rows.where("seq < 0")}
    found = jobs.process_report(rows, quality.quality_issues(rows), media, media.select("media_id", F.lit(30.0).alias("processing_seconds")), **stages)
    counts = ["issue_count", "split_candidate_count", "drop_count", "review_count", "tail_refined_count", "aligned_count"]
    return found.select("media_id", "subtitle_count", "status", F.floor(F.col("realtime_factor") * 1000000 + 0.5).cast("long").alias("speed"), ms("last_end_s").alias("last_end_ms"), *counts)


@query("""SELECT conv_id AS media_id, 'no subtitle entries' AS reason FROM conversations WHERE conv_id % 3 = 0 GROUP BY conv_id""")
def unreadable_subtitles(spark, sf_dir):
    """Subtitle texts without an entry, as rows with a reason."""
    rows = subtitles.render_srt(conversation_cues(spark, sf_dir))
    broken = F.when(F.col("media_id") % 3 == 0, F.regexp_replace("body", "-->", "to")).otherwise(F.col("body"))
    return subtitles.strict_entries(rows.withColumn("body", broken))[1]


@query(f"""SELECT conv_id * 100 + turn AS media_id, CASE WHEN ok THEN threshold END AS silence_threshold_db, CASE WHEN ok THEN seconds END AS min_silence_cs, CASE WHEN ok THEN kept END AS delete_source_on_success, reason FROM (
  SELECT *, reason IS NULL AS ok FROM (SELECT conv_id, turn, CASE WHEN turn % 5 = 1 THEN 'loud' WHEN turn % 5 <> 4 THEN '-' || turn || '.5dB' END AS threshold, CASE WHEN turn % 6 <> 5 THEN turn % 6 * 25 END AS seconds, {_TRUTH} AS kept,
    CASE WHEN turn % 9 = 8 THEN 'expected object' WHEN turn % 5 = 1 THEN 'silence_threshold_db must look like -35dB' WHEN turn % 6 = 0 THEN 'min_silence_duration_s must be > 0' END AS reason FROM conversations))""")
def job_options(spark, sf_dir):
    """Options of jobs as typed columns, or the reason why they are not valid."""
    turn = F.col("turn")
    truth = F.when(turn % 4 == 0, True).when(turn % 4 == 1, False)
    threshold = F.when(turn % 5 == 1, "loud").when(turn % 5 != 4, F.concat(F.lit("-"), turn.cast("string"), F.lit(".5dB")))
    options = F.to_json(F.struct(threshold.alias("silence_threshold_db"), F.when(turn % 6 != 5, turn % 6 / 4.0).alias("min_silence_duration_s"), truth.alias("delete_source_on_success")))
    given = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + turn).alias("media_id"), F.when(turn % 9 == 8, F.concat(F.lit("["), options, F.lit("]"))).otherwise(options).alias("options"))
    found = reports.parse_job_options(given)
    return found.select("media_id", "silence_threshold_db", F.floor(F.col("min_silence_duration_s") * 100).cast("long").alias("min_silence_cs"), "delete_source_on_success", "reason")


@query(f"""SELECT CAST(l_returnflag AS VARCHAR) AS asr_backend, count(*) AS runs, {_MICRO('max(l_quantity / l_extendedprice)')} AS slowest FROM lineitem WHERE l_linenumber <= 3 GROUP BY l_returnflag""")
def history_variant(spark, sf_dir):
    """Runs of any status that name their media's or else their audio's length."""
    rows = run_history(spark, sf_dir).where(F.col("mtime.l_linenumber") <= 3)
    first = F.col("mtime.l_linenumber") == 1
    rows = rows.withColumns({"audio_duration_seconds": F.when(first, F.col("media_duration_seconds")), "media_duration_seconds": F.when(~first, F.col("media_duration_seconds")), "status": F.lit("failed")})
    return history.history_ratios(rows).groupBy("asr_backend").agg(F.count("*").alias("runs"), F.floor(F.max("ratio") * 1000000 + 0.5).cast("long").alias("slowest"))


# ---- remaining rules -----------------------------------------------------------------------------------------------

_CJK = "translate(text, 'aeiourstn', '漢字文書語学生物理')"


@query(f"""WITH {LINE_CUES}, c AS (SELECT media_id, seq, CASE WHEN seq % 4 = 3 THEN {_CJK} || 'の' ELSE {_CJK} END AS text FROM line_cues), n AS (SELECT *, length(regexp_replace(text, '[^㐀-鿿]', '', 'g')) AS cjk FROM c)
SELECT media_id, seq, length(text) >= 8 AND cjk >= 8 AND NOT regexp_matches(text, '[぀-ヿ]') AND cjk::DOUBLE / greatest(length(text), 1)::DOUBLE >= 0.6::DOUBLE AS garbage FROM n""")
def garbage_texts(spark, sf_dir):
    """Texts that are nearly all ideographs, without any kana."""
    text = F.translate("text", "aeiourstn", "漢字文書語学生物理")
    rows = line_cues(spark, sf_dir).withColumn("text", F.when(F.col("seq") % 4 == 3, F.concat(text, F.lit("の"))).otherwise(text))
    return rows.select("media_id", "seq", T.looks_like_garbage_cjk(F.col("text"), 0.6).alias("garbage"))


@query(f"""WITH {CONVERSATION_CUES}, e AS (SELECT media_id, seq, CASE seq % 4 WHEN 0 THEN 'うん、うん。' WHEN 1 THEN 'うんと' ELSE text END AS text, CASE WHEN seq % 3 <> 2 THEN ' [' || seq || '] ' || text || ' ' END AS reply FROM conversation_cues),
m AS (SELECT *, CASE WHEN seq % 4 = 0 THEN '응' ELSE coalesce(trim(reply, ' ' || chr(10)), '') END AS translation FROM e)
SELECT media_id, count(*) AS subtitle_count, count(*) FILTER (WHERE translation = '') AS missing_count, count(*) FILTER (WHERE translation = '응') AS fixed_count, max(length(translation)) AS longest, 40 AS batch_size, 'some' AS model FROM m GROUP BY media_id""")
def translation_reports(spark, sf_dir):
    """Replies merged with fixed translations of short reactions, and what is known of each media after that."""
    seq, text = F.col("seq"), F.col("text")
    rows = conversation_cues(spark, sf_dir)
    replies = rows.where(seq % 3 != 2).select("media_id", "seq", F.concat(F.lit(" ["), seq.cast("string"), F.lit("] "), text, F.lit(" ")).alias("text"))
    entries = rows.select("media_id", "seq", F.when(seq % 4 == 0, "うん、うん。").when(seq % 4 == 1, "うんと").otherwise(text).alias("text"))
    merged = translate.merge_replies(entries, replies)
    more = merged.groupBy("media_id").agg(F.count_if(F.col("translation") == "응").alias("fixed_count"), F.max(F.length("translation")).cast("long").alias("longest"))
    return translate.translation_metadata(merged, 40, "some").join(more, "media_id")


@query(f"""WITH {CONVERSATION_CUES}, c AS (SELECT media_id, count(*) AS expected, count(*) FILTER (WHERE seq % 5 <> 4 OR media_id % 2 = 0) AS found FROM conversation_cues GROUP BY media_id) SELECT * FROM c WHERE expected <> found""")
def count_mismatches(spark, sf_dir):
    rows = conversation_cues(spark, sf_dir)
    return translate.cardinality_check(rows, rows.where("seq % 5 <> 4 or media_id % 2 = 0"))


@query(f"""WITH {CONVERSATION_CUES} SELECT media_id, row_number() OVER (PARTITION BY media_id ORDER BY seq) AS seq, {_ms('start_s')} AS start_ms, {_ms('end_s')} AS end_ms, text FROM conversation_cues""")
def json_texts(spark, sf_dir):
    """Cues written as JSON, and read from it again."""
    bodies = subtitles.render_json(conversation_cues(spark, sf_dir))
    read = bodies.select("media_id", F.posexplode(F.from_json("body", "array<struct<start: double, end: double, text: string>>")).alias("at", "c"))
    return timed(read.select("media_id", (F.col("at") + 1).cast("long").alias("seq"), F.col("c.start").alias("start_s"), F.col("c.end").alias("end_s"), F.col("c.text").alias("text")), "text")


@query(f"""WITH {EVENT_SPANS} SELECT media_id, seq, CAST(floor(round_even(start_s, 1) * 10 + 0.5) AS BIGINT) AS start_ds, CAST(floor(round_even(end_s, 1) * 10 + 0.5) AS BIGINT) AS end_ds, event_type = 'error' AS transcribed FROM event_spans""")
def vad_reports(spark, sf_dir):
    """Reports of detected spans and of those that are transcribed, taken apart again."""
    rows = event_spans(spark, sf_dir)
    found = reports.vad_report(rows, rows.where("event_type = 'error'"), {"engine": "events"}, 1, numbered=True)
    spans_of = lambda column, kept: found.select("media_id", F.inline(column)).withColumn("kept", F.lit(kept))
    each = spans_of("speech_spans", False).unionByName(spans_of("transcription_spans", True)).groupBy("media_id", "seq")
    tenths = lambda c: F.floor(F.max(c) * 10 + 0.5).cast("long")
    return each.agg(tenths("start").alias("start_ds"), tenths("end").alias("end_ds"), F.max("kept").alias("transcribed"))


@query(f"""WITH {CONVERSATION_CUES}, r AS (SELECT media_id, seq, start_s, end_s, text, greatest(start_s, end_s - 5.0::DOUBLE) AS tail, CASE seq % 3 WHEN 0 THEN substring(text, length(text) // 2 + 1) WHEN 1 THEN 'zq' END AS heard, (seq % 4)::DOUBLE AS first FROM conversation_cues),
n AS (SELECT *, {_norm('text')} AS a, coalesce({_norm('heard')}, '') AS b FROM r),
t AS (SELECT *, heard IS NOT NULL AND length(b) >= 4 AND length(b)::DOUBLE / length(a)::DOUBLE >= 0.35::DOUBLE AND contains(a, b) AND a <> '' AND b <> '' AS accepted FROM n),
m AS (SELECT *, accepted AND tail + first > start_s AND tail + first < end_s AS moved FROM t)
SELECT media_id, seq, {_ms('CASE WHEN moved THEN tail + first ELSE start_s END')} AS start_ms, {_ms('end_s')} AS end_ms, moved FROM m""")
def moved_tails(spark, sf_dir):
    """Tails that were recognised again: accepted by likeness and length, applied where they lie inside their cues."""
    rows, seq = conversation_cues(spark, sf_dir), F.col("seq")
    requests = quality.tail_requests(rows.select("media_id", seq.alias("idx"), "start_s", "end_s"))
    heard = F.when(seq % 3 == 0, F.expr("substring(text, cast(floor(length(text) / 2) as int) + 1)")).when(seq % 3 == 1, "zq")
    tails = rows.select("media_id", seq.alias("idx"), F.lit(1).alias("seq"), (seq % 4).cast("double").alias("start_s"), heard.alias("text")).where("text is not null")
    moved, applied = quality.apply_tail(rows, quality.tail_attempts(rows, requests, tails))
    found = applied.select("media_id", F.col("idx").alias("seq"), F.lit(True).alias("moved"))
    return timed(moved).join(found, ["media_id", "seq"], "left").na.fill(False, ["moved"])


@query("""WITH b AS (SELECT user_id || '' AS worker, ts, CASE WHEN event_type = 'error' THEN 'busy' ELSE 'ready' END AS status, event_id % 3 <> 0 AS model_loaded, event_id % 5 <> 0 AS gpu_available, event_id % 7 <> 0 AS watcher_running, event_id FROM events),
l AS (SELECT worker, max(ts) AS ts, arg_max(status, (ts, event_id)) AS status, arg_max(model_loaded, (ts, event_id)) AS m, arg_max(gpu_available, (ts, event_id)) AS g, arg_max(watcher_running, (ts, event_id)) AS w FROM b GROUP BY worker),
r AS (SELECT worker, CASE WHEN (SELECT max(ts) FROM events) - ts > INTERVAL 12 HOUR THEN 'stale' WHEN NOT m THEN 'bad model_loaded' WHEN NOT g THEN 'bad gpu_available' WHEN NOT w THEN 'bad watcher_running' WHEN status <> 'ready' THEN 'bad status' END AS reason FROM l)
SELECT worker, reason, reason IS NULL AS healthy FROM r""")
def worker_states(spark, sf_dir):
    """Workers by their newest beat, as of the last event."""
    events, number = table(spark, sf_dir, "events"), F.col("event_id")
    status = F.when(F.col("event_type") == "error", "busy").otherwise("ready")
    beats = events.select(F.col("user_id").cast("string").alias("worker"), F.col("ts").alias("updated_at"), status.alias("status"), (number % 3 != 0).alias("model_loaded"), (number % 5 != 0).alias("gpu_available"), (number % 7 != 0).alias("watcher_running"))
    now = events.agg(F.max("ts").alias("now"))
    return watch.worker_health(beats, now.first()["now"], 12 * 3600.0).select("worker", "reason", "healthy")


@query(f"""WITH {EVENT_SPANS}, {_SAMPLES}, {_SAMPLE_CUES},
asked AS (SELECT media_id, seq, CAST(floor(start_s * 10) AS BIGINT) AS first, least(CAST(floor(least(end_s, start_s + 2.0::DOUBLE) * 10) AS BIGINT), total) AS stop FROM sample_cues JOIN totals USING (media_id)),
loud AS (SELECT a.media_id, a.seq, (i - first) AS k FROM asked a JOIN samples m ON m.media_id = a.media_id AND i >= first AND i < stop WHERE s >= 3000),
onset AS (SELECT media_id, seq, min(k) AS k FROM loud GROUP BY ALL),
moved AS (SELECT c.*, greatest(start_s, least(greatest(start_s, floor(start_s * 10) / 10 + k / 10.0::DOUBLE), end_s)) AS late FROM sample_cues c LEFT JOIN onset USING (media_id, seq)),
d AS (SELECT media_id, CASE WHEN late > start_s AND late < end_s THEN late - start_s END AS lag FROM moved)
SELECT media_id, count(lag) AS adjusted_count, CAST(floor(coalesce(round_even(avg(lag), 3), 0) * 100 + 0.5) AS BIGINT) AS average_cs, CAST(floor(coalesce(round_even(max(lag), 3), 0) * 100 + 0.5) AS BIGINT) AS longest_cs FROM d GROUP BY media_id""")
def refinement_statistics(spark, sf_dir):
    """How many starts of each media were moved, and how far."""
    level = 20 * math.log10(2999.5 / 32768)
    _, stats = audio.refine_span_starts(_sample_cues(spark, sf_dir), _blocks(spark, sf_dir), level, 0.0, 0.0, 0.1, 1, 2.0)
    centi = lambda c: F.floor(F.col(c) * 100 + 0.5).cast("long")
    return stats.select("media_id", "adjusted_count", centi("average_adjustment_s").alias("average_cs"), centi("max_adjustment_s").alias("longest_cs"))
