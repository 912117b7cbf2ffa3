import random
import re

import math

import pytest
from pyspark.sql import functions as F

from timeloom.functions import text as T
from timeloom.functions import timing


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("given, expected", [("  Hello , world ! ", "Hello, world!"), ("「　もし 」", "「もし」"), ("", "")])
def test_clean_text(spark, given, expected):
    assert value(spark, T.clean_text(F.lit(given))) == expected


def test_normalize_keeps_marks_in_one_profile(spark):
    assert value(spark, T.normalize_phrase(F.lit("ごめ　ん。"))) == "ごめん"
    assert value(spark, T.normalize_phrase(F.lit("ごめ　ん。"), "docker")) == "ごめん。"


@pytest.mark.parametrize("text, bare", [(".", True), ("。", True), ("??", True), ("、", True), ("そう。", False), ("3か月", False)])
def test_punctuation_only(spark, text, bare):
    assert value(spark, T.is_punctuation_only(F.lit(text), "docker")) is bare
    assert value(spark, T.is_punctuation_only(F.lit(text))) is bare


def test_underscore_differs_by_profile(spark):
    assert value(spark, T.is_punctuation_only(F.lit("_"), "docker")) is True
    assert value(spark, T.is_punctuation_only(F.lit("_"))) is False


def test_join_and_similarity(spark):
    assert value(spark, T.join_text(F.lit("Hello"), F.lit("world."))) == "Hello world."
    assert value(spark, T.join_text(F.lit("もし"), F.lit("もし。"))) == "もしもし。"
    assert value(spark, T.text_similarity(F.lit("abcd"), F.lit("bc"))) == 1.0
    assert value(spark, T.text_similarity(F.lit("abc"), F.lit("abd"))) == pytest.approx(1 / 3)
    assert value(spark, T.text_similarity(F.lit(""), F.lit("abd"))) == 0.0


def test_garbage_cjk(spark):
    assert value(spark, T.looks_like_garbage_cjk(F.lit("漢" * 9))) is True
    assert value(spark, T.looks_like_garbage_cjk(F.lit("漢" * 9 + "か"))) is False


def test_units(spark):
    assert value(spark, T.text_units(F.lit("待ってください急いで。はい"))) == ["待ってください", "急いで。", "はい"]
    assert value(spark, T.text_units(F.lit("one, two! three"), "docker")) == ["one, two!", "three"]


def test_split_chars(spark):
    assert value(spark, T.split_chars(F.lit("abcdefgh"), F.lit(2), "docker")) == ["abcd", "efgh"]
    assert value(spark, T.split_chars(F.lit("abcdef"), F.lit(3), "docker")) == ["ab", "cd", "ef"]
    assert value(spark, T.split_chars(F.lit("abcdefg"), F.lit(3))) == ["abc", "def", "g"]


def test_parts_are_balanced(spark):
    """Parts keep the units in order; each but the last is as full as an equal share of what is left allows."""
    for units in (["aaa", "bb", "cccc", "d", "eeeee"], ["a"] * 7, ["aaaaaaaaaa", "b"]):
        for most in (2, 3, 4):
            parts = value(spark, T.balance_units(F.array(*map(F.lit, units)), F.lit(most), 6))
            ends = {sum(map(len, units[:n])) for n in range(len(units) + 1)}
            assert "".join(parts) == "".join(units) and 1 <= len(parts) <= most
            wanted = min(most, max(2, math.ceil(len("".join(units)) / 6), min(most, len(units))))
            at = 0
            for n, part in enumerate(parts[:-1]):
                first = next(len(u) for k, u in enumerate(units) if sum(map(len, units[:k])) == at)
                following = next(len(u) for k, u in enumerate(units) if sum(map(len, units[:k])) == at + len(part))
                left = len("".join(units)) - at  # the share may only shrink while a part is filled
                assert at + len(part) in ends and (len(part) == first or len(part) <= math.ceil(left / (wanted - n)))
                assert len(part) + following > math.ceil((left - len(part)) / (wanted - n))
                at += len(part)


def test_allocate(spark):
    text, spans = "One. Two! Three? Four! Five.", [1.0, 2.0, 1.0]
    got = value(spark, T.allocate_text(F.lit(text), F.array(*map(F.lit, spans))))
    assert len(got) == 3 and "".join(got).replace(" ", "") == text.replace(" ", "")
    assert value(spark, T.allocate_text(F.lit("abcdef"), F.array(*map(F.lit, spans)))) == ["ab", "cd", "ef"]


def test_translation_text(spark):
    assert value(spark, T.clean_translation(F.lit(" [1] [23]  a [4]"))) == "a [4]"
    assert value(spark, T.translation_override(F.lit("うん、うん。"))) == "응"
    assert value(spark, T.translation_override(F.lit("うん、いいよ。"))) is None
    assert value(spark, T.translated_name(F.lit("a/b.ja.srt"))) == "a/b.ko.srt"


@pytest.mark.parametrize("seconds, code", [(1.2, "00:00:01,200"), (3661.234, "01:01:01,234"), (-1.0, "00:00:00,000")])
def test_time_codes(spark, seconds, code):
    assert value(spark, timing.format_srt_time(F.lit(seconds))) == code
    assert value(spark, timing.parse_srt_time(F.lit(code))) == pytest.approx(max(0, seconds))


def test_numbers(spark):
    assert value(spark, timing.parse_db(F.lit("-35.5dB"))) == -35.5
    assert value(spark, timing.parse_db(F.lit("loud"))) is None
    assert value(spark, timing.format_db(F.lit(-34.5))) == "-34dB"
    assert value(spark, timing.positive(F.lit("x"))) is None
    assert value(spark, timing.realtime_factor(F.lit(125.0), F.lit(1000.0))) == 0.125
    assert value(spark, timing.dbfs(F.array(F.lit(0), F.lit(0)))) == -100.0


def test_one_pass_cleans_like_three(spark):
    """Against the rules one after the other, for all white space and marks."""
    chance = random.Random(5)
    parts = ["a", "日", "1", "_", "́", "。", ",", ".", "!", "…", "、", "「", "（", "」", "）", " ", " ", "\n", "　", " ", "\x85", "​", "\x1c"]
    texts = ["".join(chance.choice(parts) for _ in range(chance.randint(0, 12))) for _ in range(3000)]
    white = f"[{T.WHITE}]"

    def clean(t):
        t = re.sub(white + r"+([。！？、,.!?])", r"\1", t.strip(T.WHITE))
        return re.sub(white + "+([」』）])", r"\1", re.sub("([「『（])" + white + "+", r"\1", t))

    bare = {t: re.sub(white, "", clean(t)) for t in texts}
    columns = {"c": T.clean_text(F.col("t")), "n": T.normalize_phrase(F.col("t")), "d": T.normalize_phrase(F.col("t"), "docker"), "p": T.is_punctuation_only(F.col("t")), "q": T.is_punctuation_only(F.col("t"), "docker")}
    for r in spark.createDataFrame([(t,) for t in texts], "t string").withColumns(columns).collect():
        assert (r.c, r.d, r.n) == (clean(r.t), bare[r.t], bare[r.t].rstrip("。、，．,.!?！？…"))
        assert r.q == (bare[r.t] != "" and not set(bare[r.t]) & {"a", "日", "1"})
        assert r.p == (bare[r.t] != "" and not set(bare[r.t]) & {"a", "日", "1", "_", "́"})


def test_cleaning_is_one_expression(spark):
    plan = spark.range(1).select(T.normalize_phrase(T.clean_text(F.col("id").cast("string"))))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") <= 4
