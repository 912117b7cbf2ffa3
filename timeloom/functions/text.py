"""Text functions over cue texts. White space and word classes are those of Unicode, as ``(?U)`` gives them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Marks that end a sentence, and phrases that end a unit of speech.
SENTENCE_END = "。！？.!?"
UNIT_ENDINGS = (
    "くださいね", "ください", "下さい", "ごらん", "ちょうだい", "していいよ", "していい", "いいの", "いいよ",
    "だよ", "だね", "なの", "ですか", "ますか", "じゃん", "ねえ", "はい", "うん",
)
#: Phrases that recognisers make up where nobody speaks.
BLOCKED_PHRASES = ("ごめん", "ありがとうございました", "ありがとうございます", "ご視聴ありがとうございました")

#: The characters that Unicode counts as white space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_CUT = "\x01"


def let(value: Column, body) -> Column:
    """``body`` over ``value``, which is worked out once."""
    return F.transform(F.array(value), body)[0]


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE))


def clean_text(text: Column) -> Column:
    """Strip; no white space before closing marks and after opening brackets. Whether a run of white space goes depends on
    its neighbours alone, so one pass does for all."""
    return F.regexp_replace(strip(text), r"(?U)(?=\s)(?:\s++(?=[。！？、,.!?」』）])|(?<=[「『（])\s++)", "")


def normalize_phrase(text: Column, profile: str = "standalone") -> Column:
    """Clean without any white space; ``standalone`` also drops marks at the end, ``docker`` keeps them."""
    text = F.regexp_replace(text, r"(?U)\s+", "")  # cleaning takes nothing but white space
    return F.rtrim(text, F.lit("。、，．,.!?！？…")) if profile == "standalone" else text


def ends_alnum(text: Column) -> Column:
    return F.substring(text, -1, 1).rlike("[A-Za-z0-9]")  # a search of the whole text tries every character


def starts_alnum(text: Column) -> Column:
    return text.rlike(r"\A[A-Za-z0-9]")


def needs_space(left: Column, right: Column) -> Column:
    return ends_alnum(left) & starts_alnum(right)


def join_text(left: Column, right: Column) -> Column:
    return clean_text(F.concat(left, F.when(needs_space(left, right), " ").otherwise(""), right))


def ends_sentence(text: Column) -> Column:
    return F.substring(F.rtrim(text, F.lit(WHITE)), -1, 1).isin(*SENTENCE_END)


def is_punctuation_only(text: Column, profile: str = "standalone") -> Column:
    says = r"(?U)[\w぀-ヿ㐀-鿿]" if profile == "standalone" else r"[\p{L}\p{N}]"
    return text.rlike(r"(?U)\S") & ~text.rlike(says)


def looks_like_garbage_cjk(text: Column, min_share: float = 0.8) -> Column:
    """Eight ideographs at least, ``min_share`` of the text, and no kana."""
    cjk = F.length(F.regexp_replace(text, r"[^㐀-鿿]+", ""))
    return (F.length(text) >= 8) & (cjk >= 8) & ~text.rlike(r"[぀-ヿ]") & (cjk / F.greatest(F.length(text), F.lit(1)) >= min_share)


def char_ngrams(text: Column, size: int = 2) -> Column:
    """Distinct n-grams; a text no longer than one is its only one."""

    def grams(chars: Column) -> Column:
        spots = F.sequence(F.lit(0), F.greatest(F.size(chars) - size, F.lit(0)))
        return F.array_distinct(F.transform(spots, lambda at: F.concat(*[F.get(chars, at + n) for n in range(size)])))

    return F.when(F.length(text) <= size, F.array(text)).otherwise(let(F.split(text, ""), grams))


def text_similarity(left: Column, right: Column) -> Column:
    """0 if either text is empty, 1 if one contains the other, else the Jaccard similarity of character pairs."""

    def of(pair: Column) -> Column:
        a, b = pair["a"], pair["b"]
        sets = F.struct(char_ngrams(a).alias("x"), char_ngrams(b).alias("y"))
        jaccard = let(sets, lambda s: F.size(F.array_intersect(s["x"], s["y"])) / F.size(F.array_union(s["x"], s["y"])))
        return F.when((a == "") | (b == ""), 0.0).when(F.contains(a, b) | F.contains(b, a), 1.0).otherwise(jaccard)

    return let(F.struct(normalize_phrase(left).alias("a"), normalize_phrase(right).alias("b")), of)


def text_units(text: Column, profile: str = "standalone") -> Column:
    """Sentences and phrases of a text, cleaned, none empty."""
    if profile == "standalone":
        marked = F.regexp_replace(text, f"([{SENTENCE_END}]+|{'|'.join(UNIT_ENDINGS)})", f"$1{_CUT}")
        units = F.filter(F.transform(F.split(marked, _CUT), clean_text), lambda u: u != "")
        return let(units, lambda u: F.when(F.size(u) > 0, u).otherwise(F.array(text)))
    parts = F.regexp_extract_all(text, F.lit(r"(?d).+?[。！？!?]+|.+?[、,]+|.+"), F.lit(0))
    return F.filter(F.transform(parts, strip), lambda u: u != "")


def split_chars(text: Column, parts: Column, profile: str = "standalone") -> Column:
    """Cut a text in parts by length: of one size (``standalone``), or at rounded shares of it (``docker``)."""
    n = F.length(text)
    if profile == "standalone":
        stride = F.greatest(F.ceil(n / parts).cast("int"), F.lit(1))
        cut = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1)), stride), lambda at: F.substring(text, at, stride))
        return F.when((parts <= 1) | (n <= 1), F.array(text)).otherwise(cut)
    at = lambda i: F.bround(n * i / parts).cast("int")
    cut = F.transform(F.sequence(F.lit(0), F.greatest(parts.cast("int"), F.lit(1)) - 1), lambda i: F.substring(text, at(i) + 1, at(i + 1) - at(i)))
    return F.when(parts <= 1, F.array(text)).otherwise(cut)


def balance_units(units: Column, max_parts: Column, max_chars: int) -> Column:
    """Merge units into parts of about equal length: a part closes when the next unit would take it beyond an equal
    share of what is left, while parts remain."""
    size = lambda unit: F.length(normalize_phrase(unit))

    def merged(own: Column) -> Column:
        units, most = own["units"], own["most"]
        total = F.aggregate(units, F.lit(0), lambda n, u: n + size(u))
        goal = F.least(most, F.greatest(F.lit(2), F.ceil(total / max_chars).cast("int"), F.least(most, F.size(units))))
        start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit("").alias("open"), total.alias("rest"), goal.alias("goal"))

        def step(acc: Column, unit: Column) -> Column:
            share = F.greatest(F.lit(1), F.ceil(acc["rest"] / F.greatest(F.lit(1), acc["goal"] - F.size(acc["parts"]))).cast("int"))
            close = (acc["open"] != "") & (size(F.concat(acc["open"], unit)) > share) & (F.size(acc["parts"]) < acc["goal"] - 1)
            return F.struct(
                F.when(close, F.concat(acc["parts"], F.array(acc["open"]))).otherwise(acc["parts"]).alias("parts"),
                F.when(close, unit).otherwise(F.concat(acc["open"], unit)).alias("open"),
                (acc["rest"] - size(unit)).alias("rest"),
                acc["goal"].alias("goal"),
            )

        finish = lambda acc: F.when(acc["open"] != "", F.concat(acc["parts"], F.array(acc["open"]))).otherwise(acc["parts"])
        parts = F.aggregate(units, start, step, finish)
        return let(parts, lambda p: F.when(F.size(p) > most, split_chars(F.array_join(p, ""), most)).otherwise(p))

    return let(F.struct(units.alias("units"), max_parts.cast("int").alias("most")), merged)


def split_long_text(text: Column, max_parts: Column, max_chars: int = 28) -> Column:
    """Parts of an over-long text: by its units, or by length if it has one unit only."""

    def of(clean: Column) -> Column:
        by_units = let(text_units(clean), lambda u: F.when(F.size(u) <= 1, split_chars(clean, max_parts)).otherwise(balance_units(u, max_parts, max_chars)))
        return F.when((max_parts <= 1) | (F.length(normalize_phrase(clean)) <= max_chars), F.array(clean)).otherwise(by_units)

    return let(clean_text(text), of)


def allocate_text(text: Column, durations: Column) -> Column:
    """Deal the units of a text to spans in proportion to their durations, one unit each at least; a text with fewer
    units than spans is cut by length."""

    def dealt(own: Column) -> Column:
        units, spans = own["units"], own["spans"]
        n, groups = F.size(units), F.size(spans)
        chars = F.aggregate(units, F.lit(0), lambda s, u: s + F.length(u))
        total = F.aggregate(spans, F.lit(0.0), lambda s, d: s + d)
        share = lambda g: F.greatest(F.lit(1), F.bround(chars * F.element_at(spans, g + 1) / total).cast("int"))
        start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"), F.lit(0).alias("used"), F.lit(0).alias("at"))

        def step(acc: Column, unit: Column) -> Column:
            group = F.size(acc["done"])
            stays = (acc["at"] == 0) | (group >= groups - 1) | ((acc["at"] < n - (groups - group - 1)) & (acc["used"] + F.length(unit) <= share(group)))
            return F.struct(
                F.when(stays, acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))).alias("done"),
                F.when(stays, F.concat(acc["open"], unit)).otherwise(unit).alias("open"),
                F.when(stays, acc["used"] + F.length(unit)).otherwise(F.length(unit)).alias("used"),
                (acc["at"] + 1).alias("at"),
            )

        by_units = F.aggregate(units, start, step, lambda acc: F.concat(acc["done"], F.array(acc["open"])))
        return F.when(groups <= 1, F.array(own["text"])).when((n <= 1) | (n < groups), split_chars(own["text"], groups, "docker")).otherwise(by_units)

    return let(F.struct(text.alias("text"), text_units(text, "docker").alias("units"), durations.alias("spans")), dealt)


def clean_translation(text: Column) -> Column:
    """Without number labels such as [12] at the start."""
    return strip(F.regexp_replace(strip(text), r"(?U)^(\[\d{1,4}\]\s*)+", ""))


def translation_override(text: Column) -> Column:
    """The fixed translation of a text that only repeats one short reaction, else null."""
    bare = strip(F.regexp_replace(strip(text), r"(?U)[\s。、，,.]+", " "))
    return F.when(bare.rlike(r"\Aうん( うん)*\z"), "응")


def translated_name(path: Column) -> Column:
    """X.ja.srt becomes X.ko.srt; another name gets .ko.srt for its suffix."""
    return F.when(F.endswith(path, F.lit(".ja.srt")), F.regexp_replace(path, r"\.ja\.srt\z", ".ko.srt")).otherwise(F.concat(F.regexp_replace(path, r"\.[^./]+\z", ""), F.lit(".ko.srt")))
