"""Quality rules from text statistics and cross-document line frequency, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, keyed_texts, same_doc, saved

#: The characters counted as symbols.
SYMBOLS = "#*$%&|<>"
_GAP = "[\\x20\\x09-\\x0D]+"
_WORD = "[^\\x20\\x09-\\x0D]"


def _let(value: Column, body) -> Column:
    """``body`` over ``value``, which is worked out once: a lambda's variable is not spelled out again."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, _GAP), lambda w: w != "")


def repeated_words(words: Column, window: int = 5) -> Column:
    """Number of words inside windows of ``window`` words that stand twice or more in the text, the first included."""

    def covered(windows: Column) -> Column:
        def positions(ordered: Column) -> Column:
            def twice(item: Column, at: Column) -> Column:
                same = lambda other: F.coalesce(F.get(ordered, other)["h"] == item["h"], F.lit(False))
                return same(at - 1) | same(at + 1)

            return F.sort_array(F.transform(F.filter(ordered, twice), lambda item: item["at"]))

        ordered = F.sort_array(F.transform(windows, lambda h, at: F.struct(h.alias("h"), at.alias("at"))))

        def total(places: Column) -> Column:
            step = lambda at, n: F.least(F.coalesce(F.get(places, n + 1) - at, F.lit(window)), F.lit(window))
            return F.aggregate(F.transform(places, step), F.lit(0), lambda sum_, x: sum_ + x)

        count = _let(ordered, lambda o: _let(positions(o), total))
        return F.when(F.size(F.array_distinct(windows)) < F.size(windows), count).otherwise(0)

    def windows(hashes: Column) -> Column:
        at_least = F.size(hashes) >= window
        spots = F.when(at_least, F.sequence(F.lit(0), F.size(hashes) - window)).otherwise(F.array().cast("array<int>"))
        return F.transform(spots, lambda at: F.xxhash64(*[F.get(hashes, at + n) for n in range(window)]))

    return _let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: _let(windows(h), covered))


def text_statistics(text: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text."""
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(_WORD))

    def of_words(words: Column) -> Column:
        joined = F.length(F.array_join(words, "")).cast("long")
        return F.struct(F.size(words).cast("long").alias("n"), joined.alias("chars"), repeated_words(words).cast("long").alias("repeated"))

    return F.struct(
        _let(words_of(text), of_words).alias("words"),
        F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        _let(lines, lambda own: F.size(own) - F.size(F.array_distinct(own))).cast("long").alias("n_dup_lines"),
    )


def frequent_line_words(docs: DataFrame, id_col: str, text_col: str, host_col: str, max_docs: int, count_copies: bool = False) -> DataFrame:
    """(rk, doc_id, common_words): words of each document that stand in lines above the limit of its host.

    A line is normalised (blanks stripped, lower case) and hashed. Its documents within a host are counted by their whole
    text, so that exact copies of one document count once and all others, near copies too, count each; with
    ``count_copies`` by their id and text, so that copies under ids of their own count each.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"), text.alias("text"))
    normal = F.transform(F.split("text", "\n", -1), lambda line: F.lower(F.btrim(line, F.lit(BLANKS))))
    entry = F.transform(F.filter(normal, lambda line: line != ""), lambda line: F.struct(F.xxhash64(line).alias("h"), F.size(F.split(line, _GAP)).alias("words")))
    base = base.select("doc_id", F.xxhash64("doc_id", "text").alias("rk"), (F.xxhash64("doc_id", "text") if count_copies else F.xxhash64("text")).alias("whole"), "host", entry.alias("entries"))
    lines = base.select("doc_id", "rk", "whole", "host", F.posexplode("entries").alias("at", "e"))
    lines = saved(lines.select("doc_id", "rk", "whole", "at", "host", F.col("e.h").alias("h"), F.col("e.words").alias("words")), "host-lines")
    per = lines.groupBy("host", "h", "whole").agg(F.lit(1).alias("one")).groupBy("host", "h").agg(F.count("*").alias("docs"))
    common = per.where(F.col("docs") > max_docs).select("host", "h")
    removed = lines.join(common, ["host", "h"], "left_semi").groupBy("doc_id", "rk", "at").agg(F.max("words").alias("words"))
    return removed.groupBy("doc_id", "rk").agg(F.sum("words").alias("common_words"))


def quality_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    max_docs: int = 20,
    min_words: int = 10,
    max_repeat_percent: int = 20,
    min_left_percent: int = 20,
    count_copies: bool = False,
) -> DataFrame:
    """Judge documents; returns one row per input row: doc_id, rk (a key that also depends on the text), n_words,
    word_chars, n_symbols, n_dup_lines, n_repeat_words, common_words, base_failed and kept.

    base_failed: fewer than ``min_words`` words, or more than ``max_repeat_percent`` % of words in 5-word windows that
    repeat within the text. Others fail if lines that stand in more than ``max_docs`` distinct documents (texts, or with
    ``count_copies`` ids and texts) of their host are removed and then fewer than ``min_words`` words or ``min_left_percent`` % of its words are left.

    Null text has no words. A null host is a host of its own. Rows that repeat an id are separate documents; rows equal
    in id and text share one verdict. An empty table gives an empty result; further columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    judged = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    judged = judged.select("doc_id", F.xxhash64("doc_id", "text").alias("rk"), text_statistics(F.col("text")).alias("s"))
    judged = judged.select("doc_id", "rk", F.col("s.words.n").alias("n_words"), F.col("s.words.chars").alias("word_chars"), "s.n_symbols", "s.n_dup_lines", F.col("s.words.repeated").alias("n_repeat_words"))
    common = frequent_line_words(docs, id_col, text_col, host_col, max_docs, count_copies)
    n_words, repeats = F.col("n_words"), F.col("n_repeat_words")
    base_failed = (n_words < min_words) | (100 * repeats > max_repeat_percent * n_words)
    key = (judged["rk"] == common["rk"]) & judged["doc_id"].eqNullSafe(common["doc_id"])
    joined = judged.join(common, key, "left").select(judged["doc_id"], judged["rk"], "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", F.coalesce("common_words", F.lit(0)).alias("common_words"))
    left = n_words - F.col("common_words")
    depleted = (F.col("common_words") > 0) & ((left < min_words) | (100 * left < min_left_percent * n_words))
    return joined.withColumn("base_failed", base_failed).withColumn("kept", ~base_failed & ~depleted)


def good_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The rows of ``docs`` that ``quality_rules`` keeps, with all their columns as they are, whatever their names. Null,
    empty and blank texts have too few words and go. Rows equal in id and text stay or go together."""
    judged = quality_rules(docs, id_col, text_col, host_col)
    rejected = judged.where("not kept").select("doc_id", "rk").distinct()
    keyed = keyed_texts(docs, id_col, text_col, carry=True)
    return keyed.join(rejected, same_doc(keyed, rejected), "left_anti").select("row.*")
