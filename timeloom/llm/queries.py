"""The registered queries of the training-data operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, leaks, lines, mixing, nearest, packing, quality, rlz, simhash, spelling, suffix, tokens, urls

from .common import saved
from .oracles import ORACLES


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The URL rules of the registered query.
URL_RULES = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}


#: The domains of the labelled table and the shares of tokens that the mixture is to have.
WEIGHTS = {"clean": 0.95, "poor": 0.04, "toxic": 0.01}


def labelled_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "poor").otherwise("clean")
    return _table(spark, sf_dir, "labels").select("doc_id", domain.alias("domain"))


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_rates(_table(spark, sf_dir, "documents"), labelled_domains(spark, sf_dir), WEIGHTS).drop("rk")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), end_id=1, capacity=4096)


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix.remove_repeats(_table(spark, sf_dir, "documents"), min_bytes=200, with_kept=False)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op4_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle_words=3, max_distance=2)
    return found.select("doc_id", "fingerprint", "component_id")


def mirror_hosts(pages: DataFrame) -> DataFrame:
    """Mobile mirrors: hosts m.X for which X, www.X or blog.X stands in the corpus too."""
    hosts = pages.select(urls.host_of(F.col("url")).alias("host")).distinct()
    site = F.regexp_replace("host", "^(m|www|blog)[.]", "")
    mobile = hosts.where(F.startswith("host", F.lit("m."))).withColumn("site", site)
    others = hosts.where(~F.startswith("host", F.lit("m."))).select(site.alias("site")).distinct()
    return mobile.join(others, "site", "left_semi").select("host")


def op5_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return urls.judge_urls(pages, mirror_hosts(pages), URL_RULES)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.quality_rules(_table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_block_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return nearest.nearest(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.drop_lines(_table(spark, sf_dir, "documents"), min_docs=10, min_chars=1, with_kept=False)


def op9_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rlz.remove_passages(_table(spark, sf_dir, "documents"), window_words=20, with_kept=False)
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.piece_counts(_table(spark, sf_dir, "documents"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment_scores(_table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = saved(spelling.corpus_words(_table(spark, sf_dir, "documents"), min_chars=6, min_count=5, slip=199), "words")
    return spelling.spelling_forms(words, ratio=5)


def op13_benchmark_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks.benchmark_hits(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), words=10)
    digest = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op")}


def oracles() -> dict[str, str]:
    """DuckDB SQL by query; the queries that SQL cannot express are compared with brute force in tests."""
    return dict(ORACLES)
