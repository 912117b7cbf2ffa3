"""From raw documents to packed training sequences: five stages, each applying one operator to all it is given."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timeloom.llm import lines, mixing, packing, quality, queries, shingles, simhash
from timeloom.llm.common import clear_scratch, replaced, saved, scratch_mark
from timeloom.llm.components import joined


def reject_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents that fail the text rules, or consist of lines that many others share, go. Null, empty and
    blank texts fail; repeated rows share a verdict; an empty table stays empty; further columns stay as they are."""
    return quality.good_documents(docs)


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: lines found in ten documents or more stay in the first of them only, that of the smallest id. Every row
    stays, with its text and n_chars anew; a null text becomes an empty one. Repeated rows share a result."""
    found = lines.drop_lines(docs, min_docs=10, keep_first=True, carry=True)
    return replaced(found, docs.schema, {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")})


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4, on five-word shingles: of documents whose fingerprints, found by their Golay keys, differ in at most
    two bits, the first stays. Such fingerprints are much closer than a Jaccard index of 0.8 (README has figures), so sets
    of shingles as similar as that, found by keys of minima and compared in full, link as well, and so does any chain of
    both. First is the smallest id, a null id before all; repeated rows become one; texts without words are copies of
    one another."""
    marked = shingles.described(docs, shingle_words=5, with_fp=True)
    near = simhash.near_duplicates(docs, shingle_words=5, max_distance=2, marked=marked)
    similar = shingles.similar_classes(docs, shingle_words=5, percent=80, marked=marked)
    return simhash.first_of_each(docs, joined(similar, near))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: documents of poor and toxic posteriors are thinned out to their target weights. Documents that clean
    leads stay; repeated rows stay or go together; a domain whose labelled documents have all gone is logged."""
    return mixing.mixed_documents(docs, queries.labelled_domains(spark, sf_dir), queries.WEIGHTS, keep_domain="clean")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: the documents as token sequences of at most 4096 ids, a row for each piece. Null and empty texts are an
    end id alone; every row is a document; an empty table gives an empty result; further columns are not read."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", reject_poor),
    ("lines", drop_shared_lines),
    ("near_duplicates", keep_one_copy),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL cannot express fingerprints, the classifier or the packing; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents; what a stage saved for itself goes once its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mark = scratch_mark()
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
        clear_scratch(spark, mark, keep=docs)
    return STAGES[-1][1](spark, docs, sf_dir)
