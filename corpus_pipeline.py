"""The corpus pipeline: quality rules, near duplicates, repeated passages, personal data, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termatlas.llm.common import Workspace
from termatlas.llm.packing import pack
from termatlas.llm.pii import redact_pii
from termatlas.llm.quality_rules import keep_good
from termatlas.llm.simhash import keep_one
from termatlas.llm.suffix_dedup import cut_repeats


#: Repeated strings are sought from this length on, which 51 words of the corpus' languages exceed.
PASSAGE_BYTES = 240
#: Only runs of more than 50 words are passages; shorter ones stay.
PASSAGE_WORDS = 51


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose posterior quality is good enough; the others go."""
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate group."""
    return keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of passages of over 50 words that repeat anywhere; n_chars follows."""
    return cut_repeats(docs, span=PASSAGE_BYTES, gram=48, least_words=PASSAGE_WORDS).withColumn("n_chars", F.length("text").cast("long"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind; n_chars follows."""
    return redact_pii(docs).withColumn("n_chars", F.length("text").cast("long"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's bucket, batch and slot."""
    return pack(docs)


STAGES = [
    ("quality_rules", quality),
    ("simhash_near_dedup", near_duplicates),
    ("suffix_array_dedup", repeated_passages),
    ("pii", personal_data),
    ("packing", packing),
]

#: Expectation-maximisation, connected components and the fitted trees have no DuckDB form; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = ws.store(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
