"""A stand-in corpus over the driver's documents, whose texts hold none of the default terms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termatlas.config import ScanConfig, term_patterns
from termatlas.functions.domains import with_registered_domain

TERMS = {"adhd_patterns": [r"\bthat\b", r"\bth[-\s]?er\b"], "autism_patterns": [r"\bque\b", r"\bund\b"], "asd_pattern": r"\bof\b"}
CONFIG = ScanConfig(min_chars=500, domain_cap=5, window=60, needle="tion", patterns=term_patterns(TERMS), order=("record_idx",))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view: the language is the crawl, every seventh document has no URL.

    The driver's files hold one row group each; dealing the rows out lets all cores match.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    if len(docs.inputFiles()) < spark.sparkContext.defaultParallelism:
        docs = docs.repartition(spark.sparkContext.defaultParallelism)
    url = F.when(F.col("doc_id") % 7 != 0, F.concat(F.lit("http://www."), "source", F.lit(".com/"), F.col("doc_id").cast("string")))
    view = docs.select(
        F.col("lang").alias("crawl_id"), F.concat("lang", F.lit("_001.wet.gz")).alias("source_wet"), F.col("doc_id").alias("record_idx"),
        url.alias("url"), F.lit(None).cast("string").alias("warc_date"), "text",
    )
    return with_registered_domain(view)
