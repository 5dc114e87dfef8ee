"""The scan over a landing folder of WET files, with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from termatlas.config import ScanConfig
from termatlas.functions.domains import with_registered_domain
from termatlas.functions.text import file_crawl
from termatlas.operators.matching import hit_rows, long_enough
from termatlas.sources.outputs import corpus_rows
from termatlas.sources.wet import batches, conversions


def stream_documents(spark: SparkSession, folder: str, files_per_trigger: int = 64) -> DataFrame:
    """Documents of the WET files that arrive in a folder, each file once."""
    import io

    from termatlas.sources.wet import SCHEMA

    def parse(stream):
        for batch in stream:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist(), strict=True):
                yield from batches(conversions(io.BytesIO(content), name))

    files = (
        spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
        .option("maxFilesPerTrigger", files_per_trigger).load(folder)
    )
    raw = files.selectExpr("element_at(split(path, '/'), -1) as name", "content").mapInArrow(parse, SCHEMA)
    return with_registered_domain(raw.withColumn("crawl_id", file_crawl(F.col("source_wet"))))


def stream_hits(docs: DataFrame, cfg: ScanConfig) -> DataFrame:
    """Uncapped hits as a stream: filter, match and snippet need no state."""
    return hit_rows(long_enough(docs, cfg.min_chars), cfg)


def append_hits(docs: DataFrame, cfg: ScanConfig, out: str, checkpoint: str) -> StreamingQuery:
    """Append the corpus rows of everything that has arrived and stop; the cap is taken over the stored corpus."""
    rows = stream_hits(docs, cfg)
    keyed = corpus_rows(rows).columns
    stored = rows.select(*(F.coalesce(c, F.lit("")).alias(c) if c in ("url", "warc_date") else F.col(c) for c in keyed), "record_idx", "label_ord")
    return stored.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def term_counts(docs: DataFrame, cfg: ScanConfig) -> DataFrame:
    """Running hits by term and crawl (state: a row for each pair)."""
    return stream_hits(docs, cfg).groupBy("crawl_id", "matched_term").agg(F.count("*").alias("hits"))
