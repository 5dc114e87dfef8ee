"""The scan as one lazily composed plan."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from termatlas.config import ScanConfig
from termatlas.functions.domains import with_registered_domain
from termatlas.functions.text import file_crawl
from termatlas.operators import aggregates as A
from termatlas.operators.cap import cap_hits, capped_removed
from termatlas.operators.matching import exploded_hits, hit_rows, long_enough, with_hits
from termatlas.sources.shared import shared_root
from termatlas.sources.wet import read_wet


def documents(raw: DataFrame) -> DataFrame:
    """WET rows with crawl_id and registered_domain."""
    return with_registered_domain(raw.withColumn("crawl_id", file_crawl(raw["source_wet"])))


@dataclass
class ScanResult:
    """Frames of one scan; nothing runs until one of them is used.

    Frames of one kind read the documents once. Outputs that need several (the summary, rates over all documents) take
    stored(), so that texts are read and matched once whatever the number of outputs.
    """

    docs: DataFrame
    cfg: ScanConfig
    path: str | None = None

    @cached_property
    def hits(self) -> DataFrame:
        return hit_rows(long_enough(self.docs, self.cfg.min_chars), self.cfg)

    @cached_property
    def kept(self) -> DataFrame:
        return cap_hits(self.hits, self.cfg.domain_cap, self.cfg.order)

    @property
    def funnel(self) -> DataFrame:
        return A.funnel(self.docs, self.cfg.min_chars)

    @property
    def by_term(self) -> DataFrame:
        return A.hits_by_term(self.kept)

    @property
    def totals(self) -> DataFrame:
        return A.hit_summary(self.kept)

    @property
    def capped(self) -> DataFrame:
        return capped_removed(self.hits, self.cfg.domain_cap)

    def top(self, k: int = 25) -> DataFrame:
        return A.top_domains(self.kept, self.cfg.order, k)

    @property
    def summary(self) -> DataFrame:
        own = self.stored()
        return A.summary(own.docs, own.kept, self.cfg.min_chars, tuple(p.label for p in self.cfg.patterns), self.cfg.order)

    def stored(self) -> ScanResult:
        """The same result over one narrow row a document, without texts, written below the shared folder."""
        if self.path:
            return self
        spark = self.docs.sparkSession
        path = f"{shared_root(spark)}/scan-{uuid.uuid4().hex[:12]}"
        with_hits(self.docs, self.cfg).write.parquet(path)
        rows = spark.read.parquet(path)
        out = ScanResult(rows.drop("hits"), self.cfg, path)
        out.__dict__["hits"] = exploded_hits(rows)
        return out

    def release(self) -> None:
        """Delete what stored() wrote, once nothing reads it any more."""
        if self.path:
            spark = self.docs.sparkSession
            p = spark._jvm.org.apache.hadoop.fs.Path(self.path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def scan(docs: DataFrame, cfg: ScanConfig) -> ScanResult:
    """docs: crawl_id, source_wet, record_idx, url, registered_domain, warc_date, text."""
    return ScanResult(docs, cfg)


def scan_wet(spark: SparkSession, path: str, cfg: ScanConfig) -> ScanResult:
    return scan(documents(read_wet(spark, path)), cfg)
