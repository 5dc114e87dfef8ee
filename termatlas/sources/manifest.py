"""Path listings, manifests, run files and downloads."""

from __future__ import annotations

import logging
import os
import re
import shutil
import time
import urllib.request
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termatlas.functions.text import strip

#: The manifest's fields, the listings' place, and the names of a run's files.
MANIFEST = "crawl_id string, sampled_wet_path string, source_url string, seed string, timestamp string"
LISTING = "https://data.commoncrawl.org/crawl-data/{crawl}/wet.paths.gz"
RUN_FILE = re.compile(r".*_(\d{8}_\d{6})\.(csv|parquet)$")


def timestamp() -> str:
    return time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())


def run_id() -> str:
    return time.strftime("%Y%m%d_%H%M%S", time.gmtime())


def fetch(url: str, target: str | Path, chunk: int = 1 << 20) -> Path:
    """Copy a URL (http, https or file) to a local file, replacing it."""
    target = Path(target)
    target.parent.mkdir(parents=True, exist_ok=True)
    with urllib.request.urlopen(url) as source, target.open("wb") as out:
        shutil.copyfileobj(source, out, chunk)
    return target


def read_listing(spark: SparkSession, path: str, crawl_id: str) -> DataFrame:
    """(crawl_id, line, path) of a plain or gzipped listing; blank lines are dropped."""
    rows = spark.read.text(path).select(F.monotonically_increasing_id().alias("line"), strip(F.col("value")).alias("path"))
    return rows.where("path <> ''").select(F.lit(crawl_id).alias("crawl_id"), "line", "path")


def write_manifest(rows: DataFrame, folder: str) -> str:
    """One JSON-lines file, named by the run; returns its path. A manifest has a few rows a crawl."""
    target = Path(folder) / f"cc_sample_{run_id()}.jsonl"
    target.parent.mkdir(parents=True, exist_ok=True)
    lines = rows.select(F.to_json(F.struct(*(f.split()[0] for f in MANIFEST.split(", ")))).alias("j")).toLocalIterator()
    target.write_text("".join(r["j"] + "\n" for r in lines), encoding="utf-8")
    return str(target)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Manifest rows in file order; blank lines are skipped, anything else that is not JSON raises."""
    return spark.read.schema(MANIFEST).option("mode", "FAILFAST").json(path)


def latest_manifest(folder: str) -> str | None:
    names = sorted(Path(folder).glob("cc_sample_*.jsonl")) if os.path.isdir(folder) else []
    return str(names[-1]) if names else None


def latest_run_id(folder: str) -> str:
    found = sorted(m[1] for p in Path(folder).glob("cc_scan_summary_*.csv") if (m := RUN_FILE.match(p.name)))
    if not found:
        raise FileNotFoundError(f"no scan summary in {folder}")
    return found[-1]


def latest_of_names(names: DataFrame, column: str, pattern: str) -> DataFrame:
    """The greatest first group of pattern among file names, as one row."""
    got = F.regexp_extract(F.col(column), pattern, 1)
    return names.where(got != "").agg(F.max(got).alias("latest"))


def download(rows: DataFrame, folder: str, log: logging.Logger | None = None) -> int:
    """Fetch named manifest rows one after the other; returns how many."""
    n = 0
    for r in rows.toLocalIterator():
        if log:
            log.info("Downloading %s -> %s", r["source_url"], Path(folder) / r["file_name"])
        fetch(r["source_url"], Path(folder) / r["file_name"])
        n += 1
    return n
