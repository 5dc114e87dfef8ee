"""Run outputs: corpus, summary, top domains, LaTeX tables, chart, log."""

from __future__ import annotations

import csv
import json
import logging
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The corpus' columns in order; below, the tables' labels, the CSV files' headers and the log's format.
CORPUS = ("crawl_id", "source_wet", "url", "registered_domain", "warc_date", "matched_term", "context_snippet", "text_len")


def corpus_rows(hits: DataFrame) -> DataFrame:
    """The corpus' eight columns; absent urls and dates are ''."""
    filled = {c: F.coalesce(c, F.lit("")).alias(c) for c in ("url", "warc_date")}
    return hits.select(*(filled.get(c, F.col(c)) for c in CORPUS))


def write_corpus(hits: DataFrame, path: str) -> None:
    corpus_rows(hits).write.mode("overwrite").parquet(path)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_rows(rows: DataFrame, header: tuple[str, ...], path: str) -> Path:
    """A small CSV file in row order."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    with target.open("w", newline="", encoding="utf-8") as f:
        out = csv.writer(f)
        out.writerow(header)
        out.writerows([r[c] for c in header] for r in rows.select(*header).toLocalIterator())
    return target


def write_summary(summary: DataFrame, top_domains_path: str, path: str) -> Path:
    """metric,value rows in their order, the top-domain file's path last."""
    last = summary.sparkSession.range(1).select(F.lit(1 << 30).alias("ord"), F.lit("top_domains_csv").alias("metric"), F.lit(top_domains_path).alias("value"))
    return write_rows(summary.unionByName(last).orderBy("ord"), ("metric", "value"), path)


def read_summary(spark: SparkSession, path: str) -> dict[str, str]:
    rows = spark.read.schema("metric string, value string").option("header", True).option("escape", '"').csv(path)
    return rows.agg(F.map_from_entries(F.collect_list(F.struct("metric", "value"))).alias("m")).first()["m"]


def read_top_domains(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("registered_domain string, hits long").option("header", True).csv(path)


def thousands(value: object) -> str:
    return f"{int(value):,}"


def latex_table(columns: str, header: list[str], rows: list[list[str]]) -> str:
    """A booktabs table; cell text is taken as it is."""
    line = lambda cells: " & ".join(cells) + r" \\"
    body = [rf"\begin{{tabular}}{{{columns}}}", r"\toprule", line(header), r"\midrule", *map(line, rows), r"\bottomrule", r"\end{tabular}"]
    return "\n".join(body) + "\n"


def summary_table(summary: dict[str, str]) -> str:
    hits, docs = int(summary.get("hits_total", 0)), int(summary.get("docs_minlen", 0))
    count = lambda k: thousands(summary.get(k, 0))
    return latex_table("lr", ["Metric", "Value"], [
        ["Docs scanned", count("docs_scanned")],
        ["Docs >= min chars", count("docs_minlen")],
        ["Hits total", count("hits_total")],
        ["Hit rate (hits / docs >= min chars)", f"{hits / docs if docs else 0.0:.3f}"],
        ["Unique domains (all)", count("unique_domains_total")],
        ["Unique domains (hits)", count("unique_domains_hits")],
        ["Capped removed", count("capped_removed")],
    ])


def domains_table(shares: list) -> str:
    return latex_table("lrr", ["Domain", "Hits", "Share"], [[r["registered_domain"], str(r["hits"]), f"{r['share']:.4f}"] for r in shares])


def term_counts(summary: dict[str, str]) -> dict[str, int]:
    """The chart's data; malformed JSON gives none."""
    try:
        return json.loads(summary.get("hits_by_term", "{}"))
    except json.JSONDecodeError:
        return {}


def bar_chart(counts: dict[str, int], path: str) -> Path | None:
    """Hits by term as a PDF; None where no plotting library is installed."""
    try:
        import matplotlib
    except ImportError:
        return None
    matplotlib.use("Agg")
    from matplotlib import pyplot

    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    figure, axes = pyplot.subplots(figsize=(6, 3))
    axes.bar(list(counts), list(counts.values()))
    axes.set_ylabel("Hits")
    axes.set_title("Hits by term")
    axes.tick_params(axis="x", rotation=30)
    figure.tight_layout()
    figure.savefig(target)
    pyplot.close(figure)
    return target


def run_log(command: str, stamp: str, folder: str = "reports/logs") -> logging.Logger:
    """A command's logger, to stderr and to a file of the run."""
    path = Path(folder) / f"{command}_{stamp}.log"
    path.parent.mkdir(parents=True, exist_ok=True)
    log = logging.getLogger(f"{command}.{path}")
    log.setLevel(logging.INFO)
    log.propagate = False
    for old in list(log.handlers):
        old.close()
        log.removeHandler(old)
    for handler in (logging.StreamHandler(sys.stderr), logging.FileHandler(path, encoding="utf-8")):
        handler.setFormatter(logging.Formatter("%(asctime)s | %(levelname)s | %(message)s"))
        log.addHandler(handler)
    log.info("Logging to %s", path)
    return log
