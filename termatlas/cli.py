"""Command line: cc-sample, cc-download, cc-scan, cc-export."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from termatlas.config import ScanConfig, load
from termatlas.operators import aggregates as A
from termatlas.operators.sampling import download_names, hash_sample, manifest, reservoir_sample
from termatlas.plans.scan import scan_wet
from termatlas.sources import manifest as M
from termatlas.sources import outputs as O

__all__ = ["download", "export", "main", "run_scan", "sample"]


def session() -> SparkSession:
    return SparkSession.builder.appName("termatlas").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def sample(spark: SparkSession, cfg: ScanConfig, folder: str = "data/manifests", listing: str = M.LISTING, exact: bool = True) -> str:
    """Sample every crawl's listing and write the manifest; returns its path. The config has to name a seed."""
    if cfg.seed is None:
        raise KeyError("project.seed")
    log = O.run_log("cc-sample", M.run_id())
    log.info("Crawls %s, %d files each, seed %d", ", ".join(cfg.crawl_ids), cfg.files_per_crawl, cfg.seed)
    drawn = None
    for crawl in cfg.crawl_ids:
        log.info("Sampling %s", crawl)
        local = M.fetch(listing.format(crawl=crawl), Path(folder) / "listings" / f"{crawl}.paths.gz")
        rows = M.read_listing(spark, str(local), crawl)
        own = (reservoir_sample if exact else hash_sample)(rows, cfg.files_per_crawl, cfg.seed)
        drawn = own if drawn is None else drawn.unionByName(own)
    path = M.write_manifest(manifest(drawn.orderBy("crawl_id", "slot"), M.timestamp()), folder)
    log.info("Wrote manifest %s", path)
    print(f"Sampled {M.read_manifest(spark, path).count()} WET files across {len(cfg.crawl_ids)} crawls.")
    return path


def download(spark: SparkSession, path: str, folder: str = "data/raw/wet") -> tuple[int, int]:
    """Fetch a manifest's files; returns the numbers of sampled and of fetched ones."""
    from pyspark.sql import functions as F

    log = O.run_log("cc-download", M.run_id())
    log.info("Loading manifest %s", path)
    rows = M.read_manifest(spark, path).withColumn("line", F.monotonically_increasing_id())
    sampled, fetched = rows.count(), M.download(download_names(rows, "line").orderBy("line"), folder, log)
    log.info("Downloaded %d files", fetched)
    print(f"Downloaded {fetched} WET files.")
    print(f"Validation: sampled {sampled} files; downloaded {fetched} files.")
    return sampled, fetched


def run_scan(spark: SparkSession, cfg: ScanConfig, wet: str = "data/raw/wet") -> Path:
    """Scan all WET files and write corpus, top domains and summary; returns the summary's path."""
    run = M.run_id()
    log = O.run_log("cc-scan", run)
    log.info("Min chars %d, domain cap %d, window %d", cfg.min_chars, cfg.domain_cap, cfg.window)
    result = scan_wet(spark, wet, cfg).stored()
    corpus = f"{cfg.out_dir}/cc_pilot_corpus_{run}.parquet"
    O.write_corpus(result.kept, corpus)
    top = O.write_rows(result.top(25).orderBy("rank"), ("registered_domain", "hits"), f"{cfg.out_dir}/cc_scan_top_domains_{run}.csv")
    out = O.write_summary(result.summary, str(top), f"{cfg.out_dir}/cc_scan_summary_{run}.csv")
    result.release()
    for what, path in (("summary", out), ("top domains", top), ("corpus", corpus)):
        log.info("Wrote %s %s", what, path)
    told = O.read_summary(spark, str(out))
    print("Scan complete: " + ", ".join(f"{k}={told[k]}" for k in ("docs_scanned", "docs_minlen", "hits_total", "unique_domains_hits")))
    return out


def export(spark: SparkSession, interim: str = "data/interim", reports: str = "reports") -> list[Path]:
    """LaTeX tables and the chart of the latest run."""
    from pyspark.sql import functions as F

    run = M.latest_run_id(interim)
    summary = O.read_summary(spark, f"{interim}/cc_scan_summary_{run}.csv")
    top = O.read_top_domains(spark, f"{interim}/cc_scan_top_domains_{run}.csv").coalesce(1).withColumn("rank", F.monotonically_increasing_id() + 1)
    total = spark.range(1).select(F.lit(int(summary.get("hits_total", 0))).alias("hits_total"))
    shares = A.with_share(top, total, 10).orderBy("rank").collect()
    out = []
    for name, text in (("TAB_stage1_pilot_summary", O.summary_table(summary)), ("TAB_stage1_top_domains", O.domains_table(shares))):
        path = Path(reports) / "tables" / f"{name}.tex"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text, encoding="utf-8")
        out.append(path)
    chart = O.bar_chart(O.term_counts(summary), f"{reports}/figures/FIG_stage1_hits_by_term.pdf")
    return out + ([chart] if chart else [])


#: Commands that stand for several.
GROUPS = {"cc-acquire": ("cc-sample", "cc-download"), "cc-pilot": ("cc-sample", "cc-download", "cc-scan"), "cc-stage1": ("cc-sample", "cc-download", "cc-scan", "cc-export")}


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="termatlas")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("cc-sample", "cc-download", "cc-scan", "cc-export", *GROUPS):
        command = commands.add_parser(name)
        command.add_argument("--config", default="configs/pilot.yaml")
        if name == "cc-download":
            command.add_argument("--manifest")
    args = parser.parse_args(argv)
    cfg, spark = load(args.config), session()
    for command in GROUPS.get(args.command, (args.command,)):
        if code := run_command(spark, cfg, command, getattr(args, "manifest", None)):
            return code
    return 0


def run_command(spark: SparkSession, cfg: ScanConfig, command: str, given: str | None = None) -> int:
    if command == "cc-sample":
        sample(spark, cfg)
    elif command == "cc-download":
        path = given or M.latest_manifest("data/manifests")
        if path is None:
            print("No manifest found in data/manifests. Run cc-sample first.")
            return 1
        download(spark, path)
    elif command == "cc-scan":
        run_scan(spark, cfg)
    else:
        export(spark, cfg.out_dir)
    return 0


if __name__ == "__main__":
    sys.exit(main())
