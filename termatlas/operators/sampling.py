"""Seeded samples of paths and hits."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from termatlas.functions.text import stable_seed


def hash_sample(paths: DataFrame, k: int, base_seed: int) -> DataFrame:
    """k rows of each crawl by the smallest hash of seed and path: uniform, repeatable, whatever the input order.

    (crawl_id, path) -> crawl_id, sampled_wet_path, slot, seed; all of a crawl if it has fewer than k.
    """
    seed = stable_seed(F.col("crawl_id"), base_seed)
    keyed = paths.select("crawl_id", "path", seed.alias("seed")).withColumn("__h", F.sha2(F.concat_ws("|", F.col("seed").cast("string"), "path"), 256))
    slot = F.row_number().over(W.partitionBy("crawl_id").orderBy("__h", "path"))
    return keyed.withColumn("slot", slot).where(F.col("slot") <= k).select("crawl_id", F.col("path").alias("sampled_wet_path"), "slot", "seed")


def reservoir_sample(paths: DataFrame, k: int, base_seed: int, line: str = "line") -> DataFrame:
    """The sample that Algorithm R draws with Python's generator over the listing in `line` order.

    A crawl's listing is a single text file, which one task reads anyway; only k paths leave it.
    """

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("line", kind="stable")
        seed = int(pdf["seed"].iloc[0])
        chosen, rng = list(pdf["path"].iloc[:k]), random.Random(seed)
        for seen, path in enumerate(pdf["path"].iloc[k:], k):
            slot = rng.randint(0, seen)
            if slot < k:
                chosen[slot] = path
        return pd.DataFrame({"crawl_id": pdf["crawl_id"].iloc[0], "sampled_wet_path": chosen, "slot": range(1, len(chosen) + 1), "seed": seed})

    rows = paths.select("crawl_id", "path", F.col(line).alias("line"), stable_seed(F.col("crawl_id"), base_seed).alias("seed"))
    return rows.groupBy("crawl_id").applyInPandas(draw, "crawl_id string, sampled_wet_path string, slot int, seed long")


def manifest(sample: DataFrame, timestamp: str, base_url: str = "https://data.commoncrawl.org") -> DataFrame:
    """Manifest rows, all strings."""
    return sample.select(
        "crawl_id", "sampled_wet_path", F.concat_ws("/", F.lit(base_url), "sampled_wet_path").alias("source_url"),
        F.col("seed").cast("string").alias("seed"), F.lit(timestamp).alias("timestamp"),
    )


def download_names(rows: DataFrame, order: str) -> DataFrame:
    """Add file_name: the crawl and the row's place within it, in `order`."""
    place = F.row_number().over(W.partitionBy("crawl_id").orderBy(order))
    return rows.withColumn("file_name", F.format_string("%s_%03d.wet.gz", F.col("crawl_id"), place))


def hit_sample(hits: DataFrame, n: int, seed: int, key: tuple[str, ...]) -> DataFrame:
    """n hits by the smallest hash of seed and key; all of them if there are fewer."""
    h = F.sha2(F.concat_ws("|", F.lit(str(seed)), *(F.col(c).cast("string") for c in key)), 256)
    return hits.withColumn("__h", h).orderBy("__h", *key).limit(n).drop("__h")
