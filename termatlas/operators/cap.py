"""The per-domain cap: at most `cap` hits of a (crawl, domain), in scan order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEY = ("crawl_id", "registered_domain")


def cap_hits(hits: DataFrame, cap: int, order: tuple[str, ...]) -> DataFrame:
    """Hits within the cap; hits without a domain are never capped.

    Such a hit has a group of its own, so they neither meet in one partition nor need a second pass over the
    documents; group limits prune the rest to cap rows a key and task before the shuffle.
    """
    if cap <= 0:
        return hits.where("registered_domain = ''")
    own = F.when(F.col("registered_domain") == "", F.struct(*order, "label_ord"))
    rank = F.row_number().over(W.partitionBy(*KEY, own).orderBy(*order, "label_ord"))
    return hits.withColumn("__rank", rank).where(F.col("__rank") <= cap).drop("__rank")


def capped_removed(hits: DataFrame, cap: int) -> DataFrame:
    """The number of hits over the cap, by counts alone."""
    over = hits.where("registered_domain <> ''").groupBy(*KEY).count()
    return over.agg(F.coalesce(F.sum(F.greatest(F.col("count") - F.lit(max(cap, 0)), F.lit(0))), F.lit(0)).cast("long").alias("capped_removed"))
