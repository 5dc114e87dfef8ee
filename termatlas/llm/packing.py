"""Packing into optimal length buckets.

A dynamic programme over the histogram of all lengths chooses the bucket boundaries that minimise padding; inside
a bucket, batches take as many rows as the token budget allows at the bucket's length. Lengths are exact up to
`exact`; beyond, they are counted in steps of 1/64 (each with its own longest length), so that the histogram has a
few thousand rows at any corpus size. Rows are numbered within shards of bounded size and offset by shard totals,
so that no bucket is ever sorted in one task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace

#: Words are runs of characters other than these.
WORD = r"[^\x20\x09-\x0D]++"


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null. Every character is read once, whatever runs of spaces there are."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def length_step(length: Column, exact: int = 1024) -> Column:
    """The histogram row of a length: itself up to `exact`, then the upper edge of a step of at least 1/64."""
    power = F.floor(F.log2(F.greatest(length, F.lit(1)).cast("double"))).cast("int")
    width = F.pow(F.lit(2.0), F.greatest(power - 6, F.lit(0)).cast("double")).cast("long")
    return F.when(length <= exact, length).otherwise((F.floor((length - 1) / width) + 1) * width)


def best_boundaries(longest: np.ndarray, count: np.ndarray, total: np.ndarray, buckets: int) -> list[int]:
    """Upper lengths of at most `buckets` buckets with the least padding.

    Rows are ascending histogram rows with their longest length, count and summed length. cost[j] holds the least
    padding of rows 0..j-1; a bucket over rows i..j-1 pads each of its texts to longest[j-1].
    """
    n = len(longest)
    if not n:
        return []
    c, t = np.concatenate(([0], np.cumsum(count))), np.concatenate(([0], np.cumsum(total)))
    cost = np.full(n + 1, np.inf)
    cost[0] = 0
    choice = []
    for _ in range(min(buckets, n)):
        now, back = np.full(n + 1, np.inf), np.zeros(n + 1, dtype=np.int64)
        now[0] = 0
        for j in range(1, n + 1):
            options = cost[:j] + (c[j] - c[:j]) * longest[j - 1] - (t[j] - t[:j])
            i = int(options.argmin())
            now[j], back[j] = options[i], i
        choice.append(back)
        cost = now
    out, j = [], n
    for back in reversed(choice):
        if not j:
            break
        out.append(int(longest[j - 1]))
        j = int(back[j])
    return out[::-1]


def pack(
    docs: DataFrame, length: Column | None = None, id_col: str = "doc_id", text_col: str = "text",
    buckets: int = 16, token_budget: int = 65536, exact: int = 1024, shard_rows: int = 20000,
) -> DataFrame:
    """(id, length, bucket, bucket_length, batch_id, slot, padding) for each row of docs.

    length defaults to the words of the text (null and empty: 0), and token_budget is in the unit of length: words by
    default, tokens if length holds token counts; null lengths count as 0. A batch of a bucket holds
    max(1, token_budget // bucket_length) rows, at most token_budget rows where the length is 0; a text longer than
    the budget has a batch of its own. Repeated and null ids stay rows of their own, ties go by id; an empty table gives an
    empty result; other columns of docs are ignored.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "packing")
    own = F.coalesce(length if length is not None else word_count(F.col(text_col)), F.lit(0)).cast("long")
    rows = ws.store(docs.select(F.col(id_col).alias("id"), own.alias("length")), "lengths")
    histogram = (
        rows.groupBy(length_step(F.col("length"), exact).alias("step"))
        .agg(F.max("length").alias("longest"), F.count("*").alias("n"), F.sum("length").alias("total"))
        .orderBy("step")
        .collect()  # at most exact + 64 rows for each doubling of the length
    )
    bounds = best_boundaries(
        np.array([r["longest"] for r in histogram], dtype=np.float64),
        np.array([r["n"] for r in histogram], dtype=np.float64),
        np.array([r["total"] for r in histogram], dtype=np.float64),
        buckets,
    ) or [0]
    bucket = F.lit(len(bounds) - 1)
    limit = F.lit(bounds[-1]).cast("long")
    for i in range(len(bounds) - 2, -1, -1):
        bucket = F.when(F.col("length") <= bounds[i], i).otherwise(bucket)
        limit = F.when(F.col("length") <= bounds[i], F.lit(bounds[i]).cast("long")).otherwise(limit)
    placed = rows.withColumn("bucket", bucket).withColumn("bucket_length", limit)

    shards = max(1, -(-sum(r["n"] for r in histogram) // shard_rows))
    placed = placed.withColumn("shard", F.pmod(F.xxhash64("id", "length"), F.lit(shards)).cast("int"))
    sizes = placed.groupBy("bucket", "shard").agg(F.count("*").alias("n"))
    # one row for each bucket and shard: a running total over rows / shard_rows numbers
    before = sizes.selectExpr(
        "bucket", "shard", "sum(n) over (partition by bucket order by shard) - n as before"
    )
    numbered = placed.selectExpr(
        "*", "row_number() over (partition by bucket, shard order by id, length) - 1 as local"
    )
    per_batch = F.greatest(F.lit(1), F.floor(F.lit(token_budget) / F.greatest(F.col("bucket_length"), F.lit(1)))).cast("long")
    place = F.col("before") + F.col("local")
    return numbered.join(before, ["bucket", "shard"]).select(
        F.col("id").alias(id_col),
        "length",
        "bucket",
        "bucket_length",
        F.concat(F.col("bucket"), F.lit("-"), F.floor(place / per_batch)).alias("batch_id"),
        F.pmod(place, per_batch).cast("long").alias("slot"),
        (F.col("bucket_length") - F.col("length")).alias("padding"),
    )
