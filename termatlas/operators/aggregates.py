"""Counts, rates and rankings of a scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from termatlas.functions.text import rate, share


def enough(docs: DataFrame, min_chars: int) -> Column:
    """Whether a document is long enough, by its text_len where the text is gone."""
    return (F.col("text_len") if "text_len" in docs.columns else F.length("text")) >= min_chars


def funnel(docs: DataFrame, min_chars: int) -> DataFrame:
    """docs_scanned, docs_minlen and unique_domains_total (non-empty domains of documents that are long enough)."""
    long = enough(docs, min_chars)
    return docs.agg(
        F.count("*").alias("docs_scanned"),
        F.count_if(long).alias("docs_minlen"),
        F.count_distinct(F.when(long & (F.col("registered_domain") != ""), F.col("registered_domain"))).alias("unique_domains_total"),
        *([F.coalesce(F.sum("n_hits"), F.lit(0)).alias("hits_uncapped")] if "n_hits" in docs.columns else []),
    )


def hits_by_term(hits: DataFrame) -> DataFrame:
    return hits.groupBy("matched_term").agg(F.count("*").alias("hits"))


def first_seen(order: tuple[str, ...]) -> Column:
    return F.min(F.struct(*order, "label_ord"))


def json_counts(entries: Column) -> Column:
    """A JSON object of an array of structs (term, n), in order and with the spaces of Python's json module."""
    pairs = F.transform(entries, lambda x: F.concat(F.regexp_replace(F.to_json(F.array(x["term"])), r"^\[|\]$", ""), F.lit(": "), x["n"].cast("string")))
    return F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}"))


def hits_by_term_json(hits: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """One row: label -> count as JSON, keys as first seen."""
    terms = hits.groupBy("matched_term").agg(first_seen(order).alias("seen"), F.count("*").alias("n"))
    found = F.array_sort(F.collect_list(F.struct("seen", F.col("matched_term").alias("term"), "n")))  # a row for each label
    return terms.agg(json_counts(found).alias("hits_by_term"))


def decode_term_counts(rows: DataFrame, column: str = "hits_by_term") -> DataFrame:
    """(matched_term, hits) from such JSON; malformed text counts as no terms."""
    counts = F.coalesce(F.from_json(column, "map<string,bigint>"), F.expr("cast(map() as map<string,bigint>)"))
    return rows.select(F.explode(counts).alias("matched_term", "hits"))


def hits_per_domain(hits: DataFrame) -> DataFrame:
    return hits.where("registered_domain <> ''").groupBy("registered_domain").agg(F.count("*").alias("hits"))


def top_domains(hits: DataFrame, order: tuple[str, ...], k: int = 25) -> DataFrame:
    """The k domains with most hits, the earlier seen first among equals; `rank` keeps the order as data."""
    counted = hits.where("registered_domain <> ''").groupBy("registered_domain").agg(F.count("*").alias("hits"), first_seen(order).alias("seen"))
    best = counted.orderBy(F.desc("hits"), "seen").limit(k)
    rank = F.row_number().over(W.orderBy(F.desc("hits"), "seen"))  # over k rows
    return best.select(rank.alias("rank"), "registered_domain", "hits")


def with_share(top: DataFrame, total: DataFrame, k: int) -> DataFrame:
    """The first k of top with their share of total's one hits_total; the total includes hits without a domain."""
    return top.where(F.col("rank") <= k).crossJoin(F.broadcast(total)).select(
        "rank", "registered_domain", "hits", share(F.col("hits"), F.col("hits_total")).alias("share")
    )


def hit_summary(hits: DataFrame) -> DataFrame:
    return hits.agg(
        F.count("*").alias("hits_total"),
        F.count_distinct(F.when(F.col("registered_domain") != "", F.col("registered_domain"))).alias("unique_domains_hits"),
    )


def kept_metrics(kept: DataFrame, labels: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """hits_total, unique_domains_hits and hits_by_term of one pass; labels are the configured ones, a few."""
    of = {x: F.col("matched_term") == x for x in labels}
    row = kept.agg(
        F.count("*").alias("hits_total"),
        F.count_distinct(F.when(F.col("registered_domain") != "", F.col("registered_domain"))).alias("unique_domains_hits"),
        *(F.count_if(c).alias(f"n{i}") for i, c in enumerate(of.values())),
        *(F.min(F.when(c, F.struct(*order, "label_ord"))).alias(f"s{i}") for i, c in enumerate(of.values())),
    )
    found = F.array(*(F.struct(F.col(f"s{i}").alias("seen"), F.lit(x).alias("term"), F.col(f"n{i}").alias("n")) for i, x in enumerate(labels)))
    json = json_counts(F.array_sort(F.filter(found, lambda x: x["n"] > 0))) if labels else F.lit("{}")
    return row.select("hits_total", "unique_domains_hits", json.alias("hits_by_term"))


METRICS = ("docs_scanned", "docs_minlen", "hits_total", "hits_by_term", "unique_domains_total", "unique_domains_hits", "capped_removed")


def summary(docs: DataFrame, kept: DataFrame, min_chars: int, labels: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """(ord, metric, value): the run's metrics in their fixed order, values as strings; docs are rows of with_hits."""
    row = funnel(docs, min_chars).crossJoin(F.broadcast(kept_metrics(kept, labels, order)))  # single rows
    row = row.withColumn("capped_removed", F.col("hits_uncapped") - F.col("hits_total"))
    stack = ", ".join(f"{i}, '{m}', cast({m} as string)" for i, m in enumerate(METRICS))
    return row.selectExpr(f"stack({len(METRICS)}, {stack}) as (ord, metric, value)")


def hit_rate(funnel_row: DataFrame, hits_row: DataFrame) -> DataFrame:
    return funnel_row.crossJoin(F.broadcast(hits_row)).select(
        "hits_total", "docs_minlen", rate(F.col("hits_total"), F.col("docs_minlen")).alias("hit_rate")
    )


def cap_documents(hits: DataFrame, cap: int, order: tuple[str, ...]) -> DataFrame:
    """The cap counted in documents: hits of a domain's first cap documents that have any, each with all its hits."""
    own = F.when(F.col("registered_domain") == "", F.struct(*order))
    rank = F.dense_rank().over(W.partitionBy("crawl_id", "registered_domain", own).orderBy(*order))
    return hits.withColumn("__rank", rank).where(F.col("__rank") <= cap).drop("__rank")


def confident_documents(kept: DataFrame, key: tuple[str, ...], least: int = 2) -> DataFrame:
    """Documents with hits of at least `least` labels."""
    return kept.groupBy(*key).agg(F.count_distinct("matched_term").alias("n_terms")).where(F.col("n_terms") >= least)


def snippet_words(kept: DataFrame) -> DataFrame:
    """How often each word stands in a crawl's snippets: what the context of the terms is made of."""
    words = kept.select("crawl_id", F.explode(F.split(F.lower("context_snippet"), " ")).alias("word"))
    return words.where("word <> ''").groupBy("crawl_id", "word").agg(F.count("*").alias("n"))


def boilerplate_snippets(kept: DataFrame, least: int = 3) -> DataFrame:
    """(registered_domain, context_snippet, docs, hits): contexts that at least `least` documents of a domain share word
    for word, which menus, banners and footers do and running text does not."""
    seen = kept.where("registered_domain <> ''").groupBy("registered_domain", "context_snippet")
    return seen.agg(F.count_distinct("source_wet", "record_idx").alias("docs"), F.count("*").alias("hits")).where(F.col("docs") >= least)


def evaluation(docs: DataFrame, kept: DataFrame, labels: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """One row: how the documents with a kept hit agree with labels (key, wanted); documents without a label are left out."""
    hit = kept.select(*key).distinct().withColumn("__hit", F.lit(True))
    judged = docs.select(*key).join(labels, list(key)).join(hit, list(key), "left").select("wanted", F.coalesce("__hit", F.lit(False)).alias("hit"))
    count = lambda h, w: F.count_if((F.col("hit") == h) & (F.col("wanted") == w))
    row = judged.agg(
        count(True, True).alias("true_positive"), count(True, False).alias("false_positive"),
        count(False, True).alias("false_negative"), count(False, False).alias("true_negative"),
    )
    found = F.col("true_positive")
    return row.select(
        "*", rate(found, found + F.col("false_positive")).alias("precision"), rate(found, found + F.col("false_negative")).alias("recall"),
    )


def prevalence(docs: DataFrame, kept: DataFrame, min_chars: int) -> DataFrame:
    """Documents with a kept hit, hits and hit rate for each crawl."""
    base = docs.where(enough(docs, min_chars)).groupBy("crawl_id").agg(F.count("*").alias("docs_minlen"))
    found = kept.groupBy("crawl_id").agg(F.count("*").alias("hits"), F.count_distinct("source_wet", "record_idx").alias("docs_hit"))
    return base.join(found, "crawl_id", "left").select(
        "crawl_id", "docs_minlen", F.coalesce("hits", F.lit(0)).alias("hits"), F.coalesce("docs_hit", F.lit(0)).alias("docs_hit"),
        rate(F.coalesce("hits", F.lit(0)), F.col("docs_minlen")).alias("hit_rate"),
    )
