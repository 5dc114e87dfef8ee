"""Term matching: first match of each labelled pattern, disambiguation, snippets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termatlas.config import ScanConfig
from termatlas.functions import text as T


def long_enough(docs: DataFrame, min_chars: int) -> DataFrame:
    """Documents of at least min_chars code points; the raw text counts."""
    return docs.where(F.length("text") >= min_chars)


def _parts(docs: DataFrame, cfg: ScanConfig) -> DataFrame:
    return docs.withColumns({f"__p{p.ord}": T.first_split(F.col("text"), p.source) for p in cfg.patterns})


def with_matches(docs: DataFrame, cfg: ScanConfig, disambiguate: bool = True) -> DataFrame:
    """Add `matches`: array<struct<ord, label, start, end>> in pattern order, one at most for each pattern.

    Only the first occurrence of a pattern is looked at, also of an ambiguous one.
    """
    split = _parts(docs, cfg)
    spans = []
    for p in cfg.patterns:
        parts = F.col(f"__p{p.ord}")
        start, end = F.length(parts[0]), F.length("text") - F.length(parts[1])
        span = F.struct(F.lit(p.ord).alias("ord"), F.lit(p.label).alias("label"), start.alias("start"), end.alias("end"))
        found = F.size(parts) == 2
        if p.ambiguous and disambiguate:
            found = found & T.near(F.col("text"), start, end, cfg.window, cfg.needle)
        spans.append(F.when(found, span))
    none = F.expr("cast(array() as array<struct<ord:int,label:string,start:int,end:int>>)")
    matches = F.filter(F.array(*spans), lambda x: x.isNotNull()) if spans else none
    return split.withColumn("matches", matches).drop(*(f"__p{p.ord}" for p in cfg.patterns))


def match_rows(docs: DataFrame, cfg: ScanConfig, disambiguate: bool = True) -> DataFrame:
    """One row for each match: docs' columns with label_ord, matched_term, start and end."""
    matched = with_matches(docs, cfg, disambiguate)
    kept = [c for c in matched.columns if c != "matches"]
    # outer, then filtered above: a filter on the matches would be pushed down and find them all over again
    return matched.select(*kept, F.explode_outer("matches").alias("m")).where("m is not null").select(
        *kept, F.col("m.ord").alias("label_ord"), F.col("m.label").alias("matched_term"), F.col("m.start").alias("start"), F.col("m.end").alias("end")
    )


def hit_rows(docs: DataFrame, cfg: ScanConfig) -> DataFrame:
    """Uncapped hits: matches with their snippet, without the text."""
    rows = match_rows(docs, cfg)
    snippet = T.snippet(F.col("text"), F.col("start"), F.col("end"), cfg.window)
    return rows.withColumn("context_snippet", snippet).withColumn("text_len", F.length("text").cast("long")).drop("text")


HIT = ("label_ord", "matched_term", "start", "end", "context_snippet")


def with_hits(docs: DataFrame, cfg: ScanConfig) -> DataFrame:
    """One narrow row a document, short ones included: docs' columns without the text, with text_len and its hits.

    hits is an array of structs of HIT, uncapped and in pattern order; n_hits is its size.
    """
    sized = docs.withColumn("text_len", F.length("text").cast("long"))
    matched = with_matches(sized.withColumn("text", F.when(F.col("text_len") >= cfg.min_chars, F.col("text"))), cfg)
    hits = F.transform("matches", lambda m: F.struct(
        m["ord"].alias("label_ord"), m["label"].alias("matched_term"), m["start"].alias("start"), m["end"].alias("end"),
        T.snippet(F.col("text"), m["start"], m["end"], cfg.window).alias("context_snippet"),
    ))
    return matched.withColumn("hits", hits).withColumn("n_hits", F.size("hits").cast("long")).drop("text", "matches")


def exploded_hits(rows: DataFrame) -> DataFrame:
    """hit_rows from the rows of with_hits."""
    kept = [c for c in rows.columns if c not in ("hits", "n_hits")]
    return rows.select(*kept, F.explode("hits").alias("h")).select(*kept, *(F.col(f"h.{c}").alias(c) for c in HIT))
