"""The registered queries over the stand-in corpus, and the same in DuckDB SQL."""

from __future__ import annotations

import uuid
from functools import lru_cache, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from termatlas.functions.domains import with_registered_domain
from termatlas.functions.text import file_crawl, stable_seed
from termatlas.operators import aggregates as A
from termatlas.operators import matching
from termatlas.operators import sampling as S
from termatlas.plans.scan import ScanResult, documents, scan
from termatlas.plans.standin import CONFIG, corpus, table
from termatlas.sources import manifest as M
from termatlas.sources.manifest import latest_of_names
from termatlas.sources.outputs import corpus_rows
from termatlas.sources.shared import shared_root
from termatlas.sources.wet import read_wet_from_store, write_wet

SEED, STAMP = 123, "2026-01-01T00:00:00Z"


def result(spark: SparkSession, sf_dir: str) -> ScanResult:
    return scan(corpus(spark, sf_dir), CONFIG)


def _long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.long_enough(corpus(spark, sf_dir), CONFIG.min_chars)


def scan_funnel(spark, sf_dir):
    return result(spark, sf_dir).funnel.select("docs_scanned", "docs_minlen")


def minlen_docs(spark, sf_dir):
    return _long(spark, sf_dir).select("record_idx", F.length("text").cast("long").alias("text_len"))


def crawl_id_from_name(spark, sf_dir):
    return corpus(spark, sf_dir).select("record_idx", file_crawl(F.col("source_wet")).alias("crawl_id"))


def registered_domain_pages(spark, sf_dir):
    return with_registered_domain(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "registered_domain")


def any_match_docs(spark, sf_dir):
    return matching.with_matches(_long(spark, sf_dir), CONFIG).where(F.size("matches") > 0).select("record_idx", F.size("matches").cast("long").alias("n_terms"))


def term_match_flags(spark, sf_dir):
    matched = matching.with_matches(_long(spark, sf_dir), CONFIG, disambiguate=False)
    found = F.transform("matches", lambda x: x["ord"])
    flags = [F.array_contains(found, p.ord).alias(f"m{p.ord}") for p in CONFIG.patterns]
    return matched.select("record_idx", *flags)


def first_match_spans(spark, sf_dir):
    rows = matching.match_rows(_long(spark, sf_dir), CONFIG, disambiguate=False)
    return rows.select("record_idx", "matched_term", F.col("start").cast("long").alias("span_start"), F.col("end").cast("long").alias("span_end"))


def ambiguous_disambiguated(spark, sf_dir):
    rows = matching.match_rows(_long(spark, sf_dir), CONFIG)
    return rows.where("matched_term = 'asd_pattern'").select("record_idx", F.col("start").cast("long").alias("span_start"))


def hits_uncapped(spark, sf_dir):
    return matching.match_rows(_long(spark, sf_dir), CONFIG).select("record_idx", "crawl_id", "registered_domain", "matched_term")


def context_snippets(spark, sf_dir):
    return result(spark, sf_dir).hits.select("record_idx", "matched_term", "context_snippet")


def hits_capped(spark, sf_dir):
    return result(spark, sf_dir).kept.select("record_idx", "crawl_id", "registered_domain", "matched_term", "context_snippet", "text_len")


def corpus_columns(spark, sf_dir):
    return corpus_rows(result(spark, sf_dir).kept)


def capped_count(spark, sf_dir):
    return result(spark, sf_dir).capped


def hits_total(spark, sf_dir):
    return result(spark, sf_dir).totals.select("hits_total")


def hits_by_term(spark, sf_dir):
    return result(spark, sf_dir).by_term


def unique_domains_total(spark, sf_dir):
    return result(spark, sf_dir).funnel.select("unique_domains_total")


def unique_domains_hits(spark, sf_dir):
    return result(spark, sf_dir).totals.select("unique_domains_hits")


def hits_per_domain(spark, sf_dir):
    return A.hits_per_domain(result(spark, sf_dir).kept)


def top25_domains(spark, sf_dir):
    return result(spark, sf_dir).top(25)


def summary_eav(spark, sf_dir):
    return result(spark, sf_dir).summary.select("metric", "value")


def hit_rate(spark, sf_dir):
    r = result(spark, sf_dir).stored()
    return A.hit_rate(r.funnel, r.totals)


def _shares(spark, sf_dir, k):
    r = result(spark, sf_dir).stored()
    return A.with_share(r.top(25), r.totals.select("hits_total"), k)


def top10_share(spark, sf_dir):
    return _shares(spark, sf_dir, 10)


def top20_share(spark, sf_dir):
    return _shares(spark, sf_dir, 20)


def top15_bars(spark, sf_dir):
    return result(spark, sf_dir).top(25).where("rank <= 15").select("rank", "registered_domain", "hits")


def hits_by_term_json(spark, sf_dir):
    return A.hits_by_term_json(result(spark, sf_dir).kept, CONFIG.order)


def hits_by_term_decoded(spark, sf_dir):
    return A.decode_term_counts(hits_by_term_json(spark, sf_dir))


def ambiguous_rows(spark, sf_dir):
    kept = corpus_rows(result(spark, sf_dir).kept)
    return kept.where("matched_term = 'asd_pattern'").select("matched_term", "registered_domain", "url", "context_snippet")


def seeded_hit_sample(spark, sf_dir):
    chosen = S.hit_sample(result(spark, sf_dir).kept, 25, SEED, ("record_idx", "label_ord"))
    return chosen.select("record_idx", "matched_term", "registered_domain", "context_snippet")


def stable_seeds(spark, sf_dir):
    crawls = corpus(spark, sf_dir).select("crawl_id").distinct()
    return crawls.select("crawl_id", stable_seed(F.col("crawl_id"), SEED).alias("seed"))


def _paths(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    path = F.concat(F.lit("crawl-data/"), "lang", F.lit("/segments/"), F.col("doc_id").cast("string"), F.lit(".wet.gz"))
    return docs.select(F.col("lang").alias("crawl_id"), F.col("doc_id").alias("line"), path.alias("path"))


def reservoir_native(spark, sf_dir):
    return S.hash_sample(_paths(spark, sf_dir), 2, SEED).select("crawl_id", "sampled_wet_path", F.col("slot").cast("long").alias("slot"))


def reservoir_exact(spark, sf_dir):
    return S.reservoir_sample(_paths(spark, sf_dir), 2, SEED)


def manifest_rows(spark, sf_dir):
    return S.manifest(S.hash_sample(_paths(spark, sf_dir), 2, SEED), STAMP)


def download_names(spark, sf_dir):
    named = S.download_names(_paths(spark, sf_dir), "line")
    return named.select("line", "file_name")


def latest_manifest(spark, sf_dir):
    names = table(spark, sf_dir, "events").select(F.concat(F.lit("cc_sample_"), F.date_format("ts", "yyyyMMdd_HHmmss"), F.lit(".jsonl")).alias("name"))
    return latest_of_names(names, "name", r"^(cc_sample_.*\.jsonl)$")


def latest_run(spark, sf_dir):
    names = table(spark, sf_dir, "events").select(F.concat(F.lit("cc_scan_summary_"), F.date_format("ts", "yyyyMMdd_HHmmss"), F.lit(".csv")).alias("name"))
    return latest_of_names(names, "name", r".*_(\d{8}_\d{6})\.(?:csv|parquet)$")


def validate_counts(spark, sf_dir):
    sampled = S.hash_sample(_paths(spark, sf_dir), 2, SEED)
    fetched = S.download_names(sampled.withColumnRenamed("sampled_wet_path", "path"), "slot")
    return sampled.agg(F.count("*").alias("n_sampled")).crossJoin(F.broadcast(fetched.agg(F.count_distinct("file_name").alias("n_files"))))


def prevalence_by_crawl(spark, sf_dir):
    r = result(spark, sf_dir).stored()
    return A.prevalence(r.docs, r.kept, CONFIG.min_chars).select("crawl_id", "docs_minlen", "hits", "hit_rate")


def hits_capped_by_document(spark, sf_dir):
    return A.cap_documents(result(spark, sf_dir).hits, CONFIG.domain_cap, CONFIG.order).select("record_idx", "matched_term")


def confident_documents(spark, sf_dir):
    return A.confident_documents(result(spark, sf_dir).kept, ("record_idx",), 2)


def snippet_words(spark, sf_dir):
    return A.snippet_words(result(spark, sf_dir).kept)


def _folder(spark: SparkSession, label: str) -> str:
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def corpus_roundtrip(spark, sf_dir):
    """The corpus written as Parquet and read again."""
    out = _folder(spark, "corpus")
    result(spark, sf_dir).kept.transform(corpus_rows).write.parquet(out)
    return spark.read.parquet(out)


def manifest_roundtrip(spark, sf_dir):
    """The manifest written as JSON lines and read again."""
    from termatlas.sources.manifest import MANIFEST

    out = _folder(spark, "manifest")
    manifest_rows(spark, sf_dir).write.json(out)
    return spark.read.schema(MANIFEST).option("mode", "FAILFAST").json(out)


#: WET files that the stand-in corpus is dealt into for each crawl.
WET_FILES = 8


def wet_scan(spark, sf_dir):
    """The stand-in corpus written as WET files and read back, with what the scan derives from a record."""
    place = W.partitionBy("source_wet").orderBy("doc")
    docs = corpus(spark, sf_dir).withColumnRenamed("record_idx", "doc")
    docs = docs.withColumn("source_wet", F.format_string("%s_%03d.wet.gz", "crawl_id", F.pmod("doc", F.lit(WET_FILES)) + 1))
    docs = docs.withColumn("record_idx", F.row_number().over(place) - 1).withColumn("warc_date", F.lit(STAMP))
    folder = _folder(spark, "wet")
    files = write_wet(docs, folder)
    files.agg(F.sum("records")).collect()
    rows = documents(read_wet_from_store(spark, f"{folder}/*.wet.gz"))
    return rows.select(
        "source_wet", "record_idx", "crawl_id", F.coalesce("url", F.lit("")).alias("url"), "warc_date", "registered_domain",
        F.length("text").cast("long").alias("text_len"), F.md5("text").alias("text_md5"),
    )


def listing_paths(spark, sf_dir):
    """Path listings with blank lines and white space around paths, written and read as a crawl's listing is."""
    folder = _folder(spark, "listing")
    lines = _paths(spark, sf_dir).select("crawl_id", F.concat(F.lit("  "), "path", F.lit("\t\u00a0")).alias("value"))
    blank = lines.select("crawl_id", F.lit(" \t").alias("value"))
    lines.union(blank).repartition("crawl_id").write.partitionBy("crawl_id").option("compression", "gzip").text(folder)
    crawls = sorted(r["crawl_id"] for r in spark.read.text(folder).select("crawl_id").distinct().collect())  # a few crawls
    parts = [M.read_listing(spark, f"{folder}/crawl_id={c}", c).select("crawl_id", "path") for c in crawls]
    return reduce(DataFrame.unionByName, parts)


def summary_roundtrip(spark, sf_dir):
    """The summary written as Parquet rows, read back, and as the table's cells: labels and thousands."""
    out = _folder(spark, "summary")
    result(spark, sf_dir).summary.write.parquet(out)
    rows = spark.read.parquet(out).where("metric <> 'hits_by_term'")
    return rows.select("metric", "value", F.format_number(F.col("value").cast("long"), 0).alias("cell"))


def top_domains_roundtrip(spark, sf_dir):
    """The domain table's rows, with shares to four decimals as text, over a CSV file."""
    out = _folder(spark, "top")
    _shares(spark, sf_dir, 10).select("registered_domain", "hits", F.format_string("%.4f", "share").alias("cell")).write.option("header", True).csv(out)
    return spark.read.schema("registered_domain string, hits long, cell string").option("header", True).csv(out)


def boilerplate_snippets(spark, sf_dir):
    return A.boilerplate_snippets(result(spark, sf_dir).kept, least=2)


def evaluation(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("record_idx"), (F.col("quality") == 1).alias("wanted"))
    docs = _long(spark, sf_dir).select("record_idx")
    return A.evaluation(docs, result(spark, sf_dir).kept, labels, ("record_idx",))


QUERIES = {
    f.__name__: f
    for f in (
        scan_funnel, minlen_docs, crawl_id_from_name, registered_domain_pages, any_match_docs, term_match_flags, first_match_spans,
        ambiguous_disambiguated, hits_uncapped, context_snippets, hits_capped, corpus_columns, capped_count, hits_total, hits_by_term,
        unique_domains_total, unique_domains_hits, hits_per_domain, top25_domains, summary_eav, hit_rate, top10_share, top20_share,
        top15_bars, hits_by_term_json, hits_by_term_decoded, ambiguous_rows, seeded_hit_sample, stable_seeds, reservoir_native,
        reservoir_exact, manifest_rows, manifest_roundtrip, download_names, latest_manifest, latest_run, validate_counts,
        corpus_roundtrip, prevalence_by_crawl, hits_capped_by_document, confident_documents, snippet_words,
        wet_scan, listing_paths, summary_roundtrip, top_domains_roundtrip, boilerplate_snippets, evaluation,
    )
}


# --- the same in DuckDB -------------------------------------------------------------------------

#: RE2 forms of the stand-in patterns, between consumed boundary characters.
RE2 = ("that", "th[-\\s]?er", "que", "und", "of")
VIEW = """v as (select lang as crawl_id, lang || '_001.wet.gz' as source_wet, doc_id as record_idx,
 case when doc_id % 7 <> 0 then 'http://www.' || source || '.com/' || doc_id end as url,
 case when doc_id % 7 <> 0 then source || '.com' else '' end as registered_domain, text, length(text) as text_len from documents),
d as (select * from v where text_len >= 500)"""


def _match(ord_: int, label: str, rx: str) -> str:
    whole = rf"(?is)^(.*?(?:^|[^\pL\pN_]))({rx})(?:[^\pL\pN_]|$)"
    return (
        f"select *, {ord_} as label_ord, '{label}' as matched_term, length(x.pre) as s, length(x.pre) + length(x.m) as e"
        f" from (select d.*, regexp_extract(text, '{whole}', ['pre', 'm']) as x from d) where x.m <> ''"
    )


@lru_cache(maxsize=1)
def _ctes() -> str:
    union = " union all ".join(_match(p.ord, p.label, rx) for p, rx in zip(CONFIG.patterns, RE2, strict=True))
    w, cap, last = CONFIG.window, CONFIG.domain_cap, CONFIG.patterns[-1].ord
    around = f"substr(text, greatest(s - {w}, 0) + 1, least(text_len, e + {w}) - greatest(s - {w}, 0))"
    return f"""with {VIEW}, allm as ({union}),
 h as (select *, trim(regexp_replace({around}, '[\\s\\x0b\\x1c-\\x1f\\x{{85}}\\p{{Z}}]+', ' ', 'g')) as context_snippet from allm
  where label_ord <> {last} or contains(lower({around}), '{CONFIG.needle}')),
 r as (select *, row_number() over (partition by crawl_id, registered_domain order by record_idx, label_ord) as rn from h),
 k as (select * from r where registered_domain = '' or rn <= {cap}),
 t as (select registered_domain, count(*) as hits, min(record_idx * 100 + label_ord) as seen from k where registered_domain <> '' group by 1),
 top as (select row_number() over (order by hits desc, seen) as rank, registered_domain, hits from t order by hits desc, seen limit 25),
 bt as (select matched_term, count(*) as hits, min(record_idx * 100 + label_ord) as seen from k group by 1),
 js as (select '{{' || string_agg('"' || matched_term || '": ' || hits, ', ' order by seen) || '}}' as j from bt)
"""


PATHS = "p as (select lang as crawl_id, doc_id as line, 'crawl-data/' || lang || '/segments/' || doc_id || '.wet.gz' as path from documents)"


def _seed(crawl: str = "crawl_id") -> str:
    return f"xor(cast(('0x' || substr(sha256({crawl}), 1, 8)) as bigint), {SEED})"


def _drawn() -> str:
    return f"""with {PATHS}, q as (select *, {_seed()} as seed from p),
 z as (select *, row_number() over (partition by crawl_id order by sha256(seed || '|' || path), path) as slot from q), s as (select * from z where slot <= 2)
"""


def oracle_sql() -> dict[str, str]:
    c = _ctes()
    share = "round_even(hits / (select count(*) from k)::double * 10000, 0) / 10000"
    out = {
        "scan_funnel": f"with {VIEW} select count(*) as docs_scanned, count(*) filter (text_len >= 500) as docs_minlen from v",
        "minlen_docs": f"with {VIEW} select record_idx, text_len from d",
        "crawl_id_from_name": f"with {VIEW} select record_idx, split_part(source_wet, '_', 1) as crawl_id from v",
        "registered_domain_pages": r"select page_id, regexp_extract(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1), '([^.]+\.[^.]+)$', 1) as registered_domain from pages",
        "any_match_docs": c + "select record_idx, count(*) as n_terms from h group by 1",
        "term_match_flags": c + "select d.record_idx, " + ", ".join(f"coalesce(bool_or(label_ord = {p.ord}), false) as m{p.ord}" for p in CONFIG.patterns) + " from d left join allm on d.record_idx = allm.record_idx group by 1",
        "first_match_spans": c + "select record_idx, matched_term, s as span_start, e as span_end from allm",
        "ambiguous_disambiguated": c + "select record_idx, s as span_start from h where matched_term = 'asd_pattern'",
        "hits_uncapped": c + "select record_idx, crawl_id, registered_domain, matched_term from h",
        "context_snippets": c + "select record_idx, matched_term, context_snippet from h",
        "hits_capped": c + "select record_idx, crawl_id, registered_domain, matched_term, context_snippet, text_len from k",
        "corpus_columns": c + "select crawl_id, source_wet, coalesce(url, '') as url, registered_domain, '' as warc_date, matched_term, context_snippet, text_len from k",
        "capped_count": c + f"select coalesce(sum(n - {CONFIG.domain_cap}), 0)::bigint as capped_removed from (select count(*) as n from h where registered_domain <> '' group by crawl_id, registered_domain) where n > {CONFIG.domain_cap}",
        "hits_total": c + "select count(*) as hits_total from k",
        "hits_by_term": c + "select matched_term, hits from bt",
        "unique_domains_total": f"with {VIEW} select count(distinct registered_domain) as unique_domains_total from d where registered_domain <> ''",
        "unique_domains_hits": c + "select count(*) as unique_domains_hits from t",
        "hits_per_domain": c + "select registered_domain, hits from t",
        "top25_domains": c + "select cast(rank as integer) as rank, registered_domain, hits from top",
        "summary_eav": c + """select * from (values
 ('docs_scanned', (select count(*) from v)::varchar), ('docs_minlen', (select count(*) from d)::varchar), ('hits_total', (select count(*) from k)::varchar),
 ('hits_by_term', coalesce((select j from js), '{}')), ('unique_domains_total', (select count(distinct registered_domain) from d where registered_domain <> '')::varchar),
 ('unique_domains_hits', (select count(*) from t)::varchar), ('capped_removed', ((select count(*) from h) - (select count(*) from k))::varchar)) x(metric, value)""",
        "hit_rate": c + "select a.n as hits_total, b.n as docs_minlen, coalesce(a.n / nullif(b.n, 0)::double, 0) as hit_rate from (select count(*) as n from k) a, (select count(*) as n from d) b",
        "top10_share": c + f"select cast(rank as integer) as rank, registered_domain, hits, {share} as share from top where rank <= 10",
        "top20_share": c + f"select cast(rank as integer) as rank, registered_domain, hits, {share} as share from top where rank <= 20",
        "top15_bars": c + "select cast(rank as integer) as rank, registered_domain, hits from top where rank <= 15",
        "hits_by_term_json": c + "select j as hits_by_term from js",
        "hits_by_term_decoded": c + "select matched_term, hits from bt",
        "ambiguous_rows": c + "select matched_term, registered_domain, coalesce(url, '') as url, context_snippet from k where matched_term = 'asd_pattern'",
        "seeded_hit_sample": c + f"select record_idx, matched_term, registered_domain, context_snippet from k order by sha256('{SEED}|' || record_idx || '|' || label_ord), record_idx, label_ord limit 25",
        "stable_seeds": f"with {VIEW} select distinct crawl_id, {_seed()} as seed from v",
        "reservoir_native": _drawn() + "select crawl_id, path as sampled_wet_path, slot from s",
        "manifest_rows": _drawn() + f"select crawl_id, path as sampled_wet_path, 'https://data.commoncrawl.org/' || path as source_url, seed::varchar as seed, '{STAMP}' as timestamp from s",
        "download_names": f"with {PATHS} select line, format('{{}}_{{:03d}}.wet.gz', crawl_id, row_number() over (partition by crawl_id order by line)) as file_name from p",
        "latest_manifest": "select max('cc_sample_' || strftime(ts, '%Y%m%d_%H%M%S') || '.jsonl') as latest from events",
        "latest_run": "select max(strftime(ts, '%Y%m%d_%H%M%S')) as latest from events",
        "validate_counts": _drawn() + "select count(*) as n_sampled, count(*) as n_files from s",
        "prevalence_by_crawl": c + "select d.crawl_id, d.n as docs_minlen, coalesce(x.hits, 0) as hits, coalesce(x.hits, 0) / d.n::double as hit_rate from (select crawl_id, count(*) as n from d group by 1) d left join (select crawl_id, count(*) as hits from k group by 1) x using (crawl_id)",
    }
    cap = CONFIG.domain_cap
    out["hits_capped_by_document"] = c + f", b as (select *, dense_rank() over (partition by crawl_id, registered_domain order by record_idx) as dr from h) select record_idx, matched_term from b where registered_domain = '' or dr <= {cap}"
    out["confident_documents"] = c + "select record_idx, count(*) as n_terms from k group by 1 having count(*) >= 2"
    out["snippet_words"] = c + ", w as (select crawl_id, unnest(string_split(lower(context_snippet), ' ')) as word from k) select crawl_id, word, count(*) as n from w where word <> '' group by 1, 2"
    out["wet_scan"] = f"""with {VIEW}, f as (select *, format('{{}}_{{:03d}}.wet.gz', crawl_id, record_idx % {WET_FILES} + 1) as file from v)
 select file as source_wet, row_number() over (partition by file order by record_idx) - 1 as record_idx, crawl_id, coalesce(url, '') as url, '{STAMP}' as warc_date,
 registered_domain, length(coalesce(text, '')) as text_len, md5(coalesce(text, '')) as text_md5 from f"""
    out["listing_paths"] = f"with {PATHS} select crawl_id, path from p"
    out["summary_roundtrip"] = f"select metric, value, format('{{:,}}', value::bigint) as cell from ({out['summary_eav']}) where metric <> 'hits_by_term'"
    out["top_domains_roundtrip"] = f"select registered_domain, hits, format('{{:.4f}}', share) as cell from ({out['top10_share']})"
    out["boilerplate_snippets"] = c + """, b as (select registered_domain, context_snippet, count(distinct (source_wet, record_idx)) as docs, count(*) as hits from k where registered_domain <> '' group by 1, 2)
 select * from b where docs >= 2"""
    out["evaluation"] = c + """, j as (select d.record_idx, l.quality = 1 as wanted, exists (select 1 from k where k.record_idx = d.record_idx) as hit from d join labels l on l.doc_id = d.record_idx)
 select count(*) filter (hit and wanted) as true_positive, count(*) filter (hit and not wanted) as false_positive, count(*) filter (not hit and wanted) as false_negative,
 count(*) filter (not hit and not wanted) as true_negative, coalesce(count(*) filter (hit and wanted) / nullif(count(*) filter (hit), 0)::double, 0) as precision,
 coalesce(count(*) filter (hit and wanted) / nullif(count(*) filter (wanted), 0)::double, 0) as recall from j"""
    out["corpus_roundtrip"] = out["corpus_columns"]
    out["manifest_roundtrip"] = out["manifest_rows"]
    return out
