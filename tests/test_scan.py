import os
import random

import pytest
from pyspark.sql import functions as F

from termatlas.config import ScanConfig, from_dict, load, term_patterns
from termatlas.functions import regex
from termatlas.functions import text as T
from termatlas.operators import aggregates as A
from termatlas.operators import matching
from termatlas.plans.scan import scan
from termatlas.plans.standin import CONFIG, corpus
from tests import interpreter

SF = "/root/testdata/sf0.001"
DOC = "crawl_id string, source_wet string, record_idx long, url string, registered_domain string, warc_date string, text string"


def frame(spark, docs):
    rows = [(d["crawl_id"], d["crawl_id"] + "_001.wet.gz", d["record_idx"], None, d["registered_domain"], None, d["text"]) for d in docs]
    return spark.createDataFrame(rows, DOC)


def cfg(**terms):
    return ScanConfig(min_chars=0, window=200, patterns=term_patterns(terms), order=("record_idx",))


def labels(spark, text, c):
    docs = frame(spark, [{"crawl_id": "c", "record_idx": 0, "registered_domain": "", "text": text}])
    return [r["matched_term"] for r in matching.match_rows(docs, c).orderBy("label_ord").collect()]


def test_labels_of_both_lists(spark):
    c = cfg(adhd_patterns=[r"\badhd\b"], autism_patterns=["autism"])
    assert labels(spark, "This discusses ADHD and autism in brief.", c) == ["adhd_patterns[0]", "autism_patterns[0]"]


@pytest.mark.parametrize(
    "text, window, kept",
    [
        ("ASD is mentioned here, and autism appears later nearby.", 100, True),
        ("ASD is mentioned here. " + "x" * 300 + " autism", 50, False),
        ("ASD far. " + "x" * 300 + " ASD next to autism", 50, False),  # only the first occurrence counts
        ("asd, AUTISM", 20, True),
        ("ASD and autistic", 50, False),
    ],
)
def test_ambiguous_term_needs_its_needle(spark, text, window, kept):
    assert bool(labels(spark, text, cfg(asd_pattern=r"\bASD\b").with_(window=window))) is kept


@pytest.mark.parametrize(
    "pattern, text",
    [
        (r"\badhd\b", t) for t in ("éadhd", "adhdé", "ADHD", "x adhd.", "_adhd", "𝒜adhd", "adhd9")
    ]
    + [(r"attention[-\s]?deficit", f"attention{c}deficit") for c in ("-", " ", "\xa0", " ", "\x1c", "", "\n", "_", "​")]
    + [(r"\bASD\b", t) for t in ("aſd", "ASD́", "ASD‍", "asd x", "(ASD)")]
    + [("autism", "AUTİSM"), (r"a\sb", "a\x85b"), (r"\bx|y\b", "xyz y"), (r"\w+!", "né!"), (r"[\w-]+@", "é-a@")],
)
def test_regex_has_pythons_meaning(spark, pattern, text):
    import re

    m = re.search(pattern, text, re.I)
    got = spark.createDataFrame([(text,)], "text string").select(T.first_split(F.col("text"), pattern).alias("p")).first()["p"]
    assert (m is not None) == (got is not None and len(got) == 2)
    if m:
        assert (len(got[0]), len(text) - len(got[1])) == m.span()


@pytest.mark.parametrize("bad", ["(?P<x>a)", "a*", r"\b", r"(?(1)a|b)", r"a\Z"])
def test_unsupported_regex_is_refused(bad):
    with pytest.raises(ValueError):
        regex.to_java(bad)


def test_snippet_strips_and_collapses(spark):
    text = "\t a \x1c b\n\nASD  c "
    rows = spark.createDataFrame([(text,)], "text string")
    at = text.index("ASD")
    got = rows.select(T.snippet(F.col("text"), F.lit(at), F.lit(at + 3), 50).alias("s")).first()["s"]
    assert got == " ".join(text.split())


def random_docs(seed, n=120):
    rng = random.Random(seed)
    words = ["that", "thér", "ther", "th-er", "que", "QUE", "und", "of", "tion", "éof", "of tion", "x", "\n", "日本", "😀", "th er"]
    return [
        {"crawl_id": rng.choice(["en", "de"]), "record_idx": i, "registered_domain": rng.choice(["", "a.com", "b.com"]), "text": " ".join(rng.choices(words, k=rng.randint(0, 25)))}
        for i in range(n)
    ]


@pytest.mark.parametrize("cap", [0, 3, 50])
def test_scan_equals_sequential_rules(spark, cap):
    docs = random_docs(cap)
    c = CONFIG.with_(min_chars=30, domain_cap=cap, window=12)
    kept, out = interpreter.scan(docs, c)
    r = scan(frame(spark, docs), c)
    got = sorted((x["record_idx"], x["matched_term"], x["start"], x["end"], x["context_snippet"]) for x in r.kept.collect())
    assert got == sorted(kept)
    assert r.capped.first()[0] == out["capped_removed"]
    f = r.funnel.first()
    assert (f["docs_scanned"], f["docs_minlen"], f["unique_domains_total"]) == (out["docs_scanned"], out["docs_minlen"], len(out["domains"]))
    assert {x["matched_term"]: x["hits"] for x in r.by_term.collect()} == dict(out["by_term"])
    assert [(x["registered_domain"], x["hits"]) for x in r.top().orderBy("rank").collect()] == out["top"].most_common(25)
    assert r.totals.first()["unique_domains_hits"] == len(out["hit_domains"])


def test_golden_values(spark):
    r = scan(corpus(spark, SF), CONFIG)
    got = {x["metric"]: x["value"] for x in r.summary.collect()}
    assert (got["docs_scanned"], got["docs_minlen"], got["hits_total"], got["capped_removed"]) == ("200", "178", "193", "70")
    assert (got["unique_domains_total"], got["unique_domains_hits"]) == ("20", "20")
    top = [(x["registered_domain"], x["hits"]) for x in r.top(6).orderBy("rank").collect()]
    assert top == [("src8.com", 11), ("src11.com", 10), ("src2.com", 9), ("src5.com", 9), ("src16.com", 9), ("src0.com", 9)]


def test_no_hits(spark):
    docs = frame(spark, [{"crawl_id": "c", "record_idx": 0, "registered_domain": "", "text": "nothing"}])
    r = scan(docs, CONFIG.with_(min_chars=1))
    assert r.kept.count() == 0 and r.top().count() == 0
    assert {x["metric"]: x["value"] for x in r.summary.collect()}["hits_by_term"] == "{}"
    assert A.hit_rate(r.funnel, r.totals).first()["hit_rate"] == 0.0
    bad = spark.createDataFrame([("not json",)], "hits_by_term string")
    assert A.decode_term_counts(bad).count() == 0


def test_share_rounds_halves_to_even(spark):
    row = spark.createDataFrame([(29, 728), (5, 0), (797, 20000)], "a long, b long")
    assert [r[0] for r in row.select(T.share(F.col("a"), F.col("b"))).collect()] == [0.0398, 0.0, 0.0398]


def test_config_needs_filters_and_terms():
    with pytest.raises(KeyError):
        from_dict({"terms": {}})
    c = from_dict({"filters": {"min_chars": 1, "domain_cap": 2, "asd_disambiguation_window_chars": 3}, "terms": {"autism_patterns": ["a"], "asd_pattern": "b"}})
    assert [p.label for p in c.patterns] == ["autism_patterns[0]", "asd_pattern"] and c.out_dir == "data/interim"


def test_the_pilot_config():
    c = load(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "configs", "pilot.yaml"))
    assert (c.seed, c.files_per_crawl, c.min_chars, c.domain_cap, c.window) == (123, 2, 500, 50, 200) and len(c.crawl_ids) == 2
    assert [p.source for p in c.patterns if p.ambiguous] == [r"\bASD\b"] and len(c.patterns) == 6
    assert all(regex.to_java(p.source) for p in c.patterns)


def test_summary_reads_texts_once(spark):
    r = scan(corpus(spark, SF), CONFIG).stored()
    plan = r.summary._jdf.queryExecution().executedPlan().toString()
    assert "documents.parquet" not in plan and "text" not in r.docs.columns
    assert {tuple(x) for x in r.summary.collect()} == {tuple(x) for x in scan(corpus(spark, SF), CONFIG).summary.collect()}
    r.release()


def test_filters_reach_the_scan_and_the_cap_prunes(spark):
    plan = scan(corpus(spark, SF), CONFIG).kept._jdf.queryExecution().executedPlan().toString()
    assert plan.count("RLIKE") <= len(CONFIG.patterns) + 1  # each pattern is sought once
    assert "WindowGroupLimit" in plan and "PythonUDF" not in plan and "ArrowEvalPython" not in plan
