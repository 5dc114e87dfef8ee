import gzip
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from termatlas import cli
from termatlas.config import from_dict
from termatlas.functions import domains
from termatlas.functions.domains import with_registered_domain
from termatlas.functions.text import stable_seed
from termatlas.operators import sampling as S
from termatlas.plans.scan import scan_wet
from termatlas.sources import manifest as M
from termatlas.sources import outputs as O
from termatlas.sources.wet import read_wet, read_wet_from_store
from termatlas.streaming.landing import append_hits, stream_documents


def record(kind, block, uri=None, date="2016-10-20T00:00:00Z"):
    head = [f"WARC-Type: {kind}", f"WARC-Date: {date}", f"Content-Length: {len(block)}"]
    if uri:
        head.append(f"WARC-Target-URI: {uri}")
    return ("WARC/1.0\r\n" + "\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


ASD = "ASD and autism: " + "x" * 20
RECORDS = [
    record("warcinfo", b"software: x\r\n"),
    record("conversion", "ADHD \N{GRINNING FACE} text".encode(), "http://www.example.co.uk/a"),
    record("conversion", b"bad \xff\xfe byte ADHD", None),
    record("response", b"HTTP/1.1 200 OK\r\n\r\nADHD", "http://x.com"),
    record("conversion", ASD.encode(), "http://foo.blogspot.com/"),
]


@pytest.fixture
def wet(tmp_path):
    folder = tmp_path / "wet"
    folder.mkdir()
    (folder / "CC-MAIN-2016-44_001.wet.gz").write_bytes(b"".join(map(gzip.compress, RECORDS)))
    (folder / "CC-MAIN-2026-04_001.wet.gz").write_bytes(gzip.compress(b"".join(RECORDS[:2])))
    return str(folder)


def test_wet_records(spark, wet):
    rows = read_wet(spark, wet).orderBy("source_wet", "record_idx").collect()
    assert [(r["source_wet"][:15], r["record_idx"]) for r in rows] == [("CC-MAIN-2016-44", 0), ("CC-MAIN-2016-44", 1), ("CC-MAIN-2016-44", 2), ("CC-MAIN-2026-04", 0)]
    assert rows[0]["text"] == "ADHD \N{GRINNING FACE} text" and rows[1]["text"] == "bad  byte ADHD" and rows[1]["url"] is None
    assert sorted(map(tuple, read_wet_from_store(spark, wet).collect()), key=str) == sorted(map(tuple, rows), key=str)


def test_missing_and_truncated_files(spark, tmp_path):
    with pytest.raises(Exception, match="no WET files"):
        read_wet(spark, str(tmp_path)).count()
    (tmp_path / "a_001.wet.gz").write_bytes(gzip.compress(RECORDS[1])[:-12])
    with pytest.raises(Exception, match="ends inside"):
        read_wet(spark, str(tmp_path)).count()


@pytest.mark.parametrize(
    "url, domain",
    [
        ("https://sub.example.co.uk/path", "example.co.uk"), ("http://www.example.com/page", "example.com"), (None, ""), ("", ""),
        ("http://192.168.0.1/x", ""), ("http://localhost:80/", ""), ("http://user:pw@a.b.example.org:8080/?q", "example.org"),
        ("//cdn.example.net/x", "example.net"), ("example.de", "example.de"), ("http://co.uk/", ""), ("http://foo.blogspot.com/", "blogspot.com"),
        ("http://a.b.c.ck/", "b.c.ck"), ("http://x.www.ck/", "www.ck"), ("http://c.ck/", ""), ("http://[::1]/", ""), ("http://Sub.Example.COM./", "Example.COM"),
        ("http://x.unknownsuffix/", ""),
    ],
)
def test_registered_domain(spark, url, domain):
    row = with_registered_domain(spark.createDataFrame([(url,)], "url string")).first()
    assert row["registered_domain"] == domain


def test_suffix_list_does_not_depend_on_where_jars_lie(spark, tmp_path, monkeypatch):
    whole = domains.suffix_list(spark)
    monkeypatch.setattr(domains.pyspark, "__file__", str(tmp_path / "elsewhere" / "__init__.py"))
    monkeypatch.delenv("SPARK_HOME", raising=False)
    assert domains.suffix_list(spark) == whole and ("co.uk", "normal") in domains.suffix_rules(whole)
    assert with_registered_domain(spark.createDataFrame([("http://a.b.co.uk",)], "url string")).first()["registered_domain"] == "b.co.uk"
    monkeypatch.setattr(domains, "_from_class_path", lambda _: [])
    with pytest.raises(FileNotFoundError, match=domains.SETTING):
        domains.suffix_list(spark)
    own = tmp_path / "own.dat"
    own.write_text("// mine\nlocal.zz\n*.yy\n!x.yy\n")
    spark.conf.set(domains.SETTING, str(own))
    try:
        assert domains.suffix_rules(domains.suffix_list(spark)) == (("local.zz", "normal"), ("x.yy", "exception"), ("yy", "wildcard"))
    finally:
        spark.conf.unset(domains.SETTING)


def test_suffix_list_of_the_jars(spark):
    assert max(domains._from_jars(), key=lambda x: (len(x), x)) == domains.suffix_list(spark)


def test_domain_lookup_does_not_shuffle(spark):
    plan = with_registered_domain(spark.range(5).select(F.concat(F.lit("http://a.c"), F.col("id").cast("string")).alias("url")))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") == 1


def test_stable_seed(spark):
    rows = spark.createDataFrame([("CC-MAIN-2016-44",), ("CC-MAIN-2026-04",)], "c string").select(stable_seed(F.col("c"), 123)).collect()
    assert [r[0] for r in rows] == [2761436742, 3142416645]


def listing(spark, n=50):
    return spark.createDataFrame([(c, i, f"{c}/{i}") for c in ("a", "b") for i in range(n)] + [("small", 0, "small/0")], "crawl_id string, line long, path string")


def test_reservoir_modes(spark):
    exact = {}
    for r in S.reservoir_sample(listing(spark), 3, 7).orderBy("crawl_id", "slot").collect():
        exact.setdefault(r["crawl_id"], []).append((r["sampled_wet_path"], r["seed"]))
    for crawl in ("a", "b"):
        rng, chosen = random.Random(exact[crawl][0][1]), []
        for i in range(50):
            if i < 3:
                chosen.append(f"{crawl}/{i}")
            elif (j := rng.randint(0, i)) < 3:
                chosen[j] = f"{crawl}/{i}"
        assert [p for p, _ in exact[crawl]] == chosen
    assert [p for p, _ in exact["small"]] == ["small/0"]
    drawn = S.hash_sample(listing(spark), 3, 7).groupBy("crawl_id").count().collect()
    assert {r["crawl_id"]: r["count"] for r in drawn} == {"a": 3, "b": 3, "small": 1}


def test_manifest_round_trip_and_latest(spark, tmp_path):
    assert M.latest_manifest(str(tmp_path / "none")) is None
    rows = S.manifest(S.hash_sample(listing(spark), 2, 7), "2026-01-01T00:00:00Z")
    path = M.write_manifest(rows, str(tmp_path))
    assert M.latest_manifest(str(tmp_path)) == path
    with open(path, "a") as f:
        f.write("\n")
    assert sorted(map(tuple, M.read_manifest(spark, path).collect())) == sorted(map(tuple, rows.collect()))
    with open(path, "a") as f:
        f.write("not json\n")
    with pytest.raises(Exception):
        M.read_manifest(spark, path).collect()
    names = S.download_names(listing(spark, 2), "line").orderBy("crawl_id", "line").collect()
    assert [r["file_name"] for r in names] == ["a_001.wet.gz", "a_002.wet.gz", "b_001.wet.gz", "b_002.wet.gz", "small_001.wet.gz"]


def test_listing_strips_unicode_space(spark, tmp_path):
    path = tmp_path / "wet.paths.gz"
    path.write_bytes(gzip.compress("x/1\n\n  x/2 \n".encode()))
    assert [r["path"] for r in M.read_listing(spark, str(path), "c").orderBy("line").collect()] == ["x/1", "x/2"]


def test_command_line_end_to_end(spark, wet, tmp_path, monkeypatch, capsys):
    monkeypatch.chdir(tmp_path)
    cfg = from_dict({
        "project": {"seed": 123, "out_dir": str(tmp_path / "interim")}, "pilot": {"crawl_ids": ["CC-MAIN-2016-44"]}, "sampling": {"wet_files_per_crawl": 1},
        "filters": {"min_chars": 5, "domain_cap": 50, "asd_disambiguation_window_chars": 200},
        "terms": {"adhd_patterns": [r"\badhd\b"], "autism_patterns": [r"\bautism\b"], "asd_pattern": r"\bASD\b"},
    })
    listing_file = tmp_path / "CC-MAIN-2016-44.gz"
    listing_file.write_bytes(gzip.compress(f"{wet}/CC-MAIN-2016-44_001.wet.gz\n".encode()))
    path = cli.sample(spark, cfg, str(tmp_path / "manifests"), listing=f"file://{tmp_path}/{{crawl}}.gz")
    row = json.loads(open(path).readline())
    row["source_url"] = f"file://{wet}/CC-MAIN-2016-44_001.wet.gz"
    with open(path, "w") as f:
        f.write(json.dumps(row) + "\n")
    assert cli.download(spark, path, str(tmp_path / "raw")) == (1, 1)
    assert os.listdir(tmp_path / "raw") == ["CC-MAIN-2016-44_001.wet.gz"]
    out = cli.run_scan(spark, cfg, str(tmp_path / "raw"))
    summary = O.read_summary(spark, str(out))
    assert summary["docs_scanned"] == "3" and summary["hits_total"] == "4"
    assert json.loads(summary["hits_by_term"]) == {"adhd_patterns[0]": 2, "autism_patterns[0]": 1, "asd_pattern": 1}
    assert json.dumps(json.loads(summary["hits_by_term"])) == summary["hits_by_term"]
    told = capsys.readouterr().out
    assert "Sampled 1 WET files across 1 crawls." in told and "Downloaded 1 WET files." in told and "Validation: sampled 1 files; downloaded 1 files." in told
    assert "Scan complete: docs_scanned=3, docs_minlen=3, hits_total=4, unique_domains_hits=2" in told
    logs = {p.name.split("_")[0]: p.read_text() for p in (tmp_path / "reports" / "logs").iterdir()}
    assert set(logs) == {"cc-sample", "cc-download", "cc-scan"} and "Wrote corpus" in logs["cc-scan"] and "| INFO | Downloading" in logs["cc-download"]
    with pytest.raises(KeyError, match="project.seed"):
        cli.sample(spark, cfg.with_(seed=None))
    corpus = O.read_corpus(spark, next(str(p) for p in (tmp_path / "interim").glob("cc_pilot_corpus_*.parquet")))
    assert tuple(corpus.columns) == O.CORPUS and corpus.where("url = ''").count() == 1
    tables = cli.export(spark, str(tmp_path / "interim"), str(tmp_path / "reports"))
    text = tables[0].read_text() + tables[1].read_text()
    assert r"Hits total & 4 \\" in text and r"blogspot.com & 2 & 0.5000 \\" in text and r"1.333 \\" in text
    assert M.latest_run_id(str(tmp_path / "interim")) in str(out)


def test_empty_corpus_keeps_its_columns(spark, wet, tmp_path):
    cfg = from_dict({"filters": {"min_chars": 5, "domain_cap": 50, "asd_disambiguation_window_chars": 9}, "terms": {"adhd_patterns": ["zzz"]}})
    O.write_corpus(scan_wet(spark, wet, cfg).kept, str(tmp_path / "c"))
    got = O.read_corpus(spark, str(tmp_path / "c"))
    assert tuple(got.columns) == O.CORPUS and got.count() == 0
    assert "0.000" in O.summary_table({"hits_total": "0", "docs_minlen": "0"})


def test_landing_stream_appends_each_file_once(spark, wet, tmp_path):
    cfg = from_dict({"filters": {"min_chars": 5, "domain_cap": 50, "asd_disambiguation_window_chars": 200}, "terms": {"adhd_patterns": [r"\badhd\b"]}})
    for _ in range(2):
        append_hits(stream_documents(spark, wet), cfg, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
