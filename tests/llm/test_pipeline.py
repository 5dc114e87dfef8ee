import duckdb
import numpy as np
import pytest

import corpus_pipeline
from termatlas.llm import queries, simhash, suffix_dedup
from tests.llm.fixtures import documents
from tests.llm.test_texts import brute_pii, brute_quality, brute_similar

SF = "/root/testdata/sf0.001"


def test_stages_follow_each_other(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF).persist()
        assert out.columns == names, name
        assert out.count() <= docs.count()
        docs = out
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.count() == docs.count() == packed.select("doc_id").distinct().count()
    assert sorted(packed.collect()) == sorted(corpus_pipeline.run(spark, SF).collect())


def brute_passages(texts, span, words):
    """Texts without their runs of `words` whole words or more that repeated strings of span bytes cover."""
    raws, seen = [t.encode() for t in texts], {}
    for b in raws:
        for p in range(len(b) - span + 1):
            seen[b[p : p + span]] = seen.get(b[p : p + span], 0) + 1
    out = []
    for b in raws:
        cover = np.zeros(len(b) + 1, int)
        for p in range(len(b) - span + 1):
            if seen[b[p : p + span]] > 1:
                cover[p] += 1
                cover[p + span] -= 1
        edges = np.flatnonzero(np.diff(np.concatenate(([0], np.cumsum(cover) > 0)).astype(int)))
        kept, at = b"", 0
        for a, e in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if suffix_dedup.whole_words(b, a, e) >= words:
                kept, at = kept + b[at:a], e
        out.append((kept + b[at:]).decode("utf-8", "ignore"))
    return out


def brute_redacted(text):
    at, out = 0, ""
    for a, e, kind in sorted((a, e, k) for k, spans in brute_pii(text).items() for a, e in spans):
        if a >= at:
            out += text[at:a] + f"<{kind.upper()}>"
        at = max(at, e)
    return out + text[at:]


def test_stages_equal_brute_force(spark):
    """Each stage on what the one before kept, all but the model's own verdicts rebuilt in plain Python."""
    stage = dict(corpus_pipeline.STAGES)
    texts = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = stage["quality_rules"](spark, docs, SF).persist()
    before, kept = texts(docs), texts(good)
    for i, t in before.items():
        n, _, _, _, repeated = brute_quality(t) if len(t) < 3000 else (99, 0, 0, 0, 0)
        assert i not in kept or (n >= 20 and 100 * repeated <= 30 * n)
    single = stage["simhash_near_dedup"](spark, good, SF).persist()
    ids = sorted(kept)
    least = brute_similar([kept[i] for i in ids])
    assert sorted(texts(single)) == sorted({ids[k] for k in least})
    cut = stage["suffix_array_dedup"](spark, single, SF).persist()
    ids = sorted(texts(single))
    want = dict(zip(ids, brute_passages([kept[i] for i in ids], corpus_pipeline.PASSAGE_BYTES, corpus_pipeline.PASSAGE_WORDS), strict=True))
    assert texts(cut) == want and want != {i: kept[i] for i in ids}
    clean = texts(stage["pii"](spark, cut, SF))
    assert clean == {i: brute_redacted(t) for i, t in want.items()} and clean != want


def test_near_copies_are_found(spark):
    """Recall against all pairs over the larger table: at least 0.99 of the pairs at a similarity of 0.8 share a group."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    group = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(docs).collect()}
    rows = [(r["doc_id"], simhash.shingles((r["text"] or "").encode())) for r in docs.collect()]
    found = total = 0
    for k, (i, a) in enumerate(rows):
        for j, b in rows[:k]:
            if min(a.size, b.size) >= 0.8 * max(a.size, b.size) > 0:
                both = np.intersect1d(a, b, assume_unique=True).size
                if both >= 0.8 * (a.size + b.size - both):
                    total += 1
                    found += group[i] == group[j]
    assert total > 50 and found >= 0.99 * total, (found, total)


def test_stages_take_awkward_rows(spark):
    docs = documents(spark).selectExpr("doc_id", "text", "cast(null as string) lang", "cast(null as string) source", "cast(null as long) n_chars")
    for rows in (docs, docs.limit(0), docs.union(docs)):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, rows, SF).count()


def test_every_operator_is_registered():
    names = queries.queries()
    assert {n.split("_")[0] for n in names} == {f"op{i}" for i in range(1, 11)} | {"pipeline", "pii", "quality"}
    assert set(queries.oracle_sql()) <= set(names)


@pytest.mark.parametrize("name", ["op1_embedding_dedup", "op4_html_extract", "op6_warc", "op9_suffix_dedup", "pii_base", "quality_counts"])
def test_query_equals_its_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        duck.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = duck.sql(queries.oracle_sql()[name])
    columns = sorted(want.columns)
    got = queries.queries()[name](spark, SF)
    assert sorted(got.columns) == columns
    places = [want.columns.index(c) for c in columns]
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr) == sorted((tuple(r[i] for i in places) for r in want.fetchall()), key=repr)
