import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from termatlas.llm import packing, pii, quality_rules, simhash, suffix_dedup
from termatlas.llm.common import Workspace, connected_components
from tests.llm.fixtures import documents, texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- components ---------------------------------------------------------------------------------


def test_components_equal_union_find(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 60)] + [(rng.randint(100, 180), rng.randint(100, 180)) for _ in range(60)] + [(500, 1), (7, 7)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = connected_components(Workspace(spark, "t"), spark.createDataFrame(edges, "u long, v long")).collect()
    want = {x: find(x) for e in edges if e[0] != e[1] for x in e}
    assert len(got) == len(want) and {r["node"]: r["component"] for r in got} == want


# --- op 7 ---------------------------------------------------------------------------------------


def brute_quality(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    marked = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            marked.update(range(i, i + 8))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(marked)


def test_quality_counts(spark):
    docs = [(i, t) for i, t in enumerate(texts()) if t is None or len(t) < 5000]
    docs += [(90, "a b c d e f g h i a b c d e f g h"), (91, "x | y\nx | y\n\nx | y #"), (92, "one two " * 30), (93, "a\x1cb\x85c d\xa0e")]
    got = {r["doc_id"]: r for r in quality_rules.score_quality(documents(spark, docs)).collect()}
    for i, t in docs:
        r, want = got[i], brute_quality(t)
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want, (i, t)
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r["base_failed"] and r["kept"])


def test_quality_verdict_on_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality_rules.score_quality(docs).join(labels, "doc_id").collect()
    judged = [r for r in rows if not r["base_failed"]]
    clean, poor = [r["kept"] for r in judged if r["quality"]], [r["kept"] for r in judged if not r["quality"]]
    assert np.mean(clean) > 0.99 and np.mean(poor) < 0.2


def test_accuracies_of_simulated_rules():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.8
    right = rng.random((4000, 5)) < np.array([0.95, 0.9, 0.85, 0.9, 0.95])
    votes = np.where(right, np.where(truth, 1, -1)[:, None], np.where(truth, -1, 1)[:, None]) * (rng.random((4000, 5)) < 0.8)
    model = quality_rules.fit_accuracies(votes, np.ones(4000))
    score = model["prior"] + (votes == 1) @ np.array(model["good"]) + (votes == -1) @ np.array(model["bad"])
    assert ((score > 0) == truth).mean() > 0.95 and abs(model["p_good"] - 0.8) < 0.05


def test_quality_edges(spark):
    empty = documents(spark).limit(0)
    assert quality_rules.score_quality(empty).count() == 0
    docs = documents(spark)
    kept = quality_rules.keep_good(docs)
    verdict = {r["doc_id"] for r in quality_rules.score_quality(docs).where("kept").collect()}
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == verdict
    twice = docs.union(docs)
    assert quality_rules.score_quality(twice).count() == twice.count()


# --- op 10 --------------------------------------------------------------------------------------


def brute_fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, radius):
    ids = sorted(fps)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= radius and find(a) != find(b):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash_of_awkward_texts(spark):
    docs = documents(spark)
    fps = {i: brute_fingerprint(t) for i, t in enumerate(texts())}
    want = brute_components(fps, 4)
    got = simhash.near_duplicates(docs).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"], r["kept"]) for r in got} == {i: (f"{fps[i]:016x}", want[i], want[i] == i) for i in fps}
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    assert simhash.near_duplicates(docs.union(docs)).count() == 2 * len(fps)
    assert simhash.keep_one(docs).columns == docs.columns


@pytest.mark.parametrize("block", [8192, 16])
def test_links_between_fingerprints(spark, block):
    """Clusters, chains and a dense group, over all block sizes."""
    rng = random.Random(block)
    fps = [rng.getrandbits(64) for _ in range(150)]
    for f in fps[:40]:
        for _ in range(3):
            fps.append(f ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 6))))
    dense = rng.getrandbits(64)
    fps += [dense ^ sum(1 << b for b in rng.sample(range(20), rng.randint(0, 4))) for _ in range(120)]
    fps = sorted(set(fps))
    rows = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    ws = Workspace(spark, "t")
    joined = connected_components(ws, simhash.link_fingerprints(ws, rows, 4, block)).collect()
    got = {}
    for r in joined:
        got.setdefault(r["component"], set()).add(r["node"] % (1 << 64))
    want = {}
    for i, c in brute_components(dict(enumerate(fps)), 4).items():
        want.setdefault(c, set()).add(fps[i])
    assert sorted(map(sorted, got.values())) == sorted(sorted(x) for x in want.values() if len(x) > 1)


def test_large_runs_take_the_dense_path():
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(3)]
    fps = np.array([b ^ sum(1 << x for x in rng.sample(range(64), rng.randint(0, 3))) for b in base for _ in range(250)], dtype=np.uint64)
    child, root = simhash.link_rows(np.zeros(len(fps), np.int64), fps, 4)
    want = brute_components(dict(enumerate(map(int, fps))), 4)
    from termatlas.llm.common import forest

    got = forest(len(fps), child, root)
    pairs = {(a, b) for a, b in zip(got.tolist(), want.values(), strict=True)}
    assert len(pairs) == len(set(want.values())) == len(set(got.tolist()))


def test_thresholds_satisfy_the_pigeonhole():
    rng = np.random.default_rng(1)
    bits = rng.random((5000, 64)) < rng.random(64)
    bits[:, 10:14] = bits[:, [10]]
    both = bits.T.astype(float) @ bits
    groups = simhash.group_bits(5000, both, 4)
    assert sorted(b for g in groups for b in g) == list(range(64))
    assert any(set(range(10, 14)) <= set(g) for g in groups)
    for n in (10, 10**5, 10**8):
        plan = simhash.plan_probes(n, both * (n / 5000), 4)
        assert sum(e + 1 for _, e in plan) == 5


def test_similar_documents(spark):
    """Light copies join their original, heavy rewrites and unrelated texts do not, whatever the block size."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    rows, group = [], {}
    for g in range(30):
        base = [word() for _ in range(300)]
        for copy in range(5):
            words = list(base)
            for at in rng.sample(range(300), (0, 2, 3, 4, 150)[copy]):
                words[at] = word()
            group[len(rows)] = (g, copy)
            rows.append((len(rows), " ".join(words)))
    rows += [(900, None), (901, ""), (902, "one"), (903, "one")]
    for block in (8192, 8):
        got = {r["doc_id"]: r for r in simhash.similar_documents(documents(spark, rows), block=block).collect()}
        for i, (g, copy) in group.items():
            assert got[i]["component_id"] == (i if copy == 4 else 5 * g), (i, g, copy)
        assert got[901]["component_id"] == 900 and got[903]["component_id"] == 902 and not got[903]["kept"]
    assert simhash.similar_documents(documents(spark).limit(0)).count() == 0


def brute_similar(texts, similarity=0.8):
    sets = []
    for t in texts:
        w = t.lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    least = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]):
                a, b = sorted((least[i], least[j]))
                least = [a if x == b else x for x in least]
    return least


def test_similar_documents_are_verified(spark):
    """Pairs under the similarity stay apart, also texts inside longer ones, chains and texts with repeated shingles."""
    rng = random.Random(12)
    prose = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n)]
    rows = []
    for n in (195, 205, 214, 235, 240, 260, 270, 285) * 12:  # of 300: similarities of 0.65 to 0.95
        base = prose(300)
        rows += [base, base[:n]]
        rows.append(base[: n + (300 - n) // 2] + prose((300 - n) // 2))
        rows.append(base[:n] * 6)
    rows = [" ".join(r) for r in rows]
    want = brute_similar(rows)
    assert 100 < len(set(want)) < 350
    for block in (1024, 2):
        got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(documents(spark, list(enumerate(rows))), verify_block=block).collect()}
        wrong = [i for i in range(len(rows)) if got[i] != want[i]]
        assert all(got[i] >= want[i] for i in wrong) and len(wrong) <= len(rows) // 50, wrong  # none joined, few missed


def test_copies_with_null_and_repeated_ids(spark):
    """A repeated id's texts are judged apart; null ids give way to others and stay where there is no other."""
    rng = random.Random(14)
    a, b, c, d = (" ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(80)) for _ in range(4))
    rows = [(3, a), (5, a), (5, b), (None, b), (None, c), (None, c + " tail"), (7, d), (7, d), (8, "A " + d.upper())]
    for t in (documents(spark, rows), documents(spark, rows[:0])):
        kept = sorted(((r["doc_id"] or 0, r["text"]) for r in simhash.keep_one(t).collect()))
        assert kept == sorted([(3, a), (5, b), (0, c), (0, c + " tail"), (7, d), (7, d)] if t.count() else [])
    got = {(r["doc_id"], r["component_id"]) for r in simhash.similar_documents(documents(spark, rows)).collect()}
    assert {(3, 3), (5, 3), (5, 5), (None, 5), (None, None), (7, 7), (8, 7)} == got
    assert simhash.near_duplicates(documents(spark, rows)).where("kept is null").count() == 0


def test_jaccard_forest_equals_brute_force():
    rng = random.Random(13)
    rows = [" ".join(rng.choice("ab") for _ in range(rng.randint(5, 40))) for _ in range(150)]
    assert simhash.jaccard_forest([simhash.shingles(t.encode()) for t in rows], 0.8).tolist() == brute_similar(rows)


def test_similar_plan_reaches_its_recall():
    x = np.random.default_rng(0).random((3000, 64)) < 0.5
    both = x.T.astype(float) @ x
    change = simhash.bit_change(0.8)
    for n in (100, 10**6, 10**9):
        miss = 1.0
        for _, bits, e in simhash.plan_similar(n, [both * (n / 3000)] * 4, change, 0.99):
            import math

            miss *= 1 - sum(math.comb(len(bits), i) * change**i * (1 - change) ** (len(bits) - i) for i in range(e + 1))
        assert miss <= 0.01


# --- op 9 ---------------------------------------------------------------------------------------


def brute_repeats(rows, span):
    seen = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - span + 1):
            seen[b[p : p + span]] = seen.get(b[p : p + span], 0) + 1
    out = []
    for i, t in rows:
        b = (t or "").encode()
        cut = np.zeros(len(b) + 1, int)
        for p in range(len(b) - span + 1):
            if seen[b[p : p + span]] > 1:
                cut[p] += 1
                cut[p + span] -= 1
        gone = np.cumsum(cut)[:-1] > 0
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((i, len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def repeats_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=str)


def repeat_rows(seed):
    """Passages just over and under the span, shared in parts, in random surroundings, many times."""
    rng = random.Random(seed)
    letters = lambda n: "".join(rng.choice("abcé") for _ in range(n))
    shared = letters(70)
    rows = [(i, letters(rng.randint(0, 60)) + shared[rng.randint(0, 30) : rng.randint(35, 70)] + letters(rng.randint(0, 60))) for i in range(40)]
    return rows + [(50, "ab" * 100), (51, "a" * 90), (52, "a" * 41), (53, None), (54, ""), (55, letters(300) * 2), (56, shared), (57, shared), (None, shared + letters(9)), (None, "é" * 30 + shared)]


@pytest.mark.parametrize("seed, bucket", [(0, 1 << 16), (1, 1 << 16), (2, 4), (3, 1)])
def test_repeats_equal_brute_force(spark, seed, bucket):
    rows = repeat_rows(seed)
    assert repeats_of(suffix_dedup.remove_repeats(documents(spark, rows), span=40, gram=8, bucket=bucket)) == brute_repeats(rows, 40)


def test_repeats_at_full_span(spark):
    rows = list(enumerate(texts()))
    docs = documents(spark, rows)
    assert repeats_of(suffix_dedup.remove_repeats(docs)) == brute_repeats(rows, 400)
    cut = suffix_dedup.cut_repeats(docs)
    assert cut.columns == docs.columns and cut.where("text is null").count() == 1
    assert suffix_dedup.remove_repeats(docs.limit(0)).count() == 0
    twice = suffix_dedup.remove_repeats(documents(spark, rows + rows))
    assert twice.count() == 2 * len(rows) and twice.where("n_bytes >= 400 and n_removed < n_bytes").count() == 0


@pytest.mark.parametrize("bucket", [1 << 16, 2])
def test_one_array_serves_two_spans(spark, bucket):
    rows = repeat_rows(4)
    both = suffix_dedup.remove_repeats(documents(spark, rows), span=60, gram=8, bucket=bucket, passage_span=40, passage_words=0).persist()
    assert repeats_of(both) == brute_repeats(rows, 60)
    want = {}
    for i, _, _, n, _ in brute_repeats(rows, 40):
        want.setdefault(i, []).append(n)
    have = {}
    for r in both.collect():
        have.setdefault(r["doc_id"], []).append(r["n_passages"])
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}


def test_copies_between_two_spans_are_kept(spark):
    """Copies shorter than the span are no repeats of it, though the passages' shorter span finds them."""
    rng = random.Random(16)
    own = lambda n: "".join(rng.choice("abcdefghij klmnop") for _ in range(n))
    texts = [own(n) for n in (239, 240, 281, 399, 400, 401)]
    rows = [(i, t) for i, t in enumerate(texts + texts + [own(30) + texts[3] + own(30)])]
    got = suffix_dedup.remove_repeats(documents(spark, rows), gram=48, passage_span=240, passage_words=0).persist()
    assert repeats_of(got) == brute_repeats(rows, 400)
    assert {r["doc_id"]: r["n_removed"] for r in got.collect()} == {i: len(t) if len(t) in (400, 401) else 0 for i, t in rows}
    assert {r["doc_id"]: r["n_passages"] for r in got.collect()} == {i: int(len(t) > 239) for i, t in rows}


def test_short_runs_stay(spark):
    """Runs of fewer whole words than asked for are no passages."""
    rng = random.Random(15)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    own = lambda n: " ".join(word() for _ in range(n))
    long, short = own(51), own(50)
    rows = [(i, f"{own(30)} {x} {own(30)}") for i, x in enumerate([long, long, short, short])] + [(4, long), (5, None)]
    got = {r["doc_id"]: r["text"] for r in suffix_dedup.cut_repeats(documents(spark, rows), span=240, gram=48, least_words=51).collect()}
    assert all(long not in got[i] and len(got[i].split()) in (60, 59) for i in (0, 1)) and got[4] == "" and got[5] is None
    assert [got[2], got[3]] == [rows[2][1], rows[3][1]]
    assert suffix_dedup.whole_words(b"ab cd ef", 1, 8) == 2 and suffix_dedup.whole_words(b"ab cd ef", 0, 5) == 2 and suffix_dedup.whole_words(b"abc", 1, 2) == 0


def test_multikey_sort():
    rng = random.Random(5)
    strings = [bytes(rng.choice(b"\0ab") for _ in range(rng.randint(0, 30))) for _ in range(300)]
    group = np.array([rng.randint(0, 3) for _ in strings])
    size = np.array(list(map(len, strings)))
    order, lcp = suffix_dedup.multikey_sort(suffix_dedup.as_tokens(strings, 30), group, size)
    assert sorted(order.tolist()) == list(range(300))
    for k in range(1, 300):
        a, b = order[k - 1], order[k]
        assert group[a] <= group[b]
        common = 0
        if group[a] == group[b]:
            while common < min(size[a], size[b]) and strings[a][common] == strings[b][common]:
                common += 1
        assert lcp[k] == common


# --- op 3 ---------------------------------------------------------------------------------------

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else (int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) for i, c in enumerate(reversed(d))) % 10 == 0


def brute_pii(text):
    out = {}
    for k, rx in BASE.items():
        out[k] = []
        for m in re.finditer(rx, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": k != "ip" or all(int(p) <= 255 for p in m[0].split(".")), "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[k]
            if ok:
                out[k].append(m.span())
    return out


def test_base_spans_equal_pythons(spark):
    rng = random.Random(6)
    parts = ["a@b.co", "x.y@z", "@", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (443) 555-5793", "+12", "é", "🎉", " ", "_", ".", "-",
             "0" * 14, "999999999999999999999999.1.1.1", "a@b.c_d@e.f", "%", "007.008.009.010", "4242424242424242", "+49 30 123456 ", "(", "x"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(1, 25)))) for i in range(400)] + [(1000 + i, t) for i, t in enumerate(texts())]
    got = {r["doc_id"]: r for r in pii.pii_digest(documents(spark, rows)).collect()}
    for i, t in rows:
        spans = brute_pii(t)
        joined = ",".join(f"{k}:{a}:{b}" for k, v in spans.items() for a, b in v)
        r = got[i]
        assert tuple(r[f"n_{k}"] for k in BASE) == tuple(map(len, spans.values())), t
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert set(filter(None, joined.split(","))) <= set(r["spans"].split(",")) and r["n_pii"] == len(list(filter(None, r["spans"].split(","))))


def test_long_runs_of_digits(spark):
    card = "4111 1111 1111 1111"
    rows = [(0, "1" * 100_000), (1, "12 " * 50_000), (2, "1-2 " * 50_000), (3, "1 23\n" * 20_000 + card), (4, f"{card}  " + "7 " * 100_000)]
    got = {r["doc_id"]: r for r in pii.pii_digest(documents(spark, rows)).collect()}
    for i, t in rows:
        joined = ",".join(f"card:{m.start()}:{m.end()}" for m in re.finditer(card, t))
        assert got[i]["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest(), i
    assert [got[i]["n_card"] for i in range(5)] == [0, 0, 0, 1, 1]


def test_long_runs_of_every_alphabet(spark):
    """A million characters that a pattern's loops run through, alone and before a match."""
    n = 1_000_000
    runs = ["1" * n, "a" * n, "a." * (n // 2), "1 " * (n // 2), "1-" * (n // 2), "+1" + " " * n, "+1" + "(" * n, "a@" + "b." * (n // 2), "a@" + "-" * n, "(at)" * (n // 4), " at " * (n // 4)]
    runs += ["1." * 4000, "f:" * 4000]  # many matches: their lists are built by copying
    rows = [(i, f"{x}\nx.y@z.org 10.1.2.3") for i, x in enumerate(runs)]
    got = {r["doc_id"]: r for r in pii.pii_digest(documents(spark, rows)).collect()}
    clean = {r["doc_id"]: r["text"] for r in pii.redact_pii(documents(spark, rows)).collect()}
    for i, x in enumerate(runs):
        at = len(x) + 1
        assert {f"email:{at}:{at + 9}", f"ip:{at + 10}:{at + 18}"} <= set(got[i]["spans"].split(",")), x[:20]
        assert clean[i].endswith("<EMAIL> <IP>") and (len(clean[i]) > 500_000 or x[:20] in ("a@" + "b." * 9, "1." * 10, "f:" * 10))


def test_boosted_candidates_add_spans(spark):
    model = pii.fitted(spark)
    assert model["accuracy"] > 0.95 and len(pii.examples()) == pii.EXAMPLES
    rows = [
        (0, "write to anna.bell [at] example [dot] com today"), (1, "call (212) 555-0147 now"), (2, "we met at the inn. and so on, at noon dot"),
        (3, "version 1.2.3, order 20 300 400 50, on 2024-05-06"), (4, "host fe80:1a:2b::9c3d:77 is up"), (5, 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"'), (6, "at 12:30:45 sharp"),
    ]
    got = {r["doc_id"]: r["spans"] for r in pii.pii_digest(documents(spark, rows)).collect()}
    assert got[0].startswith("email:9:") and got[1].startswith("phone:5:19") and got[4].startswith("ip:")
    assert got[2] == got[3] == got[5] == got[6] == ""


def test_redaction(spark):
    docs = documents(spark, [(0, "mail a@b.org, 1.2.3.4!"), (1, None), (2, ""), (3, "x@1.2.3.4 🎉 +1 (443) 555-5793")])
    out = pii.redact_pii(docs)
    assert out.columns == docs.columns
    assert [r["text"] for r in out.orderBy("doc_id").collect()] == ["mail <EMAIL>, <IP>!", None, "", "<EMAIL> 🎉 <PHONE>"]
    assert pii.pii_digest(docs.limit(0)).count() == 0


def test_pii_runs_no_python(spark):
    plan = pii.pii_digest(documents(spark).select("doc_id", F.lit("a@b.c").alias("text")))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Exchange", plan)


# --- op 5 ---------------------------------------------------------------------------------------


def test_boundaries_are_optimal():
    from itertools import combinations

    rng = random.Random(7)
    for _ in range(20):
        sizes = sorted({rng.randint(1, 40) for _ in range(9)})
        count = [rng.randint(1, 9) for _ in sizes]

        def waste(bounds):
            return sum(c * (min(b for b in bounds if b >= s) - s) for s, c in zip(sizes, count, strict=True))

        best = min(waste((*x, sizes[-1])) for k in range(3) for x in combinations(sizes[:-1], k))
        got = packing.best_boundaries(np.array(sizes, float), np.array(count, float), np.array(sizes, float) * count, 3)
        assert waste(got) == best and got[-1] == sizes[-1] and len(got) <= 3


def test_batches(spark):
    docs = documents(spark, [(i, "w " * (i % 97)) for i in range(900)] + [(2000, None), (2001, "w " * 5000)])
    rows = packing.pack(docs, buckets=4, token_budget=400, shard_rows=100).collect()
    assert len(rows) == 902 and {r["doc_id"] for r in rows} == {*range(900), 2000, 2001}
    batches = {}
    for r in rows:
        assert r["padding"] == r["bucket_length"] - r["length"] >= 0
        batches.setdefault(r["batch_id"], []).append(r)
    full = {}
    for b in batches.values():
        most = max(1, 400 // max(1, b[0]["bucket_length"]))
        assert len(b) <= most and sorted(r["slot"] for r in b) == list(range(len(b)))
        full.setdefault(b[0]["bucket"], []).append(len(b) == most)
    assert all(x.count(False) <= 1 for x in full.values())  # only a bucket's last batch may have room
    assert packing.pack(docs.limit(0)).count() == 0
    same = documents(spark, [(1, "a b"), (1, "a b"), (1, "a b")])
    assert packing.pack(same).count() == 3


def test_length_steps(spark):
    rows = spark.range(1, 200000, 37).select(F.col("id").alias("n"), packing.length_step(F.col("id")).alias("s")).collect()
    assert all(r["n"] <= r["s"] <= max(r["n"], r["n"] * 66 / 64 + 1) and (r["n"] > 1024 or r["s"] == r["n"]) for r in rows)
    odd = [" " * 1_000_000 + "a" + "\n" * 1_000_000, "x" * 5_000_000, "a " * 500_000, "a\x1cb\x85c"]
    assert spark.createDataFrame([(t,) for t in odd], "t string").select(packing.word_count(F.col("t"))).collect() == [(1,), (1,), (500_000,), (1,)]
    assert spark.createDataFrame([(t,) for t in texts()], "t string").select(packing.word_count(F.col("t"))).collect() == [(len(WORD.findall(t or "")),) for t in texts()]
