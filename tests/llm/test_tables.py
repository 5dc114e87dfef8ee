import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from termatlas.llm import bpe, embedding_dedup, html_extract, token_files, warc
from termatlas.llm.common import RecentCache, Workspace, forest, slices
from tests.llm.fixtures import documents, texts

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
ODD = [
    "", " ", "  a  b ", "a\n \nb", "x<|endoftext|>y <|endoftext|> z", "it's we'll  DON'T", "日本語 テスト 🎉🎉 naïve", "   x\ty\r\n\r\nz", "a" * 300,
    "1234567 8,900.00", "İstanbul ΣΑΣ é ́", "The <|endoftext|", "\x00\x01\x7f", "\x85a b\x1cc", "<|startoftext|>", "  \n\n ", "!!?? --",
]


def random_texts(n, seed):
    rng = random.Random(seed)
    letters = "abcdehinorstABC'.,!\n\t éÉßÿ日🎉012ÀİΣσ´́ \x1c<|>_^$×÷"
    return ["".join(rng.choice(letters) for _ in range(rng.randint(1, 50))) for _ in range(n)]


# --- op 2 ---------------------------------------------------------------------------------------


def test_automaton_equals_the_library():
    path = public_tokenizers.path("byte_bpe_50k.json")
    own, lib = bpe.tokenizer(path), tokenizers.Tokenizer.from_file(path)
    for t in ODD + random_texts(3000, 1) + [x for x in texts() if x]:
        ids = lib.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == ids, t
        assert own.decode(ids) == lib.decode(ids, skip_special_tokens=False)
    broken = [own.encode("é🎉")[0], 50256]
    assert own.decode(broken) == lib.decode(broken, skip_special_tokens=False)


def test_automaton_equals_greedy_merging():
    """A small vocabulary with merges of equal and overlapping parts, over all short words."""
    from itertools import product

    merges = [("a", "a"), ("a", "b"), ("aa", "b"), ("b", "ab"), ("aa", "aa"), ("ab", "ab"), ("b", "b")]
    vocab = {x: i for i, x in enumerate(["a", "b", *(x + y for x, y in merges)])}
    auto = bpe.MergeAutomaton(vocab, merges)
    rank = {m: i for i, m in enumerate(merges)}
    for n in range(1, 11):
        for word in product("ab", repeat=n):
            parts = list(word)
            while True:
                found = [(rank[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in rank]
                if not found:
                    break
                _, i = min(found)
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            assert auto.encode("".join(word).encode()) == [vocab[p] for p in parts]


def test_bpe_rows(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs, lib = documents(spark), tokenizers.Tokenizer.from_file(path)
    got = {r["doc_id"]: r for r in bpe.round_trip(docs, path).collect()}
    coded = bpe.encode_texts(docs, path)
    ids_of = {r["doc_id"]: r["ids"] for r in coded.collect()}
    back = {r["doc_id"]: r["text"] for r in bpe.decode_ids(coded, path).collect()}
    for i, t in enumerate(texts()):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
        assert ids_of[i] == ids and back[i] == (t or "")
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids), digest(",".join(map(str, ids))), digest(t or ""))
    assert bpe.round_trip(docs.limit(0), path).count() == 0


def test_caches_stay_bounded():
    made = []
    c = RecentCache(lambda k: made.append(k) or k * 2, 10)
    for k in map(str, [*range(100), 5, 99]):
        assert c[k] == 2 * k
    assert len(c) + len(c.old) <= 22


def test_long_words_are_not_kept():
    path = public_tokenizers.path("byte_bpe_50k.json")
    own, lib = bpe.tokenizer(path), tokenizers.Tokenizer.from_file(path)
    word = "".join(random.Random(8).choice("abcdefghijklmnopqrstuvwxyzABCXYZ") for _ in range(400_000))
    for t in (word, "ab" * 100_000, "-" * 100_000):
        assert own.encode(t) == lib.encode(t, add_special_tokens=False).ids
    for cache in (own.words, own.first, own.spaced):
        assert max(map(len, [*cache, *cache.old]), default=0) <= cache.longest
    c = RecentCache(lambda k: k, 100, longest=10)
    for k in range(2000):
        assert c[f"{k:0200d}"] == f"{k:0200d}" and c[f"{k}"] == f"{k}"
    assert len(c) + len(c.old) <= 202


def test_slices_bound_bytes():
    batch = pa.record_batch({"text": ["a" * 10, None, "b" * 50, "", "c" * 10]})
    parts = list(slices(batch, "text", 20))
    assert sum(p.num_rows for p in parts) == 5 and max(p.num_rows for p in parts) < 5


# --- op 8 ---------------------------------------------------------------------------------------


def test_encoder_equals_the_library():
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        path = public_tokenizers.path(name)
        own, lib = token_files.Encoder(path), tokenizers.Tokenizer.from_file(path)
        for t in ODD + random_texts(1500, 2) + [x for x in texts() if x]:
            assert np.frombuffer(own.encode(t), "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids, t


@pytest.mark.parametrize("bits", [1, 5, 8, 13, 16, 17, 31, 32])
def test_bits_round_trip(bits, tmp_path):
    rng = np.random.default_rng(bits)
    docs = [rng.integers(0, 1 << bits, size=n, dtype=np.uint64).astype("<u4") for n in (0, 3, 100, 1, 0, 257, 64)]
    path = tmp_path / "x.ids"
    w = token_files.Writer(open(path, "wb"), bits, block=64)
    for i, d in enumerate(docs):
        w.add(i * 10, d)
    w.close()
    with pa.OSFile(str(path)) as f:
        r = token_files.Reader(f)
        assert r.docs.tolist() == [i * 10 for i in range(len(docs))] and r.n == sum(map(len, docs))
        assert [r.document(i).tolist() for i in reversed(range(len(docs)))] == [d.tolist() for d in reversed(docs)]
        assert r.ids(50, 170).tolist() == np.concatenate(docs)[50:170].tolist()
    assert path.stat().st_size <= (r.n * bits) / 8 + 8 * (len(r.offsets) + 2 * len(docs) + 1) + 100


def test_token_files_in_id_order(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    lib = tokenizers.Tokenizer.from_file(path)
    rows = list(enumerate(texts()))
    random.Random(1).shuffle(rows)
    got = {r["doc_id"]: r for r in token_files.pack_round_trip(documents(spark, rows), path, end_id=2).collect()}
    at = 0
    for i, t in sorted(rows):
        ids = lib.encode(t or "", add_special_tokens=False).ids + [2]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert token_files.pack_round_trip(documents(spark).limit(0), path, end_id=2).count() == 0
    assert token_files.pack_round_trip(documents(spark, rows + rows), path, end_id=2).count() == 2 * len(rows)
    null = rows[:5] + [(None, "no id"), (None, None)]
    back = sorted(map(tuple, token_files.pack_round_trip(documents(spark, null), path, end_id=2).collect()), key=lambda r: r[1])
    assert [r[0] for r in back] == [None, None, *sorted(i for i, _ in rows[:5])] and back[0][1] == 0 and [a[1] + a[2] for a in back[:-1]] == [b[1] for b in back[1:]]
    assert token_files.bits_for(49408) == 16 and token_files.bits_for(65537) == 17


# --- op 4 ---------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href=/>Home</a></ul></nav><div class="cookie-notice">We use cookies</div><div id="main-2"><div class="%s">
<h1>Head &amp; title</h1><p><b>First  &eacute;<br>line<p>Second &lt;x&gt; <a href=x>link</a> tail</p><div class="ad">Buy</div>
<ul><li>one<li>two</ul><form><input>Search</form><div class="comments"><p>%s</p></div></div></div><aside>Side</aside><footer>&copy; F</footer>"""
TEXT = "Head & title\nFirst é line\nSecond <x> link tail\none\ntwo"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", "y", 1) for i, u, h in rows], "page_id long, url string, html string, host string, paths string, text int")


def test_main_text(spark):
    rows = [(i, f"http://h.com/{i}", PAGE % (f"post-{i}", "Reader says much here")) for i in range(6)]
    rows += [(10, None, None), (11, "", ""), (12, "http://z.com", "no tags at all"), (13, "u", "<p>a<p>b"), (14, "http://h.com/x", "<body><article><h1>H</h1><p>alone</article>"), (0, "http://h.com/0", PAGE % ("post-0", "x"))]
    rows += [(15, "http://h.com", "<div>" * 2000 + "deep" + "</div>" * 2000), (16, "q", "<body><p>x < y & z &am &amp</p>"), (17, "q", "<a href=\"unclosed <p>" * 50)]
    got = {}
    for r in html_extract.main_text(pages(spark, rows)).collect():
        got.setdefault(r["page_id"], []).append(r["text"])
        assert r["n_chars"] == len(r["text"])
    assert len(got[0]) == 2 and all(got[i][0] == TEXT for i in range(6))
    assert got[10] == got[11] == [""] and got[14] == ["H\nalone"] and got[15] == ["deep"] and got[16] == ["x < y & z &am &"]
    assert html_extract.main_text(pages(spark, rows).limit(0)).count() == 0


def test_host_paths_outvote_a_page():
    """A page with a long side box is read by its host's path."""
    page = "<body><div class=box-7><p>" + "side words " * 30 + "</div><div class=entry-7><p>" + "own words " * 20 + "</div>"
    assert html_extract.extract(page, []).startswith("side")
    assert html_extract.extract(page, ["body>div.entry"]).startswith("own")


def test_text_is_found_beside_furniture_and_links():
    words = "own words " * 50
    own = words.strip()
    for nested in ('<div class="comments">%s</div>', "<form>%s</form>", '<div class="ad">%s</div>'):
        page = f"<body><article><p>{words}</p>{nested % ('other ' * 400)}</article><div><p>side box</p></div>"
        assert html_extract.extract(page, []) == own
        assert html_extract.extract(page, ["body>article"]) == own and html_extract.votes(page)[0][0] == "body>article"
    links = "<p>short <a href=x>" + words + "</a></p>"
    assert html_extract.extract(f"<body><article>{links}</article>", []) == f"short {own}"
    assert html_extract.extract(f"<body><div class=side>{words}</div><article>{links}</article>", ["body>article"]) == f"short {own}"
    assert html_extract.extract("<h1>Head</h1><p>one<p>two<nav>Home</nav>", []) == "Head\none\ntwo"
    assert html_extract.extract(f"<h1>Head</h1><p>{words}</p><div>small</div>", []) == f"Head\n{own}\nsmall"
    assert html_extract.extract("no tags at all", []) == "no tags at all"
    assert html_extract.extract("<nav>Home</nav><script>x</script>", []) == ""
    for root in ('<html class="no-js menu-open"><body class="single-post has-sidebar">', "<html><body id=page-header>", '<body class="comments">'):
        assert html_extract.extract(f"{root}<div class=sidebar>Side</div><article><p>{words}</p></article><footer>F</footer>", []) == own
    menu = "<ul class=menu>" + "<li><a href=x>entry of a long menu</a>" * 80 + "</ul>"
    assert html_extract.extract(f"<body>{menu}<div><p>short article</p></div>", []) == "short article"
    assert html_extract.extract("<p>Hello world, this is text.</p>", []) == "Hello world, this is text."


def test_deep_pages_take_linear_time():
    n = 50_000
    for page, text in (("<div>" * n + "deep" + "</div>" * n, "deep"), ("<p><table>" + "<b>" * n + "</p>" * n + "x", "x"), ("<i>" * n + "</u>" * n + "y", "y")):
        paths = [p for p, _ in html_extract.votes(page)]
        assert html_extract.extract(page, paths[-1:]) == text and max(map(len, paths)) < 1000
    ends = [{p for p, _ in html_extract.votes("<div>" * k + "<div class=a>text</div>") if p.endswith("div.a")} for k in (60, 60, 61)]
    assert ends[0] == ends[1] != ends[2] and all(map(len, ends))


# --- op 6 ---------------------------------------------------------------------------------------


def test_captures(spark):
    big = "<p>" + "é🎉\r\n\r\nWARC/1.1\r\n" * 300
    rows = [(3, "http://a/3", "same"), (1, "http://a/1", "same"), (2, None, big), (5, "u\r\nX: y", None), (6, "", ""), (7, "http://a/7", big), (8, "x", "other"), (9, "x", "\0")] + [(100 + i, "u", "hot") for i in range(50)]
    got = {r["page_id"]: r for r in warc.captures_of_pages(pages(spark, rows)).collect()}
    first = {}
    for i, _, h in sorted(rows, key=lambda r: r[0]):
        payload = (h or "").encode()
        f = first.setdefault(payload, i)
        r = got[i]
        assert (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) == (len(payload), warc.digest(payload), "response" if f == i else "revisit", None if f == i else f)
        assert r["payload"] == (payload if f == i else None)
    assert len(got) == len(rows)
    few = {r["page_id"]: r["record_type"] for r in warc.captures_of_pages(pages(spark, rows), least_bytes=5).collect()}
    assert few[3] == few[149] == "response" and few[7] == "revisit"
    assert warc.captures_of_pages(pages(spark, rows).limit(0)).count() == 0
    twice = warc.captures_of_pages(pages(spark, [(1, "u", "a"), (1, "u", "a"), (None, "u", "b")])).collect()
    assert sorted((r["page_id"] or 0, r["record_type"]) for r in twice) == [(0, "response"), (1, "response"), (1, "response")]


def test_transactions_join_either_way(spark):
    """Identifiers may stand on the response, on the others, or lead over a record between."""
    heads = spark.createDataFrame(
        [("r1", "response", ["q1"]), ("q1", "request", []), ("m1", "metadata", ["q1"]), ("r2", "revisit", []), ("q2", "request", ["r2"]), ("m2", "metadata", ["r2", "q2"]), ("lost", "metadata", ["gone"])],
        "record_id string, type string, concurrent_to array<string>",
    )
    keys = {r["record_id"]: r["capture"] for r in warc.transaction_keys(Workspace(spark, "t"), heads).collect()}
    assert keys == {"r1": "r1", "q1": "r1", "m1": "r1", "r2": "r2", "q2": "r2", "m2": "r2"}


# --- op 1 ---------------------------------------------------------------------------------------


def brute_links(rows, threshold):
    usable = [(i, np.array(v, float), g) for i, v, g in rows if v and g is not None and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    links = {i: 0 for i, _, _ in rows}
    parent = {i: i for i, _, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, v, g) in enumerate(usable):
        for j, w, h in usable[n + 1 :]:
            if g == h and len(v) == len(w) and v @ w / np.sqrt(v @ v) / np.sqrt(w @ w) >= threshold:
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (links[i], find(i), find(i) == i) for i in links}


@pytest.mark.parametrize("block", [4096, 16])
def test_embedding_links(spark, block):
    rng = np.random.default_rng(block)
    rows = []
    for c in range(12):
        centre = rng.standard_normal(16)
        for _ in range(int(rng.integers(1, 30))):
            rows.append([len(rows), (centre + 0.12 * rng.standard_normal(16)).astype(np.float32).tolist(), int(c % 3)])
    rows += [[len(rows) + k, v, g] for k, (v, g) in enumerate([(None, 0), ([0.0] * 16, 0), ([1.0] * 15 + [None], 0), ([float("nan")] * 16, 0), ([float("inf")] + [1.0] * 15, 0), (rows[0][1], None), (rows[0][1], 0), (rows[0][1], 0), ([1.0, 2.0], 0), ([2.0, 4.0], 0), ([], 0), ([1e-30, 1e-30], 0), ([3e38, 3e38], 0)])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"id": F.lit("x"), "grp": F.lit(1), "m": F.lit(2), "component": F.lit(3)})
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_duplicates(df, window=8, block=block).collect()}
    assert got == brute_links(rows, 0.93)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0
    assert embedding_dedup.near_duplicates(df.union(df)).count() == 2 * len(rows)


@pytest.mark.parametrize("exact", [32768, 64])
def test_concentrated_label(spark, exact):
    """Vectors around one direction, which random bits hardly tell apart."""
    rng = np.random.default_rng(5)
    centre = rng.standard_normal(64)
    x = 0.88**0.5 * centre / np.sqrt(centre @ centre) + 0.12**0.5 * rng.standard_normal((3000, 10)) @ rng.standard_normal((10, 64)) / np.sqrt(640)
    rows = [(i, v, 0) for i, v in enumerate(x.tolist())] + [(5000 + i, v, 1) for i, v in enumerate(rng.standard_normal((200, 64)).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    unit = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    near = unit @ unit.T >= 0.985
    u, v = np.nonzero(near)
    comp = forest(3000, u, v)
    assert 100 < len(set(comp.tolist())) < 2900
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_duplicates(df, threshold=0.985, window=16, exact=exact).collect()}
    assert [got[i] for i in range(3000)] == list(zip((near.sum(axis=1) - 1).tolist(), comp.tolist()))
    assert all(got[5000 + i] == (0, 5000 + i) for i in range(200))


def test_no_size_switches_the_result(spark):
    """Pairs just above the threshold, which few passes bring together, in labels larger and smaller than a file."""
    rng = np.random.default_rng(9)
    x, z = rng.standard_normal((2, 250, 64))
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    z -= (z * x).sum(axis=1, keepdims=True) * x
    y = 0.935 * x + (1 - 0.935**2) ** 0.5 * z / np.sqrt((z * z).sum(axis=1, keepdims=True))
    rows = [(i, v, 0 if i % 250 < 200 else 1) for i, v in enumerate(np.concatenate((x, y)).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = embedding_dedup.near_duplicates(df, window=4, miss=0.5, exact=150)
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got.collect()} == {i: (1, i % 250) for i in range(500)}


def test_group_links_equal_brute_force():
    """Groups of one and of many rows, within a file and between two, in full and in few dimensions."""
    for seed, dim, spread in ((0, 64, 0.02), (1, 24, 0.05), (2, 5, 0.15), (3, 3, 0.3)):
        rng = np.random.default_rng(seed)
        x = np.repeat(rng.standard_normal((60, dim)), 5, axis=0) + spread * rng.standard_normal((300, dim))
        c = np.sort(np.where(rng.random(300) < 0.5, np.arange(300), np.arange(300) // 7 * 7))
        t = pa.table({"id": np.arange(300), "c": c, "v": pa.array(x.tolist())})
        unit = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
        u, v = np.nonzero(unit @ unit.T >= 0.93)
        a, b = (embedding_dedup.Groups(t.slice(i, n), 0.93) for i, n in ((0, 170), (170, 130)))
        found = [embedding_dedup.group_links(*g, 0.93) for g in ((a, a), (b, b), (a, b))]
        first = np.searchsorted(c, c)
        have = forest(300, *(np.concatenate([np.arange(300) if k == 0 else first, *(f[k] for f in found)]) for k in (0, 1)))
        assert have.tolist() == forest(300, np.concatenate((u, np.arange(300))), np.concatenate((v, first))).tolist()


def test_depths_bound_the_window():
    rng = np.random.default_rng(6)
    grp = np.sort(rng.integers(0, 3, 400))
    sig = rng.integers(-(2**63), 2**63 - 1, 400) & np.int64(~0xFFFFFFFF)
    sig[:30] = sig[0]
    order = np.lexsort((sig, grp))
    grp, sig = grp[order], sig[order]
    depth = embedding_dedup.row_depths(grp, sig, 8)
    assert depth.size == 400 - 18 and depth.max() == 65
    for k, d in enumerate(depth.tolist()):
        i = k + 9
        shared = [64 - (int(x) & (2**64 - 1)).bit_length() for x in (sig ^ sig[i]).tolist()]
        assert all(abs(j - i) <= 8 for j in range(400) if grp[j] == grp[i] and shared[j] >= d)


def test_passes_follow_the_rows():
    n = [embedding_dedup.passes_needed(r, 64, 0.93, 0.001) for r in (10, 10**4, 10**6)]
    assert n == sorted(n) and n[0] >= 4
    angle = np.arccos(0.93) / np.pi
    assert (1 - (1 - angle) ** (np.log2(10**6 / 64) + 1)) ** n[2] <= 0.001
