"""Removal of long byte strings that occur more than once, over a sparse suffix array.

A suffix is taken wherever a window of the text has its minimal `gram`-byte hash (winnowing), so that every string
of `span` bytes or more contains a sampled suffix at the same offset wherever it occurs. Suffixes whose surroundings
are equal on both sides are settled by counting. The rest are range-partitioned by their leading bytes with sampled
splitters; each bucket is sorted by multikey quicksort forwards and backwards, and the two arrays of common-prefix
lengths tell which windows of `span` bytes around a suffix start somewhere else too. Suffixes with equal leading grams
always share a bucket, so that buckets need no comparison across their boundaries; groups of suffixes that are too
large for one bucket are counted by their windows, each a key of its own. One array serves several spans: the
shortest sets the sample, the longest the surroundings.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, as_bytes, map_arrow, runs_by_key, slices

BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def powers(x: int) -> np.ndarray:
        p = np.full(n, x, dtype=np.uint64)
        p[0] = 1
        return np.cumprod(p)

    return powers(BASE), powers(BASE_INVERSE)


def sampled_positions(raw: bytes, span: int, gram: int) -> np.ndarray:
    """Starts of the leftmost minimal gram of every window of span bytes; depends on the window's bytes only."""
    n = len(raw)
    if n < span:
        return np.zeros(0, dtype=np.int64)
    power, inverse = _powers(1 << max(12, n.bit_length()))
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(np.frombuffer(raw, dtype=np.uint8) * power[:n], out=sums[1:])
    x = (sums[gram:] - sums[:-gram]) * inverse[: n - gram + 1]
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    bits = np.uint64(int(n).bit_length())
    low = np.uint64((1 << int(bits)) - 1)
    x = (x & ~low) | np.arange(x.size, dtype=np.uint64)
    left, width = span - gram + 1, 1
    while 2 * width <= left:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    if width < left:
        x = np.minimum(x[: x.size - (left - width)], x[left - width :])
    at = (x & low).astype(np.int64)
    return at[np.concatenate(([True], at[1:] != at[:-1]))]


def suffixes(docs: DataFrame, spans: tuple[int, ...], gram: int) -> DataFrame:
    """(id, th, pos, h, ctx): sampled suffixes, the hash of their leading gram and of all windows around them."""
    kind = docs.schema["id"].dataType.simpleString()
    least, most = min(spans), max(spans)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                rows, pos, h, ctx = [], [], [], []
                for i, raw in enumerate(as_bytes(part.column("text"))):
                    at = sampled_positions(raw, least, gram).tolist()
                    rows += [i] * len(at)
                    pos += at
                    for p in at:
                        a = max(0, p - (most - gram))
                        h.append(xxhash.xxh3_64_intdigest(raw[p : p + gram]))
                        ctx.append(xxhash.xxh3_64_intdigest(raw[a : p + most], seed=p - a))
                take = pa.array(rows, type=pa.int32())
                yield {
                    "id": part.column("id").take(take),
                    "th": part.column("th").take(take),
                    "pos": pos,
                    "h": pa.array(np.array(h, dtype=np.uint64).view(np.int64)),
                    "ctx": pa.array(np.array(ctx, dtype=np.uint64).view(np.int64)),
                }

    return map_arrow(docs.select("id", "th", "text"), f"id {kind}, th long, pos int, h long, ctx long", run)


def same_rows(docs: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """docs (id, th, ...) joined with found (id, th, ...), without found's keys; a null id equals a null id."""
    found = found.withColumnsRenamed({"id": "__id", "th": "__th"})
    return docs.join(found, docs["id"].eqNullSafe(found["__id"]) & (docs["th"] == found["__th"]), how).drop("__id", "__th")


def contexts(docs: DataFrame, wanted: DataFrame, span: int, gram: int) -> DataFrame:
    """The bytes on both sides of the wanted suffixes (id, th, pos, h)."""
    kind = docs.schema["id"].dataType.simpleString()
    lists = wanted.groupBy("id", "th").agg(F.collect_list(F.struct("pos", "h")).alias("at"))

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                rows, pos, h, back, ahead = [], [], [], [], []
                for i, (raw, at) in enumerate(zip(as_bytes(part.column("text")), part.column("at").to_pylist(), strict=True)):
                    for x in at:
                        p = x["pos"]
                        rows.append(i)
                        pos.append(p)
                        h.append(x["h"])
                        back.append(raw[max(0, p - (span - gram)) : p])
                        ahead.append(raw[p : p + span])
                take = pa.array(rows, type=pa.int32())
                yield {"id": part.column("id").take(take), "th": part.column("th").take(take), "pos": pos, "h": h, "back": back, "ahead": ahead}

    joined = same_rows(docs, lists, "inner").select("id", "th", "text", "at")
    return map_arrow(joined, f"id {kind}, th long, pos int, h long, back binary, ahead binary", run)


# --- one bucket ---------------------------------------------------------------------------------


def as_tokens(strings: list[bytes], width: int) -> np.ndarray:
    """Rows of big-endian 8-byte tokens, padded with zeros."""
    width = -(-width // 8) * 8
    flat = b"".join(s.ljust(width, b"\0") for s in strings)
    return np.frombuffer(flat, dtype=">u8").reshape(len(strings), width // 8).astype(np.uint64)


def multikey_sort(tokens: np.ndarray, group: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows by (group, bytes, length) and the common-prefix length of each with the row before.

    Multikey quicksort, one token of all open segments at a time: a segment is split by its next token, parts
    with equal tokens go on to the next, and single rows leave. Prefixes never span two groups.
    """
    n, depth = tokens.shape
    order = np.lexsort((length, group))
    segment = np.concatenate(([0], np.cumsum(group[order][1:] != group[order][:-1]))) if n else np.zeros(0, np.int64)
    common = np.full(n, -1, dtype=np.int64)
    common[np.flatnonzero(np.concatenate(([True], segment[1:] != segment[:-1])))] = 0
    places = np.arange(n)
    for d in range(depth):
        size = np.bincount(segment, minlength=1)
        keep = size[segment] > 1
        places, segment = places[keep], segment[keep]
        if not places.size:
            break
        rows = order[places]
        key = tokens[rows, d]
        by = np.lexsort((length[rows], key, segment))
        order[places] = rows[by]
        key = key[by]
        split = np.flatnonzero((segment[1:] == segment[:-1]) & (key[1:] != key[:-1])) + 1
        if split.size:
            differ = (key[split] ^ key[split - 1]).astype(">u8").view(np.uint8).reshape(-1, 8)
            common[places[split]] = 8 * d + (differ != 0).argmax(axis=1)
        new = np.concatenate(([True], (segment[1:] != segment[:-1]) | (key[1:] != key[:-1])))
        segment = np.cumsum(new) - 1
    common[common < 0] = 8 * depth
    if n:
        own = length[order]
        common[1:] = np.minimum(common[1:], np.minimum(own[1:], own[:-1]))
    return order, common


def repeated_windows(h: np.ndarray, back: list[bytes], ahead: list[bytes], spans: tuple[int, ...], gram: int) -> list[tuple]:
    """For each span, and for each suffix, the least and greatest d such that the window from d bytes before it starts
    elsewhere too; -1 where there is none. Rows with equal h share their leading gram."""
    n, longest = h.size, max(spans)
    group = np.unique(h, return_inverse=True)[1]
    len_r = np.fromiter(map(len, ahead), np.int64, n)
    len_l = np.fromiter(map(len, back), np.int64, n)
    order_r, lcp_r = multikey_sort(as_tokens(ahead, longest), group, len_r)
    order_l, lcp_l = multikey_sort(as_tokens([x[::-1] for x in back], longest - gram), group, len_l)

    def nearest(order, lcp):
        out = np.zeros(n, dtype=np.int64)
        out[order] = np.maximum(lcp, np.append(lcp[1:], 0))
        return out

    reach = nearest(order_r, lcp_r) + nearest(order_l, lcp_l)
    found = []
    for span in spans:
        low, high = np.full(n, -1, dtype=np.int64), np.full(n, -1, dtype=np.int64)
        found.append((low, high))
        live = reach >= span  # windows need a partner on either side: rows whose nearest fall short are left out
        for d in range(span - gram + 1 if live.any() else 0):
            right, left = np.empty(n, np.int64), np.empty(n, np.int64)
            right[order_r] = np.cumsum(lcp_r < span - d)
            left[order_l] = np.cumsum(lcp_l < d)
            if d == 0:
                left = group
            rows = np.flatnonzero(live & (len_r >= span - d) & (len_l >= d))
            if rows.size < 2:
                continue
            key = right[rows] * (n + 1) + left[rows]
            by = np.argsort(key, kind="stable")
            same = key[by][1:] == key[by][:-1]
            twice = np.zeros(rows.size, dtype=bool)
            twice[by[1:]] |= same
            twice[by[:-1]] |= same
            hit = rows[twice]
            high[hit] = d
            first = hit[low[hit] < 0]
            low[first] = d
    return found


def compare_buckets(rows: DataFrame, spans: tuple[int, ...], gram: int) -> DataFrame:
    """(id, th, span, a, b) around suffixes whose group fits a bucket."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        for t in runs_by_key(batches, ["h"], 1 << 14):
            pos = t.column("pos").to_numpy()
            found = repeated_windows(t.column("h").to_numpy(), t.column("back").to_pylist(), t.column("ahead").to_pylist(), spans, gram)
            for span, (low, high) in zip(spans, found, strict=True):
                hit = np.flatnonzero(low >= 0)
                take = pa.array(hit)
                yield {
                    "id": t.column("id").combine_chunks().take(take),
                    "th": t.column("th").combine_chunks().take(take),
                    "span": np.full(hit.size, span),
                    "a": pos[hit] - high[hit],
                    "b": pos[hit] - low[hit] + span,
                }

    lead = F.substring("ahead", 1, min(16, gram))
    dealt = rows.withColumn("lead", lead).repartitionByRange("lead", "h").sortWithinPartitions("lead", "h")
    return map_arrow(dealt.select("id", "th", "pos", "h", "back", "ahead"), f"id {kind}, th long, span int, a int, b int", run)


def compare_windows(ws: Workspace, rows: DataFrame, spans: tuple[int, ...], gram: int) -> DataFrame:
    """The same for groups of any size: each window is a key of its own, counted with map-side sums."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for part in slices(batch, "ahead", 1 << 16):
                out = []
                for i, (p, back, ahead) in enumerate(zip(part.column("pos").to_pylist(), part.column("back").to_pylist(), part.column("ahead").to_pylist(), strict=True)):
                    whole = back + ahead
                    for span in spans:
                        for s in range(max(0, len(back) - (span - gram)), min(len(back), len(whole) - span) + 1):
                            digest = xxhash.xxh3_128_intdigest(whole[s : s + span])
                            out.append((i, p, span, len(back) - s, digest >> 64, digest & ((1 << 64) - 1)))
                if not out:
                    continue
                i, p, span, d, hi, lo = zip(*out, strict=True)
                take = pa.array(i, type=pa.int32())
                yield {
                    "id": part.column("id").take(take), "th": part.column("th").take(take), "pos": p, "span": span, "d": d,
                    "w1": pa.array(np.array(hi, dtype=np.uint64).view(np.int64)),
                    "w2": pa.array(np.array(lo, dtype=np.uint64).view(np.int64)),
                }

    windows = map_arrow(rows.select("id", "th", "pos", "back", "ahead"), f"id {kind}, th long, pos int, span int, d int, w1 long, w2 long", run)
    windows = ws.store(windows, "windows")
    # d belongs to the key: suffixes inside one window name it at different d, and that is one occurrence
    key = ["span", "w1", "w2", "d"]
    twice = windows.groupBy(*key).count().where("count > 1").select(*key)
    hit = windows.join(twice, key, "left_semi").groupBy("id", "th", "pos", "span").agg(F.min("d").alias("low"), F.max("d").alias("high"))
    return hit.select("id", "th", "span", (F.col("pos") - F.col("high")).alias("a"), (F.col("pos") - F.col("low") + F.col("span")).alias("b"))


# --- the operator -------------------------------------------------------------------------------


def repeated_spans(ws: Workspace, docs: DataFrame, spans: tuple[int, ...], gram: int, bucket: int) -> DataFrame:
    """(id, th, span, a, b): stretches whose union, for each span, is everything covered by a repeated string of span bytes.

    That holds for texts of span bytes or more: equal texts between two spans have stretches of the longer one as well.
    """
    own = ws.store(suffixes(docs, spans, gram), "suffixes")
    classes = own.groupBy("h", "ctx").agg(F.count("*").alias("m"), F.min(F.struct("id", "th", "pos")).alias("rep"))
    classes = ws.store(classes, "classes", large=True)
    # equal surroundings on both sides: every window around the suffix occurs twice
    copies = own.join(classes.where("m > 1").select("h", "ctx"), ["h", "ctx"], "left_semi").select("id", "th", "pos")
    copies = ws.store(copies, "copies", large=True)
    ws.drop(own)
    groups = ws.store(classes.groupBy("h").agg(F.count("*").alias("n_ctx")).where("n_ctx > 1"), "groups", large=True)
    wanted = ws.store(classes.join(groups, "h").select("rep.*", "h", "n_ctx"), "wanted", large=True)
    ws.drop(classes, groups)

    longest = max(spans)
    few, many = (wanted.where(f"n_ctx {x} {bucket}").drop("n_ctx") for x in ("<=", ">"))
    found = ws.store(compare_buckets(contexts(docs, few, longest, gram), spans, gram), "found", large=True)
    if not many.isEmpty():
        found = found.union(compare_windows(ws, contexts(docs, many, longest, gram), spans, gram))
    whole = copies.withColumn("span", F.explode(F.array(*map(F.lit, spans)))).select(
        "id", "th", "span", F.greatest(F.col("pos") - (F.col("span") - gram), F.lit(0)).alias("a"), (F.col("pos") + F.col("span")).alias("b")
    )
    return whole.union(found)


def merge(pairs: np.ndarray, n: int) -> np.ndarray:
    """Sorted disjoint runs of [a, b) pairs, clipped to n."""
    if not pairs.size:
        return pairs.reshape(0, 2)
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    reach = np.maximum.accumulate(np.minimum(pairs[:, 1], n))
    first = np.concatenate(([True], pairs[1:, 0] > reach[:-1]))
    last = np.concatenate((first[1:], [True]))
    return np.column_stack((pairs[first, 0], reach[last]))


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = 400, gram: int = 64, bucket: int = 1 << 16,
    passage_span: int | None = None, passage_words: int = 51,
) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, kept, n_passages): the text's bytes without repeated strings.

    Texts are UTF-8 bytes; null counts as empty; texts shorter than span are kept whole. Matches never cross
    documents; every occurrence goes, judged on the input. Repeated rows repeat each other; a null id is an id like
    any other. Other columns of docs are ignored; an empty table gives an empty result. kept is binary, as a cut can
    fall inside a character.

    n_passages counts the passages of at least passage_words whole words that occur elsewhere too, many of which are
    shorter than span: maximal runs covered by repeated strings of passage_span bytes. It removes nothing, and is 0
    where passage_span is None.
    """
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    schema = f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, n_passages long"
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    spans = (span,) if passage_span is None else (span, passage_span)

    def finish(part: pa.RecordBatch, raws: list[bytes], runs: list[dict]) -> dict:
        kept = [cut(raw, own[span]) for raw, own in zip(raws, runs, strict=True)]
        passages = [0] * len(raws) if passage_span is None else [sum(whole_words(raw, a, b) >= passage_words for a, b in own[passage_span]) for raw, own in zip(raws, runs, strict=True)]
        return {
            "id": part.column("id"),
            "n_bytes": list(map(len, raws)),
            "n_removed": [len(a) - len(b) for a, b in zip(raws, kept, strict=True)],
            "n_spans": [len(own[span]) for own in runs],
            "kept_sha256": [hashlib.sha256(x).hexdigest() for x in kept],
            "kept": kept,
            "n_passages": passages,
        }

    return _with_repeats(rows, spans, gram, bucket, schema, finish).withColumnRenamed("id", id_col)


def cut_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = 400, gram: int = 64, bucket: int = 1 << 16, least_words: int = 0
) -> DataFrame:
    """docs with repeated strings cut out of the text; columns and other values as in docs.

    Maximal runs of fewer than least_words whole words stay. A character that a cut splits goes as a whole. Null texts
    stay null.
    """
    others = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != text_col))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), others.alias("row"))

    def finish(part: pa.RecordBatch, raws: list[bytes], runs: list[dict]) -> dict:
        null = part.column("text").is_null().to_pylist()
        kept = [cut(raw, [x for x in own[span] if whole_words(raw, *x) >= least_words]) for raw, own in zip(raws, runs, strict=True)]
        return {"row": part.column("row"), "text": [None if x else k.decode("utf-8", "ignore") for x, k in zip(null, kept, strict=True)]}

    out = _with_repeats(rows, (span,), gram, bucket, f"row {rows.schema['row'].dataType.simpleString()}, text string", finish)
    return out.select(*(F.col("text").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns))


def cut(raw: bytes, runs: list) -> bytes:
    """raw without its runs [a, b)."""
    ends = [0, *(b for _, b in runs)]
    return b"".join(raw[a:b] for a, b in zip(ends, [*(a for a, _ in runs), len(raw)], strict=True))


def whole_words(raw: bytes, a: int, b: int) -> int:
    """Words (runs without ASCII white space) that lie in raw[a:b] as a whole."""

    def inside(at: int) -> bool:
        return 0 < at < len(raw) and not raw[at - 1 : at].isspace() and not raw[at : at + 1].isspace()

    return max(0, len(raw[a:b].split()) - inside(a) - inside(b))


def _with_repeats(rows: DataFrame, spans: tuple[int, ...], gram: int, bucket: int, schema: str, finish) -> DataFrame:
    """Apply finish(batch, texts, runs by span) to the rows (id, text, ...) joined with their spans."""
    ws = Workspace(rows.sparkSession, "suffix")
    keyed = rows.withColumn("th", F.xxhash64("text"))
    found = repeated_spans(ws, keyed.select("id", "th", "text"), spans, gram, bucket)
    lists = ws.store(found.groupBy("id", "th").agg(F.collect_set(F.struct("span", "a", "b")).alias("spans")), "spans", large=True)
    ws.keep_only(lists)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                raws, runs = as_bytes(part.column("text")), []
                for raw, own in zip(raws, part.column("spans").to_pylist(), strict=True):
                    # a text shorter than a span holds no string of it, though it may be a copy that the shorter span sampled
                    runs.append({k: merge(np.array([(x["a"], x["b"]) for x in own or () if x["span"] == k <= len(raw)], dtype=np.int64), len(raw)).tolist() for k in spans})
                yield finish(part, raws, runs)

    return map_arrow(same_rows(keyed, lists, "left").drop("th"), schema, run)
