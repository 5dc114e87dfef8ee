"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints within `radius` bits of each other agree, in at least one of m groups of bits, up to that group's
threshold, whenever the thresholds sum to radius - m + 1 (a threshold of -1 leaves a group out). Correlated bits
share a group; a dynamic programme gives each group the threshold with the smallest estimated number of rows and
candidate pairs, from bit statistics of all fingerprints. A group with threshold e is probed by blanking every
choice of e of its bits, so equal keys meet in one shuffle and candidates are verified on the full 64 bits.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, as_bytes, connected_components, forest, key_change, map_arrow, runs_by_key, slices

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
BITS = 64


def simhash(raw: bytes, shingle: int = 4, seed: int = 42) -> int:
    """Fingerprint of a text: bit set where over half of the shingles' XXH64 have it set; 0 without words."""
    words = raw.translate(LOWER).split()
    if not words:
        return 0
    whole = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(whole, seed)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: len(words) - shingle + 1].tolist()
    stops = (ends[shingle - 1 :] - 1).tolist()
    h = np.array([xxhash.xxh64_intdigest(whole[a:b], seed) for a, b in zip(starts, stops, strict=True)], dtype="<u8")
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, h.size, 1 << 14):
        part = h[at : at + (1 << 14)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    set_bits = np.flatnonzero(2 * ones > h.size)
    return int(sum(1 << int(b) for b in set_bits))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(id, fp): fp is the 64-bit fingerprint as a signed long; null and empty texts have fp 0."""
    kind = docs.select(id_col).schema[0].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                fp = np.array([simhash(x, shingle) for x in as_bytes(part.column("text"))], dtype=np.uint64)
                yield {"id": part.column("id"), "fp": pa.array(fp.view(np.int64))}

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(rows, f"id {kind}, fp long", run)


# --- planning -----------------------------------------------------------------------------------


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and the 64 x 64 counts of bits set together: one 4,097-number row a task."""

    def run(batches):
        n, both = 0, np.zeros((BITS, BITS))
        for batch in batches:
            v = batch.column("fp").to_numpy().view(np.uint64)
            for at in range(0, v.size, 1 << 16):
                part = v[at : at + (1 << 16)]
                x = np.unpackbits(np.ascontiguousarray(part).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                both += x.T @ x
                n += part.size
        if n:
            yield {"k": np.arange(BITS * BITS + 1), "c": np.concatenate(([n], both.ravel())).astype(np.int64)}

    sums = map_arrow(fps.select("fp"), "k int, c long", run).groupBy("k").agg(F.sum("c").alias("c")).collect()
    found = np.zeros(BITS * BITS + 1)
    for r in sums:
        found[r["k"]] = r["c"]
    return int(found[0]), found[1:].reshape(BITS, BITS)


def group_bits(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """m groups of near-equal size; each grows by the free bit most correlated with its members."""
    p = both.diagonal() / max(n, 1)
    cov = both / max(n, 1) - np.outer(p, p)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    near = np.abs(cov / np.outer(sd, sd))
    free, groups = set(range(BITS)), []
    for g in range(m):
        size = (BITS - sum(map(len, groups))) // (m - g)
        first = max(sorted(free), key=lambda b: near[b, sorted(free)].sum())
        group = [first]
        free.remove(first)
        while len(group) < size:
            best = max(sorted(free), key=lambda b: near[b, group].mean())
            group.append(best)
            free.remove(best)
        groups.append(sorted(group))
    return groups


def agreement(n: int, both: np.ndarray, group: list[int], radius: int) -> np.ndarray:
    """P(two fingerprints differ in at most e bits of the group), e = 0..radius.

    Differences are taken as independent with each bit's own rate; correlation shrinks the group to its
    effective number of bits.
    """
    p = both.diagonal()[group] / max(n, 1)
    cov = both[np.ix_(group, group)] / max(n, 1) - np.outer(p, p)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = (cov / np.outer(sd, sd)) ** 2
    effective = len(group) ** 2 / max(corr.sum(), len(group))
    dist = np.zeros(len(group) + 1)
    dist[0] = 1.0
    for d in 2 * p * (1 - p):
        dist[1:] = dist[1:] * (1 - d) + dist[:-1] * d
        dist[0] *= 1 - d
    return np.minimum(np.cumsum(dist)[: radius + 1], 1.0) ** (effective / len(group))


def plan_probes(n: int, both: np.ndarray, radius: int, row_cost: float = 200.0) -> list[tuple[list[int], int]]:
    """(bits, threshold) groups: the cheapest allocation over m = 2 .. radius + 1 groups.

    The dynamic programme runs over groups and threshold still to spend; row_cost is what a shuffled row costs
    against one verified candidate.
    """
    best, chosen = math.inf, None
    for m in range(2, radius + 2):
        groups = group_bits(n, both, m)
        total = radius - m + 1
        cost = []
        for g in groups:
            agree = agreement(n, both, g, radius)
            c = {-1: 0.0}
            for e in range(0, min(total + m - 1, radius, len(g) - 1) + 1):
                masks = math.comb(len(g), e)
                pairs = n * n / 2 * agree[e] * (1 + e)
                c[e] = n * masks * row_cost + pairs
            cost.append(c)
        table = {0: (0.0, [])}  # threshold + 1 spent so far -> cost, thresholds
        for c in cost:
            step: dict = {}
            for spent, (was, taken) in table.items():
                for e, extra in c.items():
                    now = spent + e + 1
                    if now <= radius + 1 and was + extra < step.get(now, (math.inf, None))[0]:
                        step[now] = (was + extra, [*taken, e])
            table = step
        price, thresholds = table.get(radius + 1, (math.inf, None))
        if price < best:
            best, chosen = price, [(g, e) for g, e in zip(groups, thresholds, strict=True) if e >= 0]
    return chosen


def probe_masks(plan: list[tuple[list[int], int]]) -> list[int]:
    """For each probe the bits that have to agree exactly."""
    out = []
    for bits, e in plan:
        full = sum(1 << b for b in bits)
        out += [full & ~sum(1 << b for b in blank) for blank in itertools.combinations(bits, e)]
    return out


# --- verification -------------------------------------------------------------------------------


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def link_rows(key: np.ndarray, fp: np.ndarray, radius: int, dense: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (as index pairs) of the links inside each run of equal keys."""
    n = fp.size
    change = np.flatnonzero(key[1:] != key[:-1]) + 1
    starts = np.concatenate(([0], change))
    stops = np.concatenate((change, [n]))
    size = stops - starts
    us, vs = [], []
    stop_of = np.repeat(stops, size)
    at = np.flatnonzero(np.repeat(size <= dense, size))
    gap = 1
    while at.size:
        at = at[at + gap < stop_of[at]]
        hit = at[popcount(fp[at] ^ fp[at + gap]) <= radius]
        us.append(hit)
        vs.append(hit + gap)
        gap += 1
    for a, b in zip(starts[size > dense].tolist(), stops[size > dense].tolist(), strict=True):
        # near neighbours in numeric order join most of a large run, so that only what is still apart is compared
        order = a + np.argsort(fp[a:b], kind="stable")
        own = fp[order]
        x, y = [], []
        for gap in range(1, 9):
            hit = np.flatnonzero(popcount(own[:-gap] ^ own[gap:]) <= radius)
            x.append(hit)
            y.append(hit + gap)
        comp = forest(own.size, np.concatenate(x), np.concatenate(y))
        one = bool((comp == comp[0]).all())
        for i in range(0 if one else own.size):
            apart = np.flatnonzero((comp != comp[i]) & (popcount(own ^ own[i]) <= radius))
            if apart.size:
                x.append(np.full(apart.size, i))
                y.append(apart)
                comp[np.isin(comp, np.append(comp[apart], comp[i]))] = min(comp[i], comp[apart].min())
        us.append(order[np.concatenate(x)])
        vs.append(order[np.concatenate(y)])
    u = np.concatenate(us) if us else np.zeros(0, np.int64)
    v = np.concatenate(vs) if vs else np.zeros(0, np.int64)
    comp = forest(n, u, v)
    child = np.flatnonzero(comp != np.arange(n))
    return child, comp[child]


def link_fingerprints(ws: Workspace, fps: DataFrame, radius: int = 4, block: int = 8192) -> DataFrame:
    """Links (u, v) between distinct fingerprints that join exactly those reachable by steps of <= radius bits.

    Each shuffled group gives a spanning forest only, so the rows made stay linear in the rows read. A key with
    more than `block` fingerprints is dealt into blocks and every pair of blocks is compared in a task of its own.
    """
    n, both = bit_statistics(fps)
    masks = np.array(probe_masks(plan_probes(max(n, 1), both, radius)), dtype=np.uint64)

    def probe(batches):
        for batch in batches:
            v = batch.column("fp").to_numpy().view(np.uint64)
            step = max(1, (1 << 17) // masks.size)
            for at in range(0, v.size, step):
                part = v[at : at + step]
                yield {
                    "probe": np.repeat(np.arange(masks.size, dtype=np.int32), part.size),
                    "part": (masks[:, None] & part[None, :]).ravel().view(np.int64),
                    "fp": np.tile(part, masks.size).view(np.int64),
                }

    rows = map_arrow(fps.select("fp"), "probe int, part long, fp long", probe)
    rows = rows.select(F.xxhash64("probe", "part").alias("key"), "fp")
    hot = ws.store(rows.groupBy("key").count().where(F.col("count") > block), "hot-keys")
    if hot.isEmpty():
        dealt = rows.withColumn("task", F.lit(0))
    else:
        n_blocks = F.ceil(F.coalesce(F.col("count"), F.lit(1)) / block).cast("int")
        own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
        dealt = (
            rows.join(hot, "key", "left")
            .withColumn("blocks", n_blocks)
            .withColumn("own", own)
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .select("key", "fp", (F.least("own", "other") * 65536 + F.greatest("own", "other")).alias("task"))
        )

    def compare(batches):
        for t in runs_by_key(batches, ["key", "task"]):
            run = np.zeros(t.num_rows, np.int64)
            run[key_change(t, ["key", "task"])] = 1
            fp = t.column("fp").to_numpy()
            child, root = link_rows(np.cumsum(run), fp.view(np.uint64), radius)
            yield {"u": fp[child], "v": fp[root]}

    return map_arrow(dealt.repartition("key", "task").sortWithinPartitions("key", "task"), "u long, v long", compare)


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4
) -> DataFrame:
    """(id, fingerprint, component_id, kept) for each document.

    component_id is the smallest id reachable by links of at most `radius` differing bits; kept marks that
    document. Null and empty texts share fingerprint zero and so one component; repeated texts and ids are
    ordinary rows; null ids count only in components without any other, whose component_id is null; an empty table gives an empty result; other columns of docs are ignored.
    """
    ws = Workspace(docs.sparkSession, "simhash")
    own = ws.store(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    distinct = ws.store(own.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    joined = ws.store(connected_components(ws, link_fingerprints(ws, distinct, radius)), "components")
    named = distinct.join(joined, distinct["fp"] == joined["node"], "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("component")
    )
    first = named.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = ws.store(named.join(first, "component").select("fp", "component_id"), "classes")
    ws.keep_only(own, classes)
    return own.join(classes, "fp").select(
        F.col("id").alias(id_col),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
        F.col("id").eqNullSafe(F.col("component_id")).alias("kept"),
    )


# --- similar documents --------------------------------------------------------------------------

#: Fingerprints of a sketch; its 256 bits propose candidates.
WORDS = 4


def shingles(raw: bytes, shingle: int = 5, seed: int = 42) -> np.ndarray:
    """Sorted distinct XXH64 hashes of a text's shingles; a text shorter than one is its own shingle."""
    words = raw.translate(LOWER).split()
    if not words:
        return np.zeros(0, dtype="<u8")
    whole = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(whole, seed)], dtype="<u8")
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: len(words) - shingle + 1].tolist()
    stops = (ends[shingle - 1 :] - 1).tolist()
    return np.unique(np.array([xxhash.xxh64_intdigest(whole[a:b], seed) for a, b in zip(starts, stops, strict=True)], dtype="<u8"))


def sketch(h: np.ndarray) -> list[int]:
    """WORDS independent fingerprints of a set of shingles; zeros for the empty set."""
    if not h.size:
        return [0] * WORDS
    out = []
    for k in range(WORDS):
        x = h + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64))
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        x = x ^ (x >> np.uint64(31))
        ones = np.zeros(BITS, dtype=np.int64)
        for at in range(0, x.size, 1 << 14):
            part = np.ascontiguousarray(x[at : at + (1 << 14)])
            ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(sum(1 << int(b) for b in np.flatnonzero(2 * ones > x.size)))
    return out


def bit_change(similarity: float) -> float:
    """How often a bit differs between texts whose shingle sets have this Jaccard similarity."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def plan_similar(n: int, stats: list[np.ndarray], change: float, recall: float, row_cost: float = 200.0) -> list[tuple[int, list[int], int]]:
    """(word, bits, threshold) probes: the cheapest allocation under which a pair whose bits change at that rate
    meets in some group with the wanted probability.

    The dynamic programme spends the logarithm of the chance to miss, in steps of 0.05, over the groups of all words.
    """
    need = math.ceil(-math.log(1 - recall) / 0.05)
    best, chosen = math.inf, None
    for m in range(3, 11):
        table: dict[int, tuple[float, list]] = {0: (0.0, [])}
        for word, both in enumerate(stats):
            for g in group_bits(n, both, m):
                agree = agreement(n, both, g, 2)
                choices = [(0, 0.0, None)]
                for e in (0, 1, 2):
                    meet = sum(math.comb(len(g), i) * change**i * (1 - change) ** (len(g) - i) for i in range(e + 1))
                    cost = n * math.comb(len(g), e) * row_cost + n * n / 2 * agree[e] * (1 + e)
                    choices.append((int(-math.log(1 - meet) / 0.05), cost, (word, g, e)))
                step: dict[int, tuple[float, list]] = {}
                for spent, (was, taken) in table.items():
                    for gain, cost, probe in choices:
                        now = min(need, spent + gain)
                        if was + cost < step.get(now, (math.inf, None))[0]:
                            step[now] = (was + cost, taken if probe is None else [*taken, probe])
                table = step
        price, probes = table.get(need, (math.inf, None))
        if price < best:
            best, chosen = price, probes
    return chosen


def similar_rows(key: np.ndarray, f: np.ndarray, most: int, dense: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links inside each run of equal keys; f has a row of WORDS fingerprints for each."""
    n = len(key)
    change = np.flatnonzero(key[1:] != key[:-1]) + 1
    starts, stops = np.concatenate(([0], change)), np.concatenate((change, [n]))
    size = stops - starts

    def near(a, b):  # a pair at 0.8 or more exceeds half of the allowance in one word by six standard deviations
        close = np.flatnonzero(popcount(f[a, 0] ^ f[b, 0]) <= most // 2)
        return close[popcount(f[a[close]] ^ f[b[close]]).sum(axis=1, dtype=np.int64) <= most]

    us, vs = [], []
    stop_of = np.repeat(stops, size)
    at = np.flatnonzero(np.repeat(size <= dense, size))
    gap = 1
    while at.size:
        at = at[at + gap < stop_of[at]]
        hit = at[near(at, at + gap)]
        us.append(hit)
        vs.append(hit + gap)
        gap += 1
    for a, b in zip(starts[size > dense].tolist(), stops[size > dense].tolist(), strict=True):
        own = np.arange(a, b)
        comp = np.arange(b - a)
        x, y = [], []
        for i in range(b - a):  # only rows that are still apart are compared
            apart = np.flatnonzero(comp[i + 1 :] != comp[i]) + i + 1
            hit = apart[near(np.full(apart.size, a + i), own[apart])]
            if hit.size:
                x.append(np.full(hit.size, i))
                y.append(hit)
                comp[np.isin(comp, np.append(comp[hit], comp[i]))] = min(int(comp[i]), int(comp[hit].min()))
        if x:
            us.append(a + np.concatenate(x))
            vs.append(a + np.concatenate(y))
    u = np.concatenate(us) if us else np.zeros(0, np.int64)
    v = np.concatenate(vs) if vs else np.zeros(0, np.int64)
    comp = forest(n, u, v)
    child = np.flatnonzero(comp != np.arange(n))
    return child, comp[child]


def jaccard_forest(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """Smallest position joined to each set by steps of at least this Jaccard similarity; all pairs, exactly."""
    n, size = len(sets), np.array([x.size for x in sets], dtype=np.int64)
    comp = np.arange(n)
    _, token, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    holders = np.repeat(np.arange(n), size)[np.argsort(token, kind="stable")]
    first, at = np.cumsum(count) - count, np.cumsum(size) - size
    for i in range(n):
        if (comp == comp[i]).all():
            break
        own = token[at[i] : at[i] + size[i]]
        own = own[count[own] > 1]
        c = count[own]
        places = np.repeat(first[own] - (np.cumsum(c) - c), c) + np.arange(c.sum())
        both = np.bincount(holders[places], minlength=n)
        hit = np.flatnonzero((both > 0) & (both >= similarity * (size + size[i] - both) - 1e-9) & (comp != comp[i]))
        if hit.size:
            joined = np.unique(comp[np.append(hit, i)])
            comp[np.isin(comp, joined)] = joined[0]
    return comp


def verified_links(ws: Workspace, members: DataFrame, sizes: DataFrame, similarity: float, block: int) -> DataFrame:
    """Links (u, v) that join members (component, node, s) as all pairs of a component with that similarity do.

    Components of more than `block` members, listed in sizes (component, n), are dealt into blocks that meet pairwise,
    each pair in a task of its own; a spanning forest leaves it. The few of that size are looked up without moving sets.
    """
    large = ws.store(sizes.where(F.col("n") > block), "large")
    dealt = (
        members.join(large, "component", "left")
        .withColumn("blocks", F.coalesce(F.ceil(F.col("n") / block), F.lit(1)).cast("int"))
        .withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("long"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("component", (F.least("own", "other") * (1 << 31) + F.greatest("own", "other")).alias("task"), "node", "s")
    )

    def verify(batches):
        for t in runs_by_key(batches, ["component", "task"], 1 << 10):
            cuts = [0, *key_change(t, ["component", "task"]).tolist(), t.num_rows]
            node, s = t.column("node").to_numpy(), t.column("s").to_pylist()
            us, vs = [], []
            for a, b in zip(cuts, cuts[1:], strict=False):
                comp = jaccard_forest([np.frombuffer(x, dtype="<u8") for x in s[a:b]], similarity)
                child = np.flatnonzero(comp != np.arange(b - a))
                us.append(node[a:b][child])
                vs.append(node[a:b][comp[child]])
            yield {"u": np.concatenate(us), "v": np.concatenate(vs)}

    return map_arrow(dealt.repartition("component", "task").sortWithinPartitions("component", "task"), "u long, v long", verify)


def _similar(
    docs: DataFrame, id_col: str, text_col: str, shingle: int = 5, similarity: float = 0.8, recall: float = 0.99, block: int = 8192, verify_block: int = 1024,
) -> DataFrame:
    """(id, th, component_id, kept) of similar_documents; th is the text's hash."""
    ws = Workspace(docs.sparkSession, "similar")
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    names = [f"f{k}" for k in range(WORDS)]

    def sets_of(part):
        sets = [shingles(x, shingle) for x in as_bytes(part.column("text"))]
        return sets, np.array([xxhash.xxh64_intdigest(h.tobytes()) for h in sets], dtype=np.uint64).view(np.int64)

    def make(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                sets, node = sets_of(part)
                f = np.array([sketch(h) for h in sets], dtype=np.uint64).view(np.int64)
                yield {"id": part.column("id"), "th": part.column("th"), "node": node} | {c: np.ascontiguousarray(f[:, k]) for k, c in enumerate(names)}

    def make_sets(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                sets, node = sets_of(part)
                own = np.flatnonzero(node == part.column("node").to_numpy())  # another row of the id may hold another text
                yield {"component": part.column("component").take(pa.array(own)), "node": node[own], "s": [sets[i].tobytes() for i in own]}

    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    hashed = rows.select("id", F.xxhash64("text").alias("th"), "text")
    own = ws.store(map_arrow(hashed, f"id {kind}, th long, node long, " + ", ".join(f"{c} long" for c in names), make), "sketches")
    distinct = ws.store(own.groupBy("node").agg(F.min("id").alias("least"), *(F.min(c).alias(c) for c in names)), "distinct")

    stats = [bit_statistics(distinct.select(F.col(c).alias("fp"))) for c in names]
    n = max(1, stats[0][0])
    change = bit_change(similarity)
    probes = plan_similar(n, [both for _, both in stats], change, recall)
    masks = [(word, mask) for word, bits, e in probes for mask in probe_masks([(bits, e)])]
    bits = WORDS * BITS
    most = math.ceil(bits * change + 3 * math.sqrt(bits * change * (1 - change)))

    def probe(batches):
        for batch in batches:
            f = [batch.column(c).to_numpy().view(np.uint64) for c in names]
            node = batch.column("node").to_numpy()
            step = max(1, (1 << 16) // len(masks))
            for at in range(0, node.size, step):
                part = slice(at, at + step)
                size = node[part].size
                yield {
                    "probe": np.repeat(np.arange(len(masks), dtype=np.int32), size),
                    "part": np.concatenate([f[w][part] & np.uint64(m) for w, m in masks]).view(np.int64),
                    "node": np.tile(node[part], len(masks)),
                } | {c: np.tile(f[k][part].view(np.int64), len(masks)) for k, c in enumerate(names)}

    schema = "probe int, part long, node long, " + ", ".join(f"{c} long" for c in names)
    dealt = map_arrow(distinct.select("node", *names), schema, probe)
    dealt = dealt.select(F.xxhash64("probe", "part").alias("key"), "node", *names)
    hot = ws.store(dealt.groupBy("key").count().where(F.col("count") > block), "hot-keys")
    if hot.isEmpty():
        dealt = dealt.withColumn("task", F.lit(0))
    else:
        dealt = (
            dealt.join(hot, "key", "left")
            .withColumn("blocks", F.ceil(F.coalesce("count", F.lit(1)) / block).cast("int"))
            .withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .select("key", "node", *names, (F.least("own", "other") * 65536 + F.greatest("own", "other")).alias("task"))
        )

    def compare(batches):
        for t in runs_by_key(batches, ["key", "task"], 1 << 16):
            run = np.zeros(t.num_rows, np.int64)
            run[key_change(t, ["key", "task"])] = 1
            f = np.column_stack([t.column(c).to_numpy() for c in names]).view(np.uint64)
            node = t.column("node").to_numpy()
            child, root = similar_rows(np.cumsum(run), f, most)
            yield {"u": node[child], "v": node[root]}

    links = map_arrow(dealt.repartition("key", "task").sortWithinPartitions("key", "task"), "u long, v long", compare)
    groups = ws.store(connected_components(ws, links), "candidates")
    sizes = ws.store(groups.groupBy("component").agg(F.count("*").alias("n")), "sizes")
    # sets are as long as texts: they are made again for one text of each candidate, and none is stored for the others
    wanted = ws.store(groups.join(distinct, "node").select(F.col("least").alias("wanted"), "node", "component"), "wanted")
    texts = rows.join(wanted, F.col("id").eqNullSafe(F.col("wanted"))).select("component", "node", "text")
    members = map_arrow(texts, "component long, node long, s binary", make_sets)
    members = ws.store(members.groupBy("component", "node").agg(F.first("s").alias("s")), "sets")
    joined = ws.store(connected_components(ws, verified_links(ws, members, sizes, similarity, verify_block)), "components")
    named = distinct.select("node", "least").join(joined, "node", "left").select("node", "least", F.coalesce("component", "node").alias("component"))
    first = named.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = ws.store(named.join(first, "component").select("node", "component_id"), "classes")
    ws.keep_only(own, classes)
    return own.select("id", "th", "node").join(classes, "node").select("id", "th", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, component_id, kept): near copies by the Jaccard similarity of their sets of `shingle` words.

    256-bit sketches only propose: groups of bits and thresholds are chosen so that a pair at `similarity` meets with
    the probability `recall`, and sketches of a candidate differ in at most the bits that all but one in 700 such pairs
    stay within. Inside each group that candidates connect, texts link if their sets have the similarity. Texts without
    words are copies of each other; repeated rows share a component; component_id is the smallest id that is not null,
    and null ids are kept only in groups without any other; an empty table gives an empty result; other columns of docs
    are ignored.
    """
    found = _similar(docs, id_col, text_col, **options)
    return found.select(F.col("id").alias(id_col), "component_id", "kept")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without all but the smallest id of each group of similar_documents; columns as in docs.

    Rows of one id and one text stay or go together, and rows of one id and different texts are judged apart.
    """
    gone = _similar(docs, id_col, text_col, **options).where("not kept").select(F.col("id").alias("__gone"), F.col("th").alias("__th"))
    names = [f"`{c}`" for c in docs.columns]
    same = docs[id_col].eqNullSafe(gone["__gone"]) & (F.xxhash64(docs[text_col].cast("string")) == gone["__th"])
    return docs.join(gone, same, "left_anti").select(*names)
