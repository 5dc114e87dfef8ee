"""Embedding near-duplicates by sorted projection passes, and an exact check of what they leave apart.

A pass orders the vectors of each label lexicographically by a concatenation of random hyperplane bits and compares
each with a bounded window of those behind it; pairs found with enough cosine are united across passes. The check
follows for labels of any size: it compares the found groups of a label, file against file. A group's first vector and
the distance of its farthest member bound what its members can link with, so that only groups which may link are
compared in full, and no link is missed however dense or large a label is. Labels that lie within the window as a
whole have been compared by a pass already. Links are then counted inside each connected group, block against block,
so that a group of any size keeps all its links.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, connected_components, forest, key_change, map_arrow, open_shared, runs_by_key

BITS = 64
HEAD = 16


def usable(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, grp, h1, h2, v): rows with a label and a non-zero vector of finite parts.

    grp stands for label and length, h1 and h2 for the vector.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("label").isNotNull() & F.col("v").isNotNull() & fine & F.exists("v", lambda x: x != 0))
    return rows.select("id", F.xxhash64("label", F.size("v")).alias("grp"), F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), F.reverse("v")).alias("h2"), "v")


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of equally long lists as a matrix of unit vectors."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that no square overflows or vanishes
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def passes_needed(rows: int, window: int, threshold: float, miss: float) -> int:
    """Passes for a miss of at most `miss` before the exact check, if each bit halves a label's rows."""
    angle = math.acos(threshold) / math.pi
    bits = max(0.0, math.log2(max(rows, 1) / window)) + 1
    meet = (1 - angle) ** bits
    return max(4, math.ceil(math.log(miss) / math.log(1 - meet))) if meet < 1 else 4


def planes(dim: int, number: int, seed: int = 17) -> np.ndarray:
    return np.random.default_rng([seed, number, dim]).standard_normal((dim, BITS))


def signatures(x: np.ndarray, number: int) -> np.ndarray:
    """Concatenated hyperplane bits as signed longs that sort as the bits do."""
    bits = (x @ planes(x.shape[1], number) > 0).astype(np.uint8)
    return (np.packbits(bits, axis=1).view(">u8").ravel().astype(np.uint64) ^ np.uint64(1 << 63)).view(np.int64)


def window_links(key: np.ndarray, x: np.ndarray, window: int, threshold: float) -> np.ndarray:
    """Smallest position joined to each row by links between rows of equal key at most `window` apart."""
    us, vs = [], []
    for gap in range(1, min(window, len(key) - 1) + 1):
        hit = np.flatnonzero((key[gap:] == key[:-gap]) & ((x[gap:] * x[:-gap]).sum(axis=1) >= threshold))
        us.append(hit)
        vs.append(hit + gap)
    return forest(len(key), np.concatenate(us), np.concatenate(vs)) if us else np.arange(len(key))


def row_depths(grp: np.ndarray, sig: np.ndarray, window: int) -> np.ndarray:
    """Leading bits to share with a sorted row so as to lie within `window` of it, for all but the window + 1 rows at
    either end; 65 if no number of bits is enough."""
    w = window + 1
    x = (sig[w:] ^ sig[:-w]).view(np.uint64)
    for shift in (1, 2, 4, 8, 16, 32):
        x = x | (x >> np.uint64(shift))
    shared = np.where(grp[w:] == grp[:-w], BITS - np.bitwise_count(x).astype(np.int64), -1)
    return np.maximum(shared[:-w], shared[w:]) + 1


def some_passes(ws: Workspace, classes: DataFrame, numbers: list[int], window: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Links (u, v) of some orderings, sorted in one shuffle, and counts (grp, number, settled) of the rows of a label
    that have been compared with all of it.

    Tasks slide over their rows and hold a window of them; the ends of neighbouring partitions are compared too.
    """
    vector = classes.schema["v"].dataType.simpleString()
    none = pa.list_(pa.float32() if "float" in vector else pa.float64())

    def apart(number):
        return (np.asarray(number).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)

    def sign(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            lists, grp = batch.column("v"), batch.column("grp").to_numpy()
            dims = np.diff(lists.offsets.to_numpy())
            for number in numbers:
                sig = np.zeros(batch.num_rows, dtype=np.int64)
                for d in np.unique(dims):
                    at = np.flatnonzero(dims == d)
                    sig[at] = signatures(matrix(lists.take(pa.array(at))), number)
                yield {"id": batch.column("id"), "number": np.full(grp.size, number), "grp": grp ^ apart(number), "sig": sig, "v": lists}

    def linked(ids: np.ndarray, key: np.ndarray, lists: pa.Array):
        for a, b in _same_size(lists):
            root = window_links(key[a:b], matrix(lists.slice(a, b - a)), window, threshold)
            child = np.flatnonzero(root != np.arange(b - a))
            if child.size:
                yield ids[a:b][child], ids[a:b][root[child]]

    def ends(t: pa.Table, edge: int, place: int) -> dict:
        n, ids = t.num_rows, t.column("id").to_numpy()
        return {"u": ids, "v": ids, "edge": np.full(n, edge), "place": np.arange(n) + place, "grp": t.column("grp").to_numpy(), "x": t.column("v").combine_chunks()}

    def settled(t: pa.Table, rows: np.ndarray) -> dict:
        number = t.column("number").to_numpy()[rows]
        grp = t.column("grp").to_numpy()[rows] ^ apart(number)
        return {"u": number, "v": number, "edge": np.full(rows.size, -2), "place": number, "grp": grp, "x": pa.nulls(rows.size, none)}

    def slide(batches):
        here, held, seen, w = TaskContext.get().partitionId(), None, None, window + 1
        for batch in batches:
            for at in range(0, batch.num_rows, 1 << 13):
                new = pa.Table.from_batches([batch.slice(at, 1 << 13)])
                bare = new.select(["number", "grp", "sig"])
                seen = bare if seen is None else pa.concat_tables([seen, bare]).combine_chunks()
                if seen.num_rows > 2 * w:  # rows at a partition's ends are left to the exact check
                    depth = row_depths(seen.column("grp").to_numpy(), seen.column("sig").to_numpy(), window)
                    yield settled(seen, w + np.flatnonzero(depth == 0))
                    seen = seen.slice(seen.num_rows - 2 * w)
                if held is None:
                    yield ends(new.slice(0, window), here - 1, window)
                    t = new
                else:
                    t = pa.concat_tables([held, new]).combine_chunks()
                for u, v in linked(t.column("id").to_numpy(), t.column("grp").to_numpy(), t.column("v").combine_chunks()):
                    zero = np.zeros(u.size, dtype=np.int64)
                    yield {"u": u, "v": v, "edge": zero - 1, "place": zero, "grp": zero, "x": pa.nulls(u.size, none)}
                held = t.slice(max(0, t.num_rows - window))
        if held is not None:
            yield ends(held, here, 0)

    def meet(batches):
        for t in runs_by_key(batches, ["edge"], 1 << 13):
            key = t.column("edge").to_numpy().astype(np.int64) * 1_000_003 + t.column("grp").to_numpy()
            for u, v in linked(t.column("u").to_numpy(), key, t.column("x").combine_chunks()):
                yield {"u": u, "v": v}

    signed = map_arrow(classes.select("id", "grp", "v"), f"id long, number int, grp long, sig long, v {vector}", sign)
    ordered = signed.repartitionByRange("grp", "sig", "id").sortWithinPartitions("grp", "sig", "id")
    found = ws.store(map_arrow(ordered, f"u long, v long, edge int, place int, grp long, x {vector}", slide), "pass")
    border = found.where("edge >= 0").repartition("edge").sortWithinPartitions("edge", "place")
    links = found.where("edge = -1 and x is null").select("u", "v").union(map_arrow(border, "u long, v long", meet))
    links = ws.store(links, "links")
    done = found.where("edge = -2").groupBy("grp", F.col("place").alias("number")).agg(F.count("*").alias("settled"))
    done = ws.store(done, "settled", large=True)
    ws.drop(found)
    return links, done


def _same_size(lists: pa.Array):
    """Runs of rows whose lists have one length."""
    if not len(lists):
        return
    dims = np.diff(lists.offsets.to_numpy())
    cuts = [0, *(np.flatnonzero(np.diff(dims)) + 1).tolist(), len(dims)]
    yield from zip(cuts, cuts[1:], strict=False)


def enough_passes(
    ws: Workspace, classes: DataFrame, sizes: DataFrame, window: int, threshold: float, miss: float, at_once: int
) -> tuple[DataFrame, DataFrame]:
    """Links (u, v) of passes over labels of sizes (grp, n), and the labels (grp) of which one pass has compared all pairs."""
    passes = passes_needed(sizes.agg(F.max("n")).first()[0] or 0, window, threshold, miss)
    links = settled = None
    for number in range(0, passes, at_once):
        found, done = some_passes(ws, classes, list(range(number, min(number + at_once, passes))), window, threshold)
        links, settled = (found, done) if links is None else (links.union(found), settled.union(done))
    whole = settled.join(sizes, "grp").where("settled = n").select("grp").distinct()
    return links, ws.store(whole, "whole")


def write_groups(ws: Workspace, rows: DataFrame, most: int) -> DataFrame:
    """(path, lo, hi): files of at most `most` rows (id, grp, c, v) in the order of grp and c, and their end labels."""
    folder = ws.child("groups")
    values = 1 << 22

    def write(batches):
        held, n = [], 0

        def flush():
            t = pa.Table.from_batches(held).combine_chunks()
            fs, path = open_shared(f"{folder}/{uuid.uuid4().hex}.arrow")
            fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
            with fs.open_output_stream(path) as f, pa.ipc.new_stream(f, t.schema) as w:
                w.write_table(t)
            return {"path": [f"{folder}/{path.rsplit('/', 1)[1]}"], "lo": [t.column("grp")[0].as_py()], "hi": [t.column("grp")[-1].as_py()]}

        for batch in batches:
            while batch.num_rows:
                longest = max(1, int(np.diff(batch.column("v").offsets.to_numpy()).max()))
                room = max(1, min(most, values // longest)) - n
                if room <= 0:
                    yield flush()
                    held, n = [], 0
                    continue
                held.append(batch.slice(0, room))
                n += held[-1].num_rows
                batch = batch.slice(room)
        if n:
            yield flush()

    ordered = rows.select("grp", "c", "id", "v").repartitionByRange("grp", "c", "id").sortWithinPartitions("grp", "c", "id")
    return ws.store(map_arrow(ordered, "path string, lo long, hi long", write), "files", large=True)


class Groups:
    """The groups of a label in a file: their first vectors, the distance of the farthest member, bounds for a screen."""

    def __init__(self, t: pa.Table, threshold: float):
        c = t.column("c").to_numpy()
        self.x = matrix(t.column("v").combine_chunks())
        self.at = np.concatenate(([0], np.flatnonzero(c[1:] != c[:-1]) + 1))
        self.size = np.diff(np.append(self.at, len(c)))
        self.c, self.id, self.lead = c[self.at], t.column("id").to_numpy()[self.at], self.x[self.at]
        apart = self.x - np.repeat(self.lead, self.size, axis=0)
        r = np.maximum.reduceat(np.sqrt((apart * apart).sum(axis=1)), self.at)
        # members link only if lead * lead' + r r' + f(r) + f(r') reaches the threshold; a dot product is at most that
        # of the heads and the product of the tails' lengths
        f = math.sqrt(2 - 2 * threshold) * r + r * r / 2
        head = self.lead[:, :HEAD]
        tail = np.sqrt(np.maximum(0, 1 - (head * head).sum(axis=1)))
        one = np.ones_like(r)
        self.bound = [np.column_stack((v, r, *x)) for v in (np.column_stack((head, tail)), self.lead) for x in ((f, one), (one, f))]
        self.screen = [x.astype(np.float32) for x in self.bound[:2]]

    def rows(self, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the groups' members, and the group of each."""
        size = self.size[groups]
        first = np.repeat(self.at[groups] - np.concatenate(([0], np.cumsum(size)[:-1])), size)
        return first + np.arange(size.sum()), np.repeat(groups, size)


def linked_to(group: np.ndarray, other: Groups, candidates: np.ndarray, threshold: float) -> np.ndarray:
    """Those of the candidate groups that have a member linked to one of the vectors."""
    at, owner = other.rows(candidates)
    hit = np.zeros(at.size, dtype=bool)
    step = 1 << 11
    for r in range(0, at.size, step):
        y = other.x[at[r : r + step]].T
        for q in range(0, len(group), step):
            hit[r : r + step] |= (group[q : q + step] @ y >= threshold).any(axis=0)
    return np.unique(owner[hit])


def group_links(a: Groups, b: Groups, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between groups of a and of b (which may be a), as the ids of their first members."""
    same, na, slack = a is b, a.at.size, 1e-4
    ids = a.id if same else np.concatenate((a.id, b.id))
    shift = 0 if same else na
    comp = np.arange(ids.size)
    for p in range(0, na, 1024):
        for q in range(p if same else 0, b.at.size, 8192):
            near = a.screen[0][p : p + 1024] @ b.screen[1][q : q + 8192].T >= threshold - slack
            some = np.count_nonzero(near)
            if some > near.size // 50:
                near = a.bound[2][p : p + 1024] @ b.bound[3][q : q + 8192].T >= threshold - 1e-9
            i, j = np.nonzero(near)
            i, j = i + p, j + q
            keep = (a.c[i] != b.c[j]) & (comp[i] != comp[j + shift])
            i, j = i[keep], j[keep]
            us, vs = [], []
            for r in range(0, i.size, 1 << 16):
                x, y = i[r : r + (1 << 16)], j[r : r + (1 << 16)]
                full = (a.bound[2][x] * b.bound[3][y]).sum(axis=1) >= threshold - 1e-9
                x, y = x[full], y[full]
                alone = (a.size[x] == 1) & (b.size[y] == 1)
                us.append(x[alone])
                vs.append(y[alone])
                fit = (a.lead[us[-1]] * b.lead[vs[-1]]).sum(axis=1) >= threshold
                us[-1], vs[-1] = us[-1][fit], vs[-1][fit]
                wide = a.size[x] > 1
                for g in np.unique(x[wide]):
                    hit = linked_to(a.x[a.at[g] : a.at[g] + a.size[g]], b, y[x == g], threshold)
                    us.append(np.full(hit.size, g))
                    vs.append(hit)
                x, y = x[~wide & ~alone], y[~wide & ~alone]
                for g in np.unique(y):
                    hit = linked_to(b.x[b.at[g] : b.at[g] + b.size[g]], a, x[y == g], threshold)
                    us.append(hit)
                    vs.append(np.full(hit.size, g))
            if us:
                u, v = np.concatenate(us), np.concatenate(vs) + shift
                child = np.flatnonzero(comp != np.arange(comp.size))
                comp = forest(comp.size, np.concatenate((u, child)), np.concatenate((v, comp[child])))
    child = np.flatnonzero(comp != np.arange(comp.size))
    return ids[child], ids[comp[child]]


def exact_check(ws: Workspace, rows: DataFrame, threshold: float, most: int) -> DataFrame:
    """Links (u, v) that join the groups c of rows (id, grp, c, v) as all links within labels do.

    Files of one order share a label only at their ends: pairs of files meet in tasks that read both.
    """
    files = write_groups(ws, rows, most)
    ends = files.select("path", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("g"))
    both = ends.join(ends.select(F.col("path").alias("right"), "g"), "g").where("path < right").select("path", "right", "g")
    alone = files.select("path", F.col("path").alias("right"), F.lit(None).cast("long").alias("g"))
    pairs = ws.store(both.union(alone), "pairs")
    tasks = max(1, min(pairs.count(), 4 * files.count()))

    def load(uri):
        fs, path = open_shared(uri)
        with fs.open_input_stream(path) as f, pa.ipc.open_stream(f) as r:
            return r.read_all().combine_chunks()

    def label(t: pa.Table, g: int) -> pa.Table:
        at = np.flatnonzero(t.column("grp").to_numpy() == g)
        return t.slice(int(at[0]), at.size)

    def compare(batches):
        left = path = left_of = groups = None
        for batch in batches:
            for row in batch.to_pylist():
                if row["path"] != path:
                    path, left, left_of = row["path"], load(row["path"]), None
                if row["g"] is None:
                    cuts = [0, *key_change(left, ["grp"]).tolist(), left.num_rows]
                    found = []
                    for x, y in zip(cuts, cuts[1:], strict=False):
                        if y - x > 1:
                            own = Groups(left.slice(x, y - x), threshold)
                            found.append(group_links(own, own, threshold))
                else:
                    if left_of != row["g"]:
                        left_of, groups = row["g"], Groups(label(left, row["g"]), threshold)
                    found = [group_links(groups, Groups(label(load(row["right"]), row["g"]), threshold), threshold)]
                if found:
                    u, v = zip(*found, strict=True)
                    yield {"u": np.concatenate(u), "v": np.concatenate(v)}

    dealt = pairs.repartitionByRange(tasks, "path", "right").sortWithinPartitions("path", "right")
    return ws.store(map_arrow(dealt, "u long, v long", compare), "missed")


def count_links(ws: Workspace, members: DataFrame, sizes: DataFrame, threshold: float, block: int) -> DataFrame:
    """(id, others) for members (component, id, m, v): summed m of the classes linked to each, all pairs of blocks.

    sizes (component, n) counts the members. Blocks of a component meet pairwise, each pair in a task of its own; only sums leave it.
    """
    # the few components of several blocks, read back with their true size: vectors need not move to learn of them
    large = ws.store(sizes.where(F.col("n") > block), "large")
    dealt = (
        members.join(large, "component", "left")
        .withColumn("blocks", F.coalesce(F.ceil(F.col("n") / block), F.lit(1)).cast("int"))
        .withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("component", (F.least("own", "other") * 65536 + F.greatest("own", "other")).cast("long").alias("task"), "own", "id", "m", "v")
    )

    def count(batches):
        for t in runs_by_key(batches, ["component", "task"], 1 << 12):
            cuts = [0, *key_change(t, ["component", "task"]).tolist(), t.num_rows]
            ids, m, own = t.column("id").to_numpy(), t.column("m").to_numpy(), t.column("own").to_numpy()
            v, task = t.column("v").combine_chunks(), t.column("task").to_numpy()
            for a, b in zip(cuts, cuts[1:], strict=False):
                x = matrix(v.slice(a, b - a))
                cross = task[a] // 65536 != task[a] % 65536
                others = np.zeros(b - a, dtype=np.int64)
                for r in range(0, b - a, 1024):
                    near = x[r : r + 1024] @ x.T >= threshold
                    if cross:
                        near &= own[a + r : min(a + r + 1024, b), None] != own[None, a:b]
                    else:
                        near[np.arange(near.shape[0]), r + np.arange(near.shape[0])] = False
                    others[r : r + 1024] = near @ m[a:b]
                yield {"id": ids[a:b], "others": others}

    rows = dealt.repartition("component", "task").sortWithinPartitions("component", "task")
    return map_arrow(rows, "id long, others long", count).groupBy("id").agg(F.sum("others").alias("others"))


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    threshold: float = 0.93, window: int = 64, miss: float = 0.001, block: int = 4096, at_once: int = 4, exact: int = 32768,
) -> DataFrame:
    """(id, n_links, component_id, kept) for each row; ids are integers.

    Vectors link if their labels are equal and not null and their cosine in doubles is at least threshold; vectors
    that are null, zero or hold null or non-finite parts link with nothing, nor do vectors of different lengths.
    The passes' number follows from `miss`; files of the check that follows hold up to `exact` rows. Neither changes
    the result. Equal vectors of a label form one class, whose copies all link. Rows that repeat an id have the largest count
    and smallest component of them; an empty table gives an empty result; other columns are ignored.
    """
    ws = Workspace(vectors.sparkSession, "embeddings")
    rows = usable(vectors, id_col, vector_col, label_col)
    same = ["grp", "h1", "h2"]
    classes = ws.store(rows.groupBy(*same).agg(F.min("id").alias("id"), F.count("*").alias("m"), F.first("v").alias("v")), "classes")
    sizes = ws.store(classes.groupBy("grp").agg(F.count("*").alias("n")), "sizes")

    links, whole = enough_passes(ws, classes, sizes, window, threshold, miss, at_once)
    joined = ws.store(connected_components(ws, links), "components")
    open_rows = classes.join(whole, "grp", "left_anti").join(joined, F.col("id") == F.col("node"), "left")
    missed = exact_check(ws, open_rows.select("id", "grp", F.coalesce("component", "id").alias("c"), "v"), threshold, exact)
    if not missed.isEmpty():
        known = joined.where("node <> component").select(F.col("node").alias("u"), F.col("component").alias("v"))
        joined = ws.store(connected_components(ws, known.union(missed)), "components")

    members = joined.join(classes, F.col("node") == F.col("id")).select("component", "id", "m", "v")
    linked = count_links(ws, members, joined.groupBy("component").agg(F.count("*").alias("n")), threshold, block)
    known = ws.store(
        classes.join(joined, F.col("id") == F.col("node"), "left").join(linked, "id", "left").select(
            *same, F.coalesce("component", "id").alias("component_id"), (F.coalesce("others", F.lit(0)) + F.col("m") - 1).alias("n_links")
        ),
        "known",
    )
    ws.keep_only(known)
    of_id = rows.drop("v").join(known, same).groupBy("id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    own = F.col("__own").cast("long")
    component = F.coalesce("component_id", own)
    return (
        vectors.select(F.col(id_col).alias("__own")).join(of_id, own == F.col("id"), "left")
        .select(F.col("__own").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (own == component).alias("kept"))
    )
