"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termatlas.sources.shared import open_shared, shared_root  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Workspace:
    """A folder below the shared root for the intermediate tables of one operator call."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.path = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex[:12]}"
        self._n = 0
        self.stored: set[str] = set()

    def child(self, name: str) -> str:
        self._n += 1
        return f"{self.path}/{self._n:03d}-{name}"

    def store(self, df: DataFrame, name: str, large: bool = False) -> DataFrame:
        """Write as Parquet and read again: cuts lineage and outlives lost executors.

        After a large one the driver collects its garbage, upon which Spark deletes the shuffle files behind it, which
        nothing can read any more; else they would fill disks until a collection happens by itself.
        """
        out = self.child(name)
        df.write.parquet(out)
        if large:
            self.spark._jvm.System.gc()
        stored = self.spark.read.schema(df.schema).parquet(out)
        stored.stored_at = out
        self.stored.add(out)
        return stored

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables written by store() that nothing reads any more."""
        for t in tables:
            self.stored.discard(t.stored_at)
            self.delete(t.stored_at)

    def keep_only(self, *tables: DataFrame) -> None:
        """Delete every stored table but these, once nothing else is read any more."""
        kept = {t.stored_at for t in tables}
        for path in self.stored - kept:
            self.delete(path)
        self.stored = kept

    def delete(self, path: str) -> None:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def map_arrow(
    df: DataFrame, schema: str, f: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]]
) -> DataFrame:
    """mapInArrow for a generator of {column: values}; cast to the named schema."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        for cols in f(batches):
            arrays = [
                (c if c.type == t.type else c.cast(t.type)) if isinstance(c, pa.Array) else pa.array(c, type=t.type)
                for t, c in ((t, cols[t.name]) for t in target)
            ]
            yield pa.RecordBatch.from_arrays(arrays, schema=target)
        pa.default_memory_pool().release_unused()  # workers outlive their tasks

    return df.mapInArrow(run, schema)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null becomes empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


class RecentCache(dict):
    """A dict of bounded size in two generations: entries used again outlive the next sweep.

    `most` bounds the entries of a generation and, at 24 characters each on average, their keys' characters; keys of
    over `longest` characters are never kept, so that long runs without spaces do not fill a worker's memory.
    """

    def __init__(self, make: Callable, most: int, longest: int = 64):
        super().__init__()
        self.make, self.most, self.longest, self.old, self.held = make, most, longest, {}, 0

    def __missing__(self, key):
        if len(key) > self.longest:
            return self.make(key)
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        self.held += len(key)
        if len(self) > self.most or self.held > 24 * self.most:
            self.old = dict(self)
            self.clear()
            self.held = 0
        return value


def one_row_tasks(rows: DataFrame, by: str) -> DataFrame:
    """Deal a small table of files to a task a row; an explicit number keeps the tasks apart."""
    n = max(1, rows.count())
    return rows.repartitionByRange(n, by)


def slices(batch: pa.RecordBatch, text: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Split a batch so that each piece holds about `most` bytes of the text column (one row at least)."""
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(a, b - a)


def runs_by_key(batches: Iterator[pa.RecordBatch], keys: list[str], most: int = 1 << 18) -> Iterator[pa.Table]:
    """Regroup a key-sorted stream into tables that hold whole keys, of about `most` rows."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < most:
            continue
        whole = pa.Table.from_batches(held).combine_chunks()
        last = key_change(whole, keys)
        if last.size:
            cut = int(last[-1])
            yield whole.slice(0, cut)
            rest = whole.slice(cut)
        else:
            rest = whole
        held, rows = rest.to_batches(), rest.num_rows
        if rows >= most:
            most = 2 * rows
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def key_change(t: pa.Table, keys: list[str]) -> np.ndarray:
    """Positions whose key differs from the row before."""
    change = np.zeros(max(t.num_rows - 1, 0), dtype=bool)
    for k in keys:
        v = t.column(k).to_numpy()
        change |= v[1:] != v[:-1]
    return np.flatnonzero(change) + 1


def forest(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Smallest member of each vertex's component; vertices 0..n-1, edges (u, v)."""
    comp = np.arange(n)
    while u.size:
        lo = np.minimum(comp[u], comp[v])
        before = comp.copy()
        np.minimum.at(comp, comp[u], lo)
        np.minimum.at(comp, comp[v], lo)
        while True:
            jumped = comp[comp]
            if np.array_equal(jumped, comp):
                break
            comp = jumped
        keep = comp[u] != comp[v]
        u, v = u[keep], v[keep]
        if np.array_equal(before, comp) and not u.size:
            break
    return comp


def connected_components(ws: Workspace, edges: DataFrame) -> DataFrame:
    """(node, component), a row for each node of edges(u, v): alternating large-star and small-star rounds.

    The component is the smallest node. Edges and labels stay distributed; each round is
    written to the shared folder, and the driver only sees a two-number fingerprint of it.
    """

    def mark(df: DataFrame):
        row = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v") % F.lit(1 << 40)).alias("h")).first()
        return row["n"], row["h"]

    def star(df: DataFrame, large: bool) -> DataFrame:
        if large:
            near = df.select("u", "v").union(df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        else:
            near = df.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        both = near.join(least, "u")
        if large:
            out = both.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = both.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
                least.select("u", F.col("m").alias("v"))
            )
        return out.where("u <> v").distinct()

    now = ws.store(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = mark(now)
    while seen[0]:
        after = ws.store(star(star(now, True), False), "star")
        ws.drop(now)
        now, before, seen = after, seen, mark(after)
        if seen == before:
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
