"""WARC archives of captures, and their assembly from single records.

A capture is three records: the request, the response (or a revisit of an earlier equal payload) and a metadata
record. Request and metadata name the response in WARC-Concurrent-To. Reading joins records through these
identifiers, whichever side holds them and over one record between, and gives one nested row for each capture.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termatlas.sources.warc import read_records

from .common import Workspace, map_arrow, one_row_tasks, open_shared, slices

REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "record_id string, type string, concurrent_to array<string>, target string, date string, fields map<string,string>, block binary"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(role: str, page: object) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{role}|{page}'.encode()).digest(), version=5)}>"


def record(kind: str, own_id: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member."""
    head = [("WARC-Type", kind), ("WARC-Record-ID", own_id), *fields, ("Content-Length", str(len(block)))]
    raw = b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def one_line(x: str | None) -> str:
    return " ".join((x or "").split())


def first_captures(pages: DataFrame, least_bytes: int) -> DataFrame:
    """(id, refers_to) of the pages whose payload an earlier id has; counted with map-side sums, so that a payload
    of any number of copies is no single task's."""
    keyed = pages.select("id", F.sha1(F.col("html").cast("binary")).alias("digest"), F.octet_length("html").alias("n"))
    keyed = keyed.where(F.col("n") >= least_bytes)
    first = keyed.groupBy("digest").agg(F.min("id").alias("refers_to"), F.count("*").alias("copies")).where("copies > 1")
    return keyed.join(first, "digest").where("id <> refers_to").select("id", "refers_to").distinct()


def write_archives(
    ws: Workspace, pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z",
) -> DataFrame:
    """Write every page as a capture; returns (shard, path, n) with a row for each archive.

    Null html counts as empty, a null url as an empty target. Of equal payloads of at least least_bytes the smallest
    id is the response and the others revisit it; rows that repeat an id repeat its record type. File names belong to
    one attempt of a task, and only finished ones are named in the result.
    """
    folder = ws.child("archives")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    refers = ws.store(first_captures(rows, least_bytes), "refers")
    joined = rows.join(refers, "id", "left")

    def write(batches):
        out, shard, n = None, TaskContext.get().partitionId(), 0
        path = f"{folder}/{shard:06d}-{uuid.uuid4().hex[:8]}.warc.gz"
        for batch in batches:
            for part in slices(batch, "html"):
                if out is None:
                    fs, at = open_shared(path)
                    fs.create_dir(at.rpartition("/")[0], recursive=True)
                    out = fs.open_output_stream(at, compression=None)
                    out.write(record("warcinfo", record_id("warcinfo", path), [("WARC-Date", date), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
                cols = (part.column(c).to_pylist() for c in ("id", "url", "html", "refers_to"))
                for page, url, html, refers_to in zip(*cols, strict=True):
                    payload = html.encode("utf-8", "surrogatepass")
                    target, own = one_line(url), record_id("response", page)
                    common = [("WARC-Target-URI", target), ("WARC-Date", date)]
                    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
                    ask = f"GET {target} HTTP/1.1\r\n\r\n".encode()
                    about = [f"payload-bytes: {len(payload)}"]
                    if page is not None:
                        about.append(f"page-id: {page}")
                    fields = [*common, ("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("Content-Type", "application/http; msgtype=response")]
                    if refers_to is None:
                        main = record("response", own, fields, http + payload)
                    else:
                        fields += [("WARC-Profile", REVISIT), ("WARC-Refers-To", record_id("response", refers_to))]
                        about.append(f"refers-to-page: {refers_to}")
                        main = record("revisit", own, fields, http)
                    near = ("WARC-Concurrent-To", own)
                    out.write(record("request", record_id("request", page), [*common, near, ("Content-Type", "application/http; msgtype=request")], ask))
                    out.write(main)
                    out.write(record("metadata", record_id("metadata", page), [*common, near, ("Content-Type", "application/warc-fields")], "".join(x + "\r\n" for x in about).encode()))
                    n += 1
        if out is not None:
            out.close()
            yield {"shard": [shard], "path": [path], "n": [n]}

    return ws.store(map_arrow(joined, "shard int, path string, n long", write), "archive-list")


CAPTURES = ("response", "revisit")


def read_archives(archives: DataFrame, captures: bool, batch_bytes: int = 4 << 20) -> DataFrame:
    """The records of the archives, a task for each; warcinfo is left out.

    captures=True gives responses and revisits; else they come as heads, without fields and block, beside the rest.
    """

    def read(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                fs, at = open_shared(path)
                with fs.open_input_stream(at, compression=None) as stream:
                    rows, size = [], 0
                    for f, block in read_records(stream):
                        main = f["warc-type"][0] in CAPTURES
                        if f["warc-type"][0] == "warcinfo" or captures > main:
                            continue
                        bare = main and not captures
                        fields = [(k, v[0]) for k, v in f.items() if k not in ("warc-type", "warc-record-id", "warc-concurrent-to", "warc-target-uri", "warc-date", "content-length")]
                        rows.append((f["warc-record-id"][0], f["warc-type"][0], f.get("warc-concurrent-to", []), f.get("warc-target-uri", [""])[0], f.get("warc-date", [""])[0], [] if bare else fields, b"" if bare else block))
                        size += len(rows[-1][-1]) + 500
                        if size >= batch_bytes:
                            yield dict(zip(("record_id", "type", "concurrent_to", "target", "date", "fields", "block"), zip(*rows, strict=True), strict=True))
                            rows, size = [], 0
                    if rows:
                        yield dict(zip(("record_id", "type", "concurrent_to", "target", "date", "fields", "block"), zip(*rows, strict=True), strict=True))

    return map_arrow(one_row_tasks(archives, "shard").select("path"), RECORD, read)


def transaction_keys(ws: Workspace, heads: DataFrame) -> DataFrame:
    """(record_id, capture): the response or revisit that a record is concurrent to, itself for those two.

    Identifiers may stand on either record; one record between is bridged. Records without any capture have none.
    """
    captures = heads.where("type in ('response', 'revisit')").select(F.col("record_id").alias("capture")).distinct()
    links = heads.select("record_id", F.explode("concurrent_to").alias("other"))
    links = links.union(links.select("other", "record_id")).where("record_id <> other").distinct()
    own = captures.select(F.col("capture").alias("record_id"), "capture")
    direct = links.join(captures, F.col("other") == F.col("capture")).groupBy("record_id").agg(F.min("capture").alias("capture"))
    direct = ws.store(own.union(direct.join(captures.select(F.col("capture").alias("record_id")), "record_id", "left_anti")), "direct")
    rest = links.join(direct.select("record_id"), "record_id", "left_anti")
    bridged = rest.join(direct.withColumnRenamed("record_id", "other"), "other").groupBy("record_id").agg(F.min("capture").alias("capture"))
    return ws.store(direct.union(bridged), "keys")


def assemble(ws: Workspace, archives: DataFrame) -> DataFrame:
    """One nested row for each capture: capture, type, target, date, fields, block, requests, metadata.

    requests and metadata are arrays of {record_id, target, date, fields, block} ordered by identifier, empty if
    none belongs to the capture. Requests and metadata without a capture are not captures and give no row.
    """
    heads = ws.store(read_archives(archives, captures=False), "heads")
    short = lambda c: F.unhex(F.md5(c))  # noqa: E731  16 bytes in place of an identifier's text
    keys = transaction_keys(ws, heads.select(short(F.col("record_id")).alias("record_id"), "type", F.transform("concurrent_to", short).alias("concurrent_to")))
    heads = heads.withColumn("key", short(F.col("record_id")))
    keys = keys.select(F.col("record_id").alias("key"), F.col("capture").alias("of"))
    # planned as small, like the list of archives it comes from: the hint keeps payloads from being broadcast
    main = read_archives(archives, captures=True).hint("merge")
    part = F.struct("record_id", "target", "date", "fields", "block")
    others = (
        heads.where("type in ('request', 'metadata')").join(keys, "key")
        .groupBy("of")
        .agg(F.collect_list(F.when(F.col("type") == "request", part)).alias("requests"), F.collect_list(F.when(F.col("type") == "metadata", part)).alias("metadata"))
    )
    return (
        main.withColumnRenamed("record_id", "capture").join(others, short(F.col("capture")) == F.col("of"), "left")
        .select("capture", "type", "target", "date", "fields", "block", F.coalesce("requests", F.array()).alias("requests"), F.coalesce("metadata", F.array()).alias("metadata"))
    )


def captures_of_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Write pages as archives, read them back and describe each capture: (id, payload_bytes, payload_digest,
    record_type, refers_to, payload).

    An empty table gives an empty result; a null id stays null and is always a response; other columns are ignored.
    Record identifiers are made of ids: repeated rows share them and their description, and an id is expected to name
    one payload. payload is what the archive holds: null for revisits.
    """
    kind = pages.select(id_col).schema[0].dataType.simpleString()
    ws = Workspace(pages.sparkSession, "warc")
    nested = assemble(ws, write_archives(ws, pages, id_col, url_col, html_col, least_bytes))
    about = F.coalesce(F.element_at(F.transform("metadata", lambda m: m["block"].cast("string")), 1), F.lit(""))
    field = lambda name: F.nullif(F.regexp_extract(about, rf"(?m)^{name}: (.*?)\r?$", 1), F.lit(""))

    def payloads(batches):
        for batch in batches:
            out = {"id": batch.column("id"), "record_type": batch.column("type"), "refers_to": batch.column("refers_to"), "payload_bytes": [], "payload_digest": [], "payload": []}
            for kind, block, told, size in zip(*(batch.column(c).to_pylist() for c in ("type", "block", "told", "size")), strict=True):
                payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
                if payload is not None and f"sha1:{digest(payload)}" != told:
                    raise ValueError(f"payload digest {told} does not match its payload")
                out["payload"].append(payload)
                out["payload_bytes"].append(len(payload) if payload is not None else size)
                out["payload_digest"].append(told.removeprefix("sha1:"))
            yield out

    flat = nested.select(
        field("page-id").cast(kind).alias("id"), "type", "block", F.col("fields")["warc-payload-digest"].alias("told"),
        field("payload-bytes").cast("long").alias("size"), field("refers-to-page").cast(kind).alias("refers_to"),
    )
    schema = f"id {kind}, payload_bytes long, payload_digest string, record_type string, refers_to {kind}, payload binary"
    return map_arrow(flat, schema, payloads).withColumnRenamed("id", id_col)
