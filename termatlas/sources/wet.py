"""WET archives as rows (source_wet, record_idx, url, warc_date, text): a Python data source and a Hadoop-side reader."""

from __future__ import annotations

import glob
import io
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .shared import open_shared
from .warc import read_records

SCHEMA = "source_wet string, record_idx long, url string, warc_date string, text string"
ARROW = pa.schema([("source_wet", pa.string()), ("record_idx", pa.int64()), ("url", pa.string()), ("warc_date", pa.string()), ("text", pa.string())])


def conversions(stream, name: str) -> Iterator[tuple]:
    """Rows of a stream's conversion records; bytes that are not UTF-8 are dropped, absent fields are null."""
    at = 0
    for fields, block in read_records(stream):
        if fields.get("warc-type", [""])[0] == "conversion":
            yield name, at, fields.get("warc-target-uri", [None])[0], fields.get("warc-date", [None])[0], block.decode("utf-8", "ignore")
            at += 1


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)


def batches(rows: Iterator[tuple], most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[4])
        if size >= most:
            yield _batch(held)
            held, size = [], 0
    if held:
        yield _batch(held)


class WetFile(InputPartition):
    def __init__(self, path: str):
        self.path = path


class WetReader(DataSourceReader):
    """A partition for each file, in sorted order; gzip cannot be split."""

    def __init__(self, options: dict):
        path = re.sub(r"^file:/*(?=/)", "", options["path"])
        self.files = sorted(glob.glob(os.path.join(path, "*.wet.gz") if os.path.isdir(path) else path))
        if not self.files:
            raise FileNotFoundError(f"no WET files at {path}")

    def partitions(self) -> list[InputPartition]:
        return [WetFile(f) for f in self.files]

    def read(self, partition: WetFile) -> Iterator[pa.RecordBatch]:
        with open(partition.path, "rb") as f:
            yield from batches(conversions(f, os.path.basename(partition.path)))


class WetSource(DataSource):
    """spark.read.format("wet").load(folder or glob)."""

    @classmethod
    def name(cls) -> str:
        return "wet"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WetReader(self.options)


def read_wet(spark: SparkSession, path: str) -> DataFrame:
    """WET files that every executor sees as local paths."""
    spark.dataSource.register(WetSource)
    return spark.read.format("wet").load(path)


def read_wet_from_store(spark: SparkSession, path: str) -> DataFrame:
    """WET files in any store that Spark reads: a task gets a whole compressed file (some 100 MB) and streams through it."""

    def parse(stream):
        for batch in stream:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist(), strict=True):
                yield from batches(conversions(io.BytesIO(content), name))

    files = spark.read.format("binaryFile").load(path).selectExpr("element_at(split(path, '/'), -1) as name", "content")
    return files.mapInArrow(parse, SCHEMA)


def conversion(url: str | None, date: str | None, text: str) -> bytes:
    """A conversion record as a gzip member."""
    block = text.encode("utf-8")
    fields = [("WARC-Type", "conversion"), *((("WARC-Target-URI", url),) if url else ()), *((("WARC-Date", date),) if date else ()), ("Content-Length", str(len(block)))]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n") + z.flush()


def write_wet(docs: DataFrame, folder: str) -> DataFrame:
    """Write documents (source_wet, record_idx, url, warc_date, text) as WET files; returns (source_wet, records).

    A file is written by one task, in record order, and gets its name when it is whole, so that a lost task can run
    again. A null text is an empty one; null urls and dates are left out.
    """

    def write(stream):
        name = out = None
        n = 0

        def close():
            out.close()
            fs.move(f"{at}.{attempt}", at)
            return pa.RecordBatch.from_pydict({"source_wet": [name], "records": [n]}, schema=pa.schema([("source_wet", pa.string()), ("records", pa.int64())]))

        attempt = uuid.uuid4().hex[:8]
        for batch in stream:
            for file, url, date, text in zip(*(batch.column(c).to_pylist() for c in ("source_wet", "url", "warc_date", "text")), strict=True):
                if file != name:
                    if out is not None:
                        yield close()
                    name, n = file, 0
                    fs, at = open_shared(f"{folder}/{name}")
                    fs.create_dir(at.rpartition("/")[0], recursive=True)
                    out = fs.open_output_stream(f"{at}.{attempt}", compression=None)
                out.write(conversion(url, date, text or ""))
                n += 1
        if out is not None:
            yield close()

    ordered = docs.repartition("source_wet").sortWithinPartitions("source_wet", "record_idx")
    return ordered.select("source_wet", "url", "warc_date", "text").mapInArrow(write, "source_wet string, records long")
