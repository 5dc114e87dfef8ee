"""Token ids in bit-packed files.

Each id takes the fewest bits that hold the vocabulary. A file is a sequence of blocks of BLOCK ids (the last may
be shorter), each starting on a byte; behind them stand the block offsets, the document ids and where each
document's ids start, and a fixed-size trailer:

    blocks | uint64 block offsets | int64 document ids | uint64 starts (documents + 1) | trailer

The trailer is MAGIC, bits, ids in a block, and the numbers of blocks, documents, ids and documents without an id,
which come first and have 0 in the list of document ids. Bits are filled from the
lowest upwards, so 8, 16 and 32 bits are plain little-endian integers. Documents go to files by ranges of their id,
and files are numbered in that order.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RecentCache, Workspace, map_arrow, one_row_tasks, open_shared, slices

MAGIC = b"TID2"
TRAILER = struct.Struct("<4sIQQQQQ")
BLOCK = 8192


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    spread = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(spread.ravel(), bitorder="little").tobytes()


def unpack_bits(raw: bytes, bits: int, n: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(raw, dtype=f"<u{bits // 8}", count=n).astype("<u4")
    spread = np.unpackbits(np.frombuffer(raw, dtype=np.uint8), bitorder="little")[: n * bits].reshape(n, bits)
    wide = np.zeros((n, 32), dtype=np.uint8)
    wide[:, :bits] = spread
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").ravel()


class Writer:
    """Appends documents to one file; holds less than a block of ids."""

    def __init__(self, out, bits: int, block: int = BLOCK):
        self.out, self.bits, self.block = out, bits, block
        self.held, self.n_held, self.at = [], 0, 0
        self.offsets, self.docs, self.starts, self.n, self.nulls = [], [], [], 0, 0

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        if doc is None:
            if self.nulls < len(self.docs):
                raise ValueError("documents without an id come first")
            self.nulls += 1
        self.docs.append(doc or 0)
        self.starts.append(self.n)
        self.n += ids.size
        self.held.append(ids)
        self.n_held += ids.size
        if self.n_held >= self.block:
            ids = np.concatenate(self.held)
            whole = ids.size - ids.size % self.block
            for a in range(0, whole, self.block):
                self._put(ids[a : a + self.block])
            self.held, self.n_held = [ids[whole:]], ids.size - whole

    def _put(self, ids: np.ndarray) -> None:
        raw = pack_bits(ids, self.bits)
        self.offsets.append(self.at)
        self.at += len(raw)
        self.out.write(raw)

    def close(self) -> None:
        if self.n_held:
            self._put(np.concatenate(self.held))
        self.out.write(np.array(self.offsets, dtype="<u8").tobytes())
        self.out.write(np.array(self.docs, dtype="<i8").tobytes())
        self.out.write(np.array([*self.starts, self.n], dtype="<u8").tobytes())
        self.out.write(TRAILER.pack(MAGIC, self.bits, self.block, len(self.offsets), len(self.docs), self.n, self.nulls))
        self.out.close()


class Reader:
    """Random access to one file's documents and ids."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        magic, self.bits, self.block, blocks, docs, self.n, self.nulls = TRAILER.unpack(self._at(size - TRAILER.size, TRAILER.size))
        if magic != MAGIC:
            raise ValueError("not a token file")
        at = size - TRAILER.size - 8 * (blocks + 2 * docs + 1)
        self.end = at
        index = self._at(at, 8 * (blocks + 2 * docs + 1))
        self.offsets = np.frombuffer(index, "<u8", blocks).astype(np.int64)
        self.docs = np.frombuffer(index, "<i8", docs, 8 * blocks)
        self.starts = np.frombuffer(index, "<u8", docs + 1, 8 * (blocks + docs)).astype(np.int64)

    def _at(self, at: int, size: int) -> bytes:
        self.source.seek(at)
        return self.source.read(size)

    def ids(self, a: int, b: int) -> np.ndarray:
        """Ids a..b-1 of the file, from the blocks that hold them."""
        if a >= b:
            return np.zeros(0, dtype="<u4")
        first, last = a // self.block, (b - 1) // self.block
        stop = int(self.offsets[last + 1]) if last + 1 < self.offsets.size else self.end
        at = int(self.offsets[first])
        raw, out = self._at(at, stop - at), []
        for k in range(first, last + 1):
            n = min(self.block, self.n - k * self.block)
            size = (n * self.bits + 7) // 8
            p = int(self.offsets[k]) - at
            out.append(unpack_bits(raw[p : p + size], self.bits, n))
        return np.concatenate(out)[a - first * self.block : b - first * self.block]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.starts[i + 1]))


#: Pieces that a lower-casing, space-dropping vocabulary splits into a run of letters and a run of signs.
PLAIN = re.compile(r"([A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+)([!-&(-/:-@\[-`{-~]*)")
#: The normalizers and the pattern of such vocabulary files.
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class Encoder:
    """The tokenizers library behind caches of words.

    Where the vocabulary file drops white space, nothing joins what stands on its two sides, and pieces between
    spaces and line ends are encoded once; pieces of letters and signs share their lower-cased words. Files of any
    other kind get whole texts.
    """

    def __init__(self, path: str, cached: int = 450_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        splits = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        self.by_piece = steps == NORMALIZERS and bool(splits) and splits[0].get("pattern") == {"Regex": SPLIT}
        self.signs = {t["content"] for t in spec.get("added_tokens", [])}
        self.pieces = RecentCache(self._piece, cached)
        self.words = RecentCache(self._word, cached)
        self.model = self.tokenizer.model

    def _text(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _word(self, word: str) -> bytes:
        # the library's model alone: an ASCII run of letters or of signs is one pre-token, written as it is
        if word.isascii():
            return array("I", [t.id for t in self.model.tokenize(word)]).tobytes()
        return self._text(word)

    def _piece(self, piece: str) -> bytes:
        m = PLAIN.fullmatch(piece)
        if m is None or piece in self.signs:
            return self._text(piece)
        word, signs = m.groups()
        return self.words[word.lower()] + self.words[signs] if signs else self.words[word.lower()]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit integers."""
        if not self.by_piece:
            return self._text(text)
        return b"".join(map(self.pieces.__getitem__, text.replace("\n", " ").split(" ")))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def write_token_files(
    ws: Workspace, docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK
) -> DataFrame:
    """Write docs in ascending id order; returns (shard, path, base, n_ids), a row for each file.

    base is the number of ids in the files before. A file's name is its own attempt's, and only files that a
    finished task named are in the result, so a task may run again. Null texts count as empty (end id alone);
    rows with equal ids stay next to each other; null ids come before all others and are read back as null; an empty
    table gives no files; other columns are ignored.
    """
    folder = ws.child("token-files")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def write(batches):
        fs = out = writer = None
        enc = encoder(tokenizer_path)
        end = np.array([end_id], dtype="<u4").tobytes()
        shard = TaskContext.get().partitionId()
        path = f"{folder}/{shard:06d}-{uuid.uuid4().hex[:8]}.ids"
        for batch in batches:
            for part in slices(batch, "text"):
                if writer is None:
                    fs, at = open_shared(path)
                    fs.create_dir(at.rpartition("/")[0], recursive=True)
                    out = fs.open_output_stream(at, compression=None)
                    writer = Writer(out, bits_for(max(enc.size, end_id + 1)), block)
                for i, text in zip(part.column("id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    writer.add(i, np.frombuffer(enc.encode(text or "") + end, dtype="<u4"))
        if writer is not None:
            writer.close()
            yield {"shard": [shard], "path": [path], "n_ids": [writer.n]}

    ordered = rows.repartitionByRange("id").sortWithinPartitions("id")
    files = ws.store(map_arrow(ordered, "shard int, path string, n_ids long", write), "files")
    # a row for each file: its running total needs one small task
    return files.selectExpr("shard", "path", "sum(n_ids) over (order by shard) - n_ids as base", "n_ids")


def read_token_files(files: DataFrame, chunk: int = 1 << 20) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) for each document of the files, read in pieces of about `chunk` ids."""

    def read(batches):
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                fs, at = open_shared(path)
                with fs.open_input_file(at) as source:
                    r = Reader(source)
                    i, n = 0, r.docs.size
                    while i < n:
                        j = max(i + 1, int(np.searchsorted(r.starts, r.starts[i] + chunk, side="right")) - 1)
                        j = min(j, n)
                        ids = r.ids(int(r.starts[i]), int(r.starts[j]))
                        edges = (r.starts[i : j + 1] - r.starts[i]).tolist()
                        yield {
                            "id": pa.array(r.docs[i:j], mask=np.arange(i, j) < r.nulls),
                            "start": pa.array(r.starts[i:j] + base),
                            "n_tokens": pa.array(np.diff(r.starts[i : j + 1])),
                            "ids_crc32": [zlib.crc32(ids[a:b]) for a, b in zip(edges, edges[1:], strict=False)],
                        }
                        i = j

    return map_arrow(one_row_tasks(files, "shard").select("path", "base"), "id long, start long, n_tokens long, ids_crc32 long", read)


def pack_round_trip(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write docs as token files and read every document back from them."""
    ws = Workspace(docs.sparkSession, "token-files")
    files = write_token_files(ws, docs, tokenizer_path, end_id, id_col, text_col)
    listed = ws.store(files, "manifest")
    ws.keep_only(listed)
    return read_token_files(listed).withColumnRenamed("id", id_col)
