"""WARC records from a byte stream, gzipped (by record or as a whole) or plain."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import BinaryIO

CHUNK = 1 << 16


class _Bytes:
    """Buffered bytes of a stream, unzipped if it starts as gzip does; members follow each other."""

    def __init__(self, stream: BinaryIO):
        self.stream = stream
        self.held = bytearray(stream.read(CHUNK))
        self.zip = zlib.decompressobj(31) if self.held[:2] == b"\x1f\x8b" else None
        self.raw = bytes(self.held) if self.zip else b""
        if self.zip:
            self.held = bytearray()
        self.over = False

    def _more(self) -> bool:
        if self.over:
            return False
        if self.zip is None:
            got = self.stream.read(CHUNK)
            self.over = not got
            self.held += got
            return not self.over
        while True:
            if not self.raw:
                self.raw = self.stream.read(CHUNK)
                if not self.raw:
                    self.over = True
                    if not self.zip.eof and self.started:
                        raise EOFError("the gzip stream ends inside a member")
                    return False
            if self.zip.eof:
                self.zip = zlib.decompressobj(31)
            self.started = True
            out = self.zip.decompress(self.raw)
            self.raw = self.zip.unused_data.lstrip(b"\0") if self.zip.eof else b""
            if self.zip.eof:
                self.started = False
            if out:
                self.held += out
                return True

    started = False

    def skip_blank(self) -> bool:
        """Drop line ends; False at the end of the stream."""
        while True:
            n = len(self.held) - len(self.held.lstrip(b"\r\n"))
            del self.held[:n]
            if self.held:
                return True
            if not self._more():
                return False

    def head(self) -> bytes:
        """Bytes up to an empty line, which is dropped."""
        at = 0
        while True:
            for mark in (b"\r\n\r\n", b"\n\n"):
                p = self.held.find(mark, at)
                if p >= 0:
                    out = bytes(self.held[:p])
                    del self.held[: p + len(mark)]
                    return out
            at = max(0, len(self.held) - 3)
            if not self._more():
                raise EOFError("the stream ends inside a record's header")

    def take(self, n: int) -> bytes:
        while len(self.held) < n:
            if not self._more():
                raise EOFError("the stream ends inside a record's block")
        out = bytes(self.held[:n])
        del self.held[:n]
        return out


def read_records(stream: BinaryIO) -> Iterator[tuple[dict[str, list[str]], bytes]]:
    """(header fields by lower-case name, block) of each record, in order."""
    src = _Bytes(stream)
    while src.skip_blank():
        lines = src.head().decode("utf-8", "replace").splitlines()
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:60]!r}")
        fields: dict[str, list[str]] = {}
        name = ""
        for line in lines[1:]:
            if line[:1] in (" ", "\t") and name:  # a folded line
                fields[name][-1] += " " + line.strip()
                continue
            name, _, value = line.partition(":")
            name = name.strip().lower()
            fields.setdefault(name, []).append(value.strip())
        yield fields, src.take(int(fields.get("content-length", ["0"])[0]))
