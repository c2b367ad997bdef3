"""Parsing of legacy ARC files (versions 1 and 2) and of WARC files, by declared lengths."""

from __future__ import annotations

import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

# The field lines of the two ARC versions.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
_CHUNK = 1 << 18


class Inflated(io.RawIOBase):
    """Bytes of one or several gzip members, inflated as they are read; bytes that are not gzip pass as they are."""

    def __init__(self, data: bytes):
        self._data, self._at = memoryview(data), 0
        self._gzip = data[:2] == b"\x1f\x8b"
        self._stream = zlib.decompressobj(31) if self._gzip else None
        self._ready = b""

    def readable(self) -> bool:
        return True

    def readinto(self, target) -> int:
        while not self._ready and (self._at < len(self._data) or (self._stream and self._stream.unconsumed_tail)):
            if not self._stream:
                self._ready = bytes(self._data[self._at : self._at + _CHUNK])
                self._at += len(self._ready)
                continue
            part = self._stream.unconsumed_tail or bytes(self._data[self._at : self._at + _CHUNK])
            if not self._stream.unconsumed_tail:
                self._at += len(part)
            self._ready = self._stream.decompress(part, _CHUNK)
            if self._stream.eof:
                self._at -= len(self._stream.unused_data)
                if bytes(self._data[self._at : self._at + 2]) != b"\x1f\x8b":
                    self._at = len(self._data)
                self._stream = zlib.decompressobj(31)
        n = min(len(target), len(self._ready))
        target[:n] = self._ready[:n]
        self._ready = self._ready[n:]
        return n


def opened(data: bytes) -> io.BufferedReader:
    return io.BufferedReader(Inflated(data), _CHUNK)


@dataclass
class ArcRecord:
    url: str
    ip: str
    date: str
    mime: str
    block: bytes


def _exactly(stream: io.BufferedReader, n: int) -> bytes:
    body = stream.read(n)
    if len(body) < n:
        raise ValueError(f"archive is cut short: {n} bytes declared, {len(body)} left")
    return body


def read_arc(stream: io.BufferedReader) -> Iterator[ArcRecord]:
    """The records of an ARC file. Its version block names the version, and with it the fields of each header line."""
    line = stream.readline()
    if not line:
        return
    if not line.startswith(b"filedesc:"):
        raise ValueError("no ARC version block")
    block = _exactly(stream, int(line.split()[-1]))
    version = int(block.split(None, 1)[0])
    if version not in FIELDS:
        raise ValueError(f"unknown ARC version {version}")
    names = FIELDS[version].split()
    while line := stream.readline():
        if not line.strip():
            continue
        values = dict(zip(names, line.decode("utf-8", "replace").rstrip("\r\n").rsplit(" ", len(names) - 1), strict=True))
        body = _exactly(stream, int(values["Archive-length"]))
        yield ArcRecord(values["URL"], values["IP-address"], values["Archive-date"], values["Content-type"], body)


def warc_date(date: str) -> str:
    """14 (or fewer, from the year on) digits as an ISO time; what is missing counts as the earliest."""
    full = date[:14] + "00000101000000"[len(date[:14]) :]
    return f"{full[:4]}-{full[4:6]}-{full[6:8]}T{full[8:10]}:{full[10:12]}:{full[12:14]}Z"


def record_id(*parts: str) -> str:
    """An identifier that follows from what it names."""
    return f"urn:uuid:{uuid.UUID(bytes=hashlib.sha256(chr(10).join(parts).encode()).digest()[:16], version=5)}"


def http_parts(block: bytes) -> tuple[bytes, dict[str, str], bytes]:
    """Head (with its empty line), fields and payload of an HTTP response."""
    head, sep, payload = block.partition(b"\r\n\r\n")
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    return head + sep, fields, payload


def read_warc(stream: io.BufferedReader) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("no WARC record where one should begin")
        fields = {}
        while (line := stream.readline()).strip():
            name, _, value = line.partition(b":")
            fields[name.strip().lower().decode()] = value.strip().decode("utf-8", "replace")
        yield fields, _exactly(stream, int(fields["content-length"]))
