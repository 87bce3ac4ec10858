"""BAM files as a Spark data source: spark.dataSource.register(BamSource); spark.read.format("bam").load(path).

A BAM file is a series of BGZF blocks, each a gzip member of at most 64 KiB that names its own size. One reader
partition is made for each file; records stream through it block by block, so memory does not grow with the file.
"""

from __future__ import annotations

import glob
import struct
import zlib
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..schema import ALIGNMENTS

_OPS, _BASES = "MIDNSHP=X", "=ACMGRSVTWYHKDBN"
#: Type codes of auxiliary fields and their struct formats.
_SCALAR = {"A": "c", "c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}


def blocks(file) -> Iterator[bytes]:
    """The contents of the BGZF blocks of an open file."""
    while head := file.read(18):
        if len(head) < 18 or head[:4] != b"\x1f\x8b\x08\x04":
            raise ValueError("not a BGZF file")
        extra = struct.unpack("<H", head[10:12])[0]
        fields = head[12:18] + file.read(extra - 6)
        at = size = 0
        while at < extra:
            kind, n = fields[at : at + 2], struct.unpack("<H", fields[at + 2 : at + 4])[0]
            if kind == b"BC":
                size = struct.unpack("<H", fields[at + 4 : at + 6])[0] + 1
            at += 4 + n
        body = file.read(size - 12 - extra)
        yield zlib.decompress(body[:-8], -15)


class _Stream:
    def __init__(self, file):
        self.parts, self.data = blocks(file), b""

    def take(self, n: int) -> bytes | None:
        while len(self.data) < n:
            more = next(self.parts, None)
            if more is None:
                if self.data:
                    raise ValueError("truncated BAM file")
                return None
            self.data += more
        out, self.data = self.data[:n], self.data[n:]
        return out

    def number(self) -> int | None:
        raw = self.take(4)
        return None if raw is None else struct.unpack("<i", raw)[0]


def _tags(raw: bytes) -> dict[str, str]:
    out, at = {}, 0
    while at < len(raw):
        name, kind, at = raw[at : at + 2].decode(), chr(raw[at + 2]), at + 3
        if kind in _SCALAR:
            size = struct.calcsize(_SCALAR[kind])
            value = struct.unpack("<" + _SCALAR[kind], raw[at : at + size])[0]
            out[name], at = value.decode() if kind == "A" else str(value), at + size
        elif kind in "ZH":
            end = raw.index(b"\0", at)
            out[name], at = raw[at:end].decode(), end + 1
        elif kind == "B":
            code, n = chr(raw[at]), struct.unpack("<i", raw[at + 1 : at + 5])[0]
            size = n * struct.calcsize(_SCALAR[code])
            out[name], at = ",".join([code, *map(str, struct.unpack(f"<{n}{_SCALAR[code]}", raw[at + 5 : at + 5 + size]))]), at + 5 + size
        else:
            raise ValueError(f"unknown type {kind!r} of tag {name}")
    return out


def read_header(stream: _Stream) -> tuple[str, list[tuple[str, int]]]:
    if stream.take(4) != b"BAM\1":
        raise ValueError("not a BAM file")
    text = stream.take(stream.number()).rstrip(b"\0").decode()
    contigs = []
    for _ in range(stream.number()):
        name = stream.take(stream.number()).rstrip(b"\0").decode()
        contigs.append((name, stream.number()))
    return text, contigs


def records(stream: _Stream, sample: int) -> Iterator[tuple]:
    while (size := stream.number()) is not None:
        raw = stream.take(size)
        tid, pos, n_name, mapq, _, n_ops, flag, n_seq, mate_tid, mate_pos, tlen = struct.unpack("<iiBBHHHiiii", raw[:32])
        at = 32 + n_name
        name = raw[32 : at - 1].decode()
        cigar = "".join(f"{x >> 4}{_OPS[x & 15]}" for x in struct.unpack(f"<{n_ops}I", raw[at : at + 4 * n_ops])) or "*"
        at += 4 * n_ops
        packed = raw[at : at + (n_seq + 1) // 2]
        seq = "".join(_BASES[b >> 4] + _BASES[b & 15] for b in packed)[:n_seq] or "*"
        at += (n_seq + 1) // 2
        qual = [] if n_seq and raw[at] == 0xFF else list(raw[at : at + n_seq])
        tags = _tags(raw[at + n_seq :])
        null = lambda t: None if t < 0 else t
        yield (name, flag, sample, null(tid), pos, mapq, cigar, null(mate_tid), mate_pos, tlen, seq, qual, tags.get("SA"), tags.get("MC"), tags)


class _File(InputPartition):
    def __init__(self, path: str, sample: int):
        self.path, self.sample = path, sample


class BamReader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self):
        return [_File(p, k) for k, p in enumerate(self.paths)]

    def read(self, partition):
        with open(partition.path, "rb") as file:
            stream = _Stream(file)
            read_header(stream)
            yield from records(stream, partition.sample)


class BamSource(DataSource):
    """Option path: a file or a pattern; files are samples 0, 1, ... in order of name."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return ALIGNMENTS

    def reader(self, schema) -> BamReader:
        found = sorted(glob.glob(self.options["path"]))
        if not found:
            raise ValueError(f"no file matches {self.options['path']}")
        return BamReader(found)


def contigs(path: str) -> list[tuple[str, int]]:
    with open(path, "rb") as file:
        return read_header(_Stream(file))[1]


def header_text(path: str) -> str:
    with open(path, "rb") as file:
        return read_header(_Stream(file))[0]
