"""BAM files as a Python data source: blocks are inflated with zlib, records decoded by struct.

    spark.dataSource.register(BamSource)
    spark.read.format("bam").option("path", ...).load()

With spark.sql.python.filterPushdown.enabled and the option pushFilters, filters on mapq are taken over by the reader; those
that it can't evaluate stay with Spark. A file is a partition.
"""

from __future__ import annotations

import glob
import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition

SCHEMA = "qname string, flag int, ref string, pos long, mapq int, cigar string, mref string, mpos long, length int, nm int, score int"
OPS = "MIDNSHP=X"


def inflated(path: str) -> Iterator[bytes]:
    """The contents of the blocks of a BGZF file."""
    with open(path, "rb") as f:
        while head := f.read(18):
            if head[:4] != b"\x1f\x8b\x08\x04":
                raise ValueError(f"{path}: not a BGZF file")
            size = struct.unpack("<H", head[16:18])[0] + 1
            yield zlib.decompress(f.read(size - 18)[:-8], -15)


class _Stream:
    def __init__(self, path: str):
        self.blocks, self.held, self.at = inflated(path), b"", 0

    def take(self, n: int) -> bytes:
        while len(self.held) - self.at < n:
            block = next(self.blocks, None)
            if block is None:
                rest, self.held, self.at = self.held[self.at :], b"", 0
                return rest
            self.held, self.at = self.held[self.at :] + block, 0
        out = self.held[self.at : self.at + n]
        self.at += n
        return out

    def number(self) -> int:
        return struct.unpack("<i", self.take(4))[0]


def header(stream: _Stream) -> tuple[str, list[tuple[str, int]]]:
    """(text, (name, length) of the references)."""
    if stream.take(4) != b"BAM\1":
        raise ValueError("not a BAM file")
    text = stream.take(stream.number()).split(b"\0")[0].decode()
    refs = []
    for _ in range(stream.number()):
        name = stream.take(stream.number())[:-1].decode()
        refs.append((name, stream.number()))
    return text, refs


def sort_order(text: str) -> str:
    """What the header says of the order of records."""
    for line in text.splitlines():
        if line.startswith("@HD"):
            for x in line.split("\t"):
                if x.startswith("SO:"):
                    return x[3:]
    return "unknown"


_SIZES = {b"A": 1, b"c": 1, b"C": 1, b"s": 2, b"S": 2, b"i": 4, b"I": 4, b"f": 4}
_CODES = {b"c": "<b", b"C": "<B", b"s": "<h", b"S": "<H", b"i": "<i", b"I": "<I"}


def tags(raw: bytes) -> dict[str, int]:
    """The integer tags of a record."""
    out, k = {}, 0
    while k + 3 <= len(raw):
        name, kind = raw[k : k + 2].decode(), raw[k + 2 : k + 3]
        k += 3
        if kind in _SIZES:
            if kind in _CODES:
                out[name] = struct.unpack_from(_CODES[kind], raw, k)[0]
            k += _SIZES[kind]
        elif kind == b"B":
            k += 5 + _SIZES[raw[k : k + 1]] * struct.unpack_from("<i", raw, k + 1)[0]
        else:
            k = raw.index(b"\0", k) + 1
    return out


def records(path: str, all_bits: int = 0, no_bits: int = 0, least_mapq: int = 0, refuse_sorted: bool = False) -> Iterator[tuple]:
    stream = _Stream(path)
    text, refs = header(stream)
    if refuse_sorted and sort_order(text) == "coordinate":
        raise ValueError(f"{path} is sorted by coordinate, so mates are not adjacent")
    name = lambda k: refs[k][0] if k >= 0 else None
    while size := stream.take(4):
        raw = stream.take(struct.unpack("<i", size)[0])
        ref, pos, n_name, mapq, _, n_ops, flag, length, mref, mpos, _ = struct.unpack_from("<iiBBHHHiiii", raw)
        if flag & all_bits != all_bits or flag & no_bits or mapq < least_mapq:
            continue
        k = 32 + n_name
        ops = struct.unpack_from(f"<{n_ops}I", raw, k)
        t = tags(raw[k + 4 * n_ops + (length + 1) // 2 + length :])
        cigar = "".join(f"{o >> 4}{OPS[o & 15]}" for o in ops) or None
        yield raw[32 : k - 1].decode(), flag, name(ref), pos, mapq, cigar, name(mref), mpos, length, t.get("NM"), t.get("AS")


@dataclass
class _File(InputPartition):
    path: str


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options
        self.least_mapq = int(options.get("leastMapq", 0))

    def partitions(self) -> list[_File]:
        path = self.options["path"].removeprefix("file://")
        found = [os.path.join(path, x) for x in sorted(os.listdir(path)) if x.endswith(".bam")] if os.path.isdir(path) else sorted(glob.glob(path))
        if not found:
            raise FileNotFoundError(path)
        return [_File(x) for x in found]

    def read(self, partition: _File) -> Iterator[tuple]:
        o = self.options
        yield from records(partition.path, int(o.get("allBits", 0)), int(o.get("noBits", 0)), self.least_mapq, str(o.get("refuseSorted", "false")).lower() == "true")


class _PushingReader(_Reader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, GreaterThanOrEqual) and f.attribute == ("mapq",):
                self.least_mapq = max(self.least_mapq, f.value)
            elif isinstance(f, GreaterThan) and f.attribute == ("mapq",):
                self.least_mapq = max(self.least_mapq, f.value + 1)
            elif isinstance(f, EqualTo) and f.attribute == ("mapq",):
                self.least_mapq = max(self.least_mapq, f.value)
                yield f
            else:
                yield f


class BamSource(DataSource):
    """Options: path (file, folder or pattern), allBits and noBits of the flag, leastMapq, refuseSorted."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        pushes = str(self.options.get("pushFilters", "false")).lower() == "true"
        return _PushingReader(self.options) if pushes else _Reader(self.options)
