"""BAM files in splits. A BAM file is a chain of compressed blocks (BGZF); a split begins at the first block and the first record that begin in it.

Blocks and records carry no marks. A block is one if its header is followed by another one where it ends (or by the end of the file), a record
if it and those after it have sizes, names, references and operations that fit each other.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from siteloom.session import ship

#: Bytes of a split, records in a row that must fit for a place to be a record's start, and lines of a batch.
SPLIT_BYTES, FITTING, LINES = 32 << 20, 12, 4096
#: The largest record that a split looks for, and the largest block.
MOST_RECORD, MOST_BLOCK = 1 << 26, 1 << 16
MAGIC = b"\x1f\x8b\x08\x04"

# Fixed letters of number types in BAM, as struct names them.
_NUMBERS = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}


def block_bytes(head: bytes) -> int | None:
    """The size of the block that begins with these bytes; None if they begin none."""
    if len(head) < 18 or head[:4] != MAGIC:
        return None
    at, end = 12, 12 + struct.unpack_from("<H", head, 10)[0]
    while at + 4 <= min(end, len(head)):
        size = struct.unpack_from("<H", head, at + 2)[0]
        if head[at : at + 2] == b"BC" and size == 2 and at + 6 <= len(head):
            return struct.unpack_from("<H", head, at + 4)[0] + 1
        at += 4 + size
    return None


def first_block(file, start: int, length: int) -> int:
    """The first place from start on where a block begins (the file's length if none does)."""
    file.seek(start)
    window = file.read(min(length - start, 3 * MOST_BLOCK))
    at = window.find(MAGIC)
    while at >= 0:
        size = block_bytes(window[at : at + 64])
        if size and (start + at + size == length or block_bytes(window[at + size : at + size + 64])):
            return start + at
        at = window.find(MAGIC, at + 1)
    return length


class Stream:
    """What the blocks from a place on hold, unpacked: data from `base` on; marks: (where a block's data begins, where the block does)."""

    def __init__(self, file, at: int, length: int):
        self.file, self.at, self.length = file, at, length
        self.data, self.base, self.marks = bytearray(), 0, []
        file.seek(at)
        self.blocked = block_bytes(file.read(64)) is not None
        self.whole = None

    def more(self) -> bool:
        """Adds a block (of a file that isn't blocked, a part of its one stream); False at the end."""
        if self.at >= self.length:
            return False
        self.marks.append((self.base + len(self.data), self.at))
        self.file.seek(self.at)
        if self.blocked:
            size = block_bytes(self.file.read(64))
            if size is None:
                raise ValueError("BAM: a broken block")
            self.file.seek(self.at)
            self.data += zlib.decompress(self.file.read(size), 31)
            self.at += size
            return True
        part = self.file.read(min(1 << 20, self.length - self.at))
        self.at += len(part)
        while part:
            self.whole = self.whole or zlib.decompressobj(31)
            self.data += self.whole.decompress(part)
            part = self.whole.unused_data
            if self.whole.eof:
                self.whole = None
        return True

    def holds(self, end: int) -> bool:
        while self.base + len(self.data) < end:
            if not self.more():
                return False
        return True

    def bytes(self, start: int, n: int) -> bytes:
        if not self.holds(start + n):
            raise ValueError("BAM: the file ends within a record")
        return bytes(self.data[start - self.base : start - self.base + n])

    def block_of(self, place: int) -> int:
        """Where the block begins that holds a place; what lies before the place is forgotten."""
        while len(self.marks) > 1 and self.marks[1][0] <= place:
            self.marks.pop(0)
        if place - self.base > 1 << 20:
            del self.data[: place - self.base]
            self.base = place
        return self.marks[0][1]


def header(stream: Stream) -> tuple[list[str], int]:
    """(names of the references, where the first record begins)"""
    if stream.bytes(0, 4) != b"BAM\1":
        raise ValueError("not a BAM file")
    number = lambda at: struct.unpack("<i", stream.bytes(at, 4))[0]
    at = 8 + number(4)
    many, at, names = number(at), at + 4, []
    for _ in range(many):
        n = number(at)
        names.append(stream.bytes(at + 4, n - 1).decode())
        at += 8 + n
    return names, at


def fits(stream: Stream, at: int, references: int) -> int | None:
    """Where the record at this place ends, if it can be one."""
    if not stream.holds(at + 36):
        return None
    size, ref, pos, n_name, _, _, n_ops, _, n_seq, mate, mate_pos, _ = struct.unpack_from("<iiiBBHHHiiii", stream.data, at - stream.base)
    if not (32 <= size <= MOST_RECORD and -1 <= ref < references and -1 <= mate < references and pos >= -1 and mate_pos >= -1 and n_name >= 1 and n_seq >= 0):
        return None
    if 32 + n_name + 4 * n_ops + (n_seq + 1) // 2 + n_seq > size or not stream.holds(at + 4 + size):
        return None
    here = at - stream.base + 36
    name = stream.data[here : here + n_name]
    if name[-1] or any(c < 33 or c > 126 for c in name[:-1]):
        return None
    return at + 4 + size if all(stream.data[here + n_name + 4 * k] & 15 <= 8 for k in range(n_ops)) else None


def first_record(stream: Stream, references: int) -> int | None:
    """Where the first record begins in a stream that may begin within one; None if none does."""
    at = 0
    while stream.holds(at + 4):
        end, seen = at, 0
        while seen < FITTING and (next_ := fits(stream, end, references)) is not None:
            end, seen = next_, seen + 1
        if seen == FITTING or (seen and not stream.holds(end + 1)):
            return at
        at += 1
    return None


def record_line(raw: bytes, names: list[str]) -> str:
    """A record, without its size, as a line of SAM text."""
    name = lambda k: "*" if k < 0 else names[k]
    ref, pos, n_name, mapq, _, n_ops, flag, n_seq, mate, mate_pos, tlen = struct.unpack_from("<iiBBHHHiiii", raw)
    here = 32
    read = raw[here : here + n_name - 1].decode()
    here += n_name
    cigar = "".join(f"{v >> 4}{'MIDNSHP=X'[v & 15]}" for v in struct.unpack_from(f"<{n_ops}I", raw, here)) or "*"
    here += 4 * n_ops
    seq = "".join("=ACMGRSVTWYHKDBN"[b >> 4] + "=ACMGRSVTWYHKDBN"[b & 15] for b in raw[here : here + (n_seq + 1) // 2])[:n_seq] or "*"
    here += (n_seq + 1) // 2
    qual = "*" if n_seq == 0 or raw[here] == 255 else "".join(chr(q + 33) for q in raw[here : here + n_seq])
    here += n_seq
    tags = []
    while here < len(raw):
        tag, kind = raw[here : here + 2].decode(), chr(raw[here + 2])
        here += 3
        if kind in "ZH":
            stop = raw.index(0, here)
            tags.append(f"{tag}:{kind}:{raw[here:stop].decode()}")
            here = stop + 1
        elif kind == "A":
            tags.append(f"{tag}:A:{chr(raw[here])}")
            here += 1
        elif kind == "B":
            sub, n = chr(raw[here]), struct.unpack_from("<i", raw, here + 1)[0]
            values = struct.unpack_from(f"<{n}{_NUMBERS[sub]}", raw, here + 5)
            tags.append(f"{tag}:B:{','.join(map(str, (sub, *values)))}")
            here += 5 + struct.calcsize(f"<{n}{_NUMBERS[sub]}")
        else:
            tags.append(f"{tag}:{'f' if kind == 'f' else 'i'}:{struct.unpack_from('<' + _NUMBERS[kind], raw, here)[0]}")
            here += struct.calcsize(_NUMBERS[kind])
    return "\t".join([read, str(flag), name(ref), str(pos + 1), str(mapq), cigar, "=" if mate == ref and mate >= 0 else name(mate), str(mate_pos + 1), str(tlen), seq, qual, *tags])


def split_lines(file, length: int, start: int, end: int) -> Iterator[tuple[int, str]]:
    """(place, line) of the records that begin in blocks from start up to end; places grow with the file's order."""
    stream = Stream(file, 0, length)
    names, at = header(stream)
    if start:
        stream = Stream(file, first_block(file, start, length), length)
        at = first_record(stream, len(names))
    order = 0
    while at is not None and stream.holds(at + 1):
        if stream.block_of(at) >= end:
            return
        size = struct.unpack("<i", stream.bytes(at, 4))[0]
        yield (start << 20) + order, record_line(stream.bytes(at + 4, size), names)  # fewer than 2 ** 20 records for each byte of a split
        at, order = at + 4 + size, order + 1


class BamPartition(InputPartition):
    def __init__(self, path: str, length: int, start: int, end: int):
        self.path, self.length, self.start, self.end = path, length, start, end


def opened(path: str):
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


class BamReader(DataSourceReader):
    def __init__(self, files: list[tuple[str, int]], split: int):
        self.files, self.split = files, split

    def partitions(self):
        return [BamPartition(p, n, a, min(n, a + self.split)) for p, n in self.files for a in range(0, n, self.split)]

    def read(self, partition: BamPartition):
        schema = pa.schema([("file", pa.string()), ("at", pa.int64()), ("value", pa.string())])
        with opened(partition.path) as file:
            whole = Stream(file, 0, partition.length).blocked
            if not whole and partition.start:
                return  # one stream without blocks: the first split reads it
            places, values = [], []
            for place, line in split_lines(file, partition.length, partition.start, partition.end if whole else partition.length):
                places.append(place)
                values.append(line)
                if len(values) == LINES:
                    yield pa.RecordBatch.from_arrays([pa.array([partition.path] * LINES), pa.array(places, pa.int64()), pa.array(values)], schema=schema)
                    places, values = [], []
            yield pa.RecordBatch.from_arrays([pa.array([partition.path] * len(values), pa.string()), pa.array(places, pa.int64()), pa.array(values, pa.string())], schema=schema)


class BamSource(DataSource):
    """Options: files, a JSON list of (path, bytes), and split, the bytes of a split."""

    @classmethod
    def name(cls):
        return "siteloom_bam"

    def schema(self):
        return "file string, at long, value string"

    def reader(self, schema):
        return BamReader([tuple(f) for f in json.loads(self.options["files"])], int(self.options["split"]))


def lines(spark: SparkSession, path: str, split: int = SPLIT_BYTES) -> DataFrame:
    """(file, at, value): the records of BAM files as lines of SAM text. Spark lists the files, each split is a task; executors open
    them by pyarrow's file systems. Files on a system that only Spark opens are read whole, one task each (up to 2 GB, Spark's limit for a binary file)."""
    ship(spark)
    found = [(r.path, r.length) for r in spark.read.format("binaryFile").load(path).select("path", "length").collect()]  # a row for each file
    try:
        for one, _ in found[:1]:
            opened(one).close()
    except (OSError, ValueError):  # pa.ArrowInvalid is a ValueError
        return _whole(spark, path)
    spark.dataSource.register(BamSource)
    return spark.read.format("siteloom_bam").option("files", json.dumps(found)).option("split", str(split)).load()


def _whole(spark: SparkSession, path: str) -> DataFrame:
    def run(batches):
        for pdf in batches:
            for file, data in zip(pdf["path"], pdf["content"]):
                rows = list(split_lines(pa.BufferReader(data), len(data), 0, len(data)))
                yield pd.DataFrame({"file": file, "at": [a for a, _ in rows], "value": [v for _, v in rows]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, at long, value string")
