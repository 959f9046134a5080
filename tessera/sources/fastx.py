"""A data source for FASTA and FASTQ files: `spark.read.format("fastx").load(path)`.

A plain file, and one of block-gzip, is read by several tasks, each a range of its bytes: a task starts at the first record whose line begins behind a
line end in its range, and reads its last record to the end. Other gzip files and zstd files are streams, one task each. Nothing is held whole: bytes come in blocks,
compressed members and frames are decoded block by block, and one record at a time is put together.
"""

from __future__ import annotations

import fnmatch
import io
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

#: Bytes that are read or decoded at a time, bytes of a task's range, and records that leave a task together: so many, or so many letters.
BLOCK, RANGE, RECORDS, LETTERS = 1 << 20, 64 << 20, 1024, 4 << 20
# First bytes of the compressed formats; a block-gzip member has an extra field that begins with BC, 2, 0.
GZIP, ZSTD, BLOCKED = b"\x1f\x8b", b"\x28\xb5\x2f\xfd", b"\x1f\x8b\x08\x04"
SCHEMA = "path string, start long, rec long, name string, seq string"

#: (bytes, place of the first, all bytes have that place): what lines are made of.
Blocks = Iterator[tuple[bytes, int, bool]]


def kind_of(first: bytes) -> str:
    """plain, gzip, blocked (block-gzip) or zstd, from a file's first 18 bytes."""
    if first[:4] == ZSTD:
        return "zstd"
    if first[:2] != GZIP:
        return "plain"
    return "blocked" if first[:4] == BLOCKED and first[12:16] == b"BC\x02\x00" else "gzip"


def _plain(f, at: int) -> Blocks:
    f.seek(at)
    while data := f.read(BLOCK):
        yield data, at, False
        at += len(data)


def _gzip(f) -> Blocks:
    """All members of a gzip file. One that ends too early is an error."""
    member, more = None, b""
    while more or (more := f.read(BLOCK)):
        if member is None:
            member = zlib.decompressobj(31)
        try:
            data = member.decompress(more, BLOCK)
        except zlib.error as e:
            raise ValueError(f"no gzip member: {e}") from e
        more = member.unconsumed_tail
        if data:
            yield data, 0, True
        if member.eof:
            more = member.unused_data.lstrip(b"\0") or f.read(BLOCK).lstrip(b"\0")
            member = None
    if member is not None:
        raise EOFError("a gzip member ends too early")


def _zstd(f) -> Blocks:
    import zstandard

    with zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True, closefd=False) as stream:
        while True:
            try:
                data = stream.read(BLOCK)
            except zstandard.ZstdError as e:
                raise ValueError(f"no zstd frame: {e}") from e
            if not data:
                return
            yield data, 0, True


def _blocked(f, at: int) -> Blocks:
    """The members of a block-gzip file from the first that begins at or behind a place; each has its own place. They are at most 64 KiB long."""
    f.seek(at)
    held = b""
    while True:
        begin = held.find(BLOCKED)
        while begin >= 0 and len(held) >= begin + 18 and held[begin + 12 : begin + 16] != b"BC\x02\x00":
            begin = held.find(BLOCKED, begin + 1)
        size = int.from_bytes(held[begin + 16 : begin + 18], "little") + 1 if begin >= 0 and len(held) >= begin + 18 else None
        if size is None or len(held) < begin + size:
            more = f.read(BLOCK)
            if not more:
                return
            held += more
            continue
        try:
            data = zlib.decompress(held[begin : begin + size], 31)
        except zlib.error:  # by chance, bytes inside a member look like one's beginning
            at, held = at + begin + 1, held[begin + 1 :]
            continue
        if data:
            yield data, at + begin, True
        at, held = at + begin + size, held[begin + size :]


def blocks(f, kind: str, start: int = 0) -> Blocks:
    return {"plain": _plain, "blocked": _blocked}[kind](f, start) if kind in ("plain", "blocked") else {"gzip": _gzip, "zstd": _zstd}[kind](f)


def lines(found: Blocks, first: bool) -> Iterator[tuple[int, str]]:
    """(place, line): a line's place is that of the line end before it, -1 for a file's first. first: the blocks begin a file; else what stands before the first line end is left out."""
    place, parts, inside = -1, [], first
    for data, at, fixed in found:
        lo = 0
        while (hi := data.find(b"\n", lo)) >= 0:
            if inside:
                parts.append(data[lo:hi])
                yield place, b"".join(parts).rstrip(b"\r").decode("latin-1")
            place, parts, inside, lo = at if fixed else at + hi, [], True, hi + 1
        if inside:
            parts.append(data[lo:])
    if inside and any(parts):
        yield place, b"".join(parts).rstrip(b"\r").decode("latin-1")


def records(found: Iterator[tuple[int, str]], end: float = float("inf"), resume: str | None = None) -> Iterator[tuple[str, str]]:
    """(name, sequence) of the records whose first line has a place below end. FASTA sequences may have many lines, FASTQ ones have one.

    A line that starts neither format where a record should is an error. resume: the first character of a file's records, if the lines begin somewhere
    inside it: lines up to the first record are then passed over. A FASTQ record begins with an @ two lines above a +: so does no line of qualities.
    """
    waiting: list[tuple[int, str]] = []
    more = lambda: waiting.pop(0) if waiting else next(found, None)
    row = more()
    if resume == ">":
        while row and row[1][:1] != ">":
            row = more()
    elif resume == "@":
        held = [x for x in (row, more(), more()) if x]
        while held and not (held[0][1][:1] == "@" and len(held) == 3 and held[2][1][:1] == "+"):
            held = [*held[1:], *[x for x in (more(),) if x]]
        row, waiting = (held[0], held[1:]) if held else (None, [])
    while row:
        place, line = row
        if not line.strip():
            row = more()
        elif place >= end:
            return
        elif line[0] == ">":
            parts = []
            while (row := more()) and row[1][:1] != ">":
                parts.append(row[1].strip())
            yield line[1:].split(" ")[0], "".join(parts)
        elif line[0] == "@":
            rest = [more(), more(), more()]
            if not all(rest) or rest[1][1][:1] != "+":
                raise ValueError(f"broken FASTQ record {line[:80]!r}")
            yield line[1:].split(" ")[0], rest[0][1].strip()
            row = more()
        else:
            raise ValueError(f"no sequence record: {line[:80]!r}")


def file_records(uri: str) -> Iterator[tuple[str, str]]:
    """The records of one file, read as a stream."""
    store, at = pafs.FileSystem.from_uri(uri)
    with store.open_input_file(at) as f:
        kind = kind_of(f.read(18))
        f.seek(0)
        yield from records(lines(blocks(f, kind), True))


def content_records(content: bytes) -> Iterator[tuple[str, str]]:
    """The records of a file that is at hand whole, decoded block by block."""
    return records(lines(blocks(io.BytesIO(content), kind_of(content[:18])), True))


def as_batch(path: str, start: int, first: int, found: list[tuple[str, str]]) -> pa.RecordBatch:
    """Rows of SCHEMA from (name, sequence) of consecutive records."""
    cols = [([path] * len(found), pa.string()), ([start] * len(found), pa.int64()), (range(first, first + len(found)), pa.int64()), ([x for x, _ in found], pa.string()), ([x for _, x in found], pa.string())]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in cols], ["path", "start", "rec", "name", "seq"])


@dataclass
class Range(InputPartition):
    path: str
    kind: str
    start: int
    end: float
    resume: str | None


def opens(path: str) -> bool:
    """True if the file system of a path can be opened here; stores that only Spark's own readers know can't."""
    try:
        pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file:///")
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return False
    return True


def listed(path: str) -> list[tuple[pafs.FileSystem, str, str, int]]:
    """(file system, place there, name, bytes) of a file, a folder's files or those that a pattern fits, in order of their names; hidden ones are left out."""
    head = path.split("*")[0].split("?")[0].split("[")[0]
    folder = path if head == path else head.rpartition("/")[0]
    store, at = pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else pafs.FileSystem.from_uri("file://" + folder)
    if head == path and store.get_file_info(at).type == pafs.FileType.File:
        return [(store, at, path, store.get_file_info(at).size)]
    pattern = "*" if head == path else path[len(folder) :].lstrip("/")
    infos = store.get_file_info(pafs.FileSelector(at, recursive="/" in pattern))
    names = [(x.path, x.path[len(at) :].lstrip("/"), x.size) for x in infos if x.type == pafs.FileType.File]
    kept = [(p, n, s) for p, n, s in sorted(names) if n.rpartition("/")[2][:1] not in "._" and n.count("/") == pattern.count("/") and fnmatch.fnmatchcase(n, pattern)]
    if not kept:
        raise FileNotFoundError(path)
    return [(store, p, f"{folder.rstrip('/')}/{n}", s) for p, n, s in kept]


class FastxReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.range = options["path"], int(options.get("rangebytes", RANGE))

    def partitions(self) -> list[InputPartition]:
        out = []
        for store, at, name, size in listed(self.path):
            with store.open_input_file(at) as f:
                kind = kind_of(f.read(18))
                f.seek(0)
                # A record's first character decides how ranges go on; a file that starts otherwise is read as one.
                first = next((x for _, x in lines(blocks(f, kind), True) if x.strip()), "")[:1] if kind in ("plain", "blocked") else ""
            step = self.range if first in (">", "@") else max(size, 1)
            out += [Range(name, kind, lo, lo + step if lo + step < size else float("inf"), first if lo else None) for lo in range(0, max(size, 1), step)]
        return out

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        ((store, at, _, _),) = listed(part.path)
        held, n, letters = [], 0, 0
        with store.open_input_file(at) as f:
            for record in records(lines(blocks(f, part.kind, part.start), part.start == 0), part.end, part.resume):
                held.append(record)
                letters += len(record[1])
                if len(held) == RECORDS or letters > LETTERS:
                    yield as_batch(part.path, part.start, n, held)
                    held, n, letters = [], n + len(held), 0
        yield as_batch(part.path, part.start, n, held)


class FastxSource(DataSource):
    """Options: path, and rangebytes, the bytes of a task's range. rec counts the records of a range."""

    @classmethod
    def name(cls) -> str:
        return "fastx"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> FastxReader:
        return FastxReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FastxSource)
