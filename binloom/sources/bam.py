"""BAM files: BGZF blocks of packed records, read by splits and written by samples.

``register(spark)`` and ``spark.read.format("bam").load(path)`` give the columns of SAM records, and
``format("bam_header")`` the reference sequences.  A BGZF file is read by as many tasks as it has stretches of
``split`` bytes: each finds the first block that starts in its stretch, then the first record that starts there, and
reads on until a record starts beyond it.  Rows leave a task in Arrow batches.  Files lie in any file system that
pyarrow opens by its address; a path without a scheme is a local or mounted one.  ``write`` makes such files.
"""

from __future__ import annotations

import fnmatch
import posixpath
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from binloom.storage import cut

SCHEMA = "sample STRING, read_id STRING, ord LONG, flag INT, contig STRING, cigar STRING, qual STRING, md STRING"
_TYPES = pa.schema([("sample", pa.string()), ("read_id", pa.string()), ("ord", pa.int64()), ("flag", pa.int32())] + [(c, pa.string()) for c in ("contig", "cigar", "qual", "md")])
#: Letters of CIGAR operations, sizes of tag values by type, and the block that ends a BGZF file.
OPERATIONS = "MIDNSHP=X"
SIZES = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
END_BLOCK = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
_FIXED = struct.Struct("<iiBBHHHiiii")
#: Qualities as characters and back, and what has no such form.
_SHOWN, _TOO_HIGH = bytes(q + 33 & 255 for q in range(256)), bytes(range(223, 256))
_HIDDEN, _TOO_LOW = bytes(c - 33 & 255 for c in range(256)), bytes(range(33))
#: Bytes of a file that a task reads, records of an Arrow batch, and records in a row that must look like ones before a place counts as the start of one.
SPLIT_BYTES, BATCH_RECORDS, CHAIN = 32 << 20, 4096, 8
#: Bytes of a block before it is packed, and of one record at most where a start is sought.
BLOCK_BYTES, MOST_RECORD_BYTES = 65_280, 16 << 20
#: A file's sample is the first group of this pattern on its name.
SAMPLE = r"(.*)\.bam"


# ---------------------------------------------------------------- bytes


def _block_size(head: bytes) -> int | None:
    """Bytes of the BGZF block that starts with ``head``, None where none does."""
    if len(head) < 18 or head[:4] != b"\x1f\x8b\x08\x04":
        return None
    (extra,) = struct.unpack_from("<H", head, 10)
    at = 12
    while at + 4 <= min(12 + extra, len(head)):
        name, (size,) = head[at : at + 2], struct.unpack_from("<H", head, at + 2)
        if name == b"BC" and size == 2 and at + 6 <= len(head):
            return struct.unpack_from("<H", head, at + 4)[0] + 1
        at += 4 + size
    return None


def _blocks(file, at: int) -> Iterator[tuple[int, bytes]]:
    """(place in the file, unpacked bytes) of blocks from the one at a place on."""
    file.seek(at)
    while len(head := file.read(18)) == 18:
        size = _block_size(head)
        if size is None:
            raise ValueError(f"no BGZF block at byte {at}")
        yield at, zlib.decompress(head + file.read(size - 18), 31)
        at += size


def _first_block(file, start: int, size: int) -> int:
    """The first place from ``start`` on where a block starts: its length leads to another, or to the file's end."""
    at = start
    while at < size:
        file.seek(at)
        window = file.read(1 << 17)
        i = window.find(b"\x1f\x8b\x08\x04")
        while i >= 0:
            length = _block_size(window[i : i + 64])
            if length and at + i + length <= size:
                file.seek(at + i + length)
                follower = file.read(18)
                if not follower or _block_size(follower):
                    return at + i
            i = window.find(b"\x1f\x8b\x08\x04", i + 1)
        # a mark may lie across two windows
        at += max(1, len(window) - 64)
    return size


class _Stream:
    """Unpacked bytes of consecutive blocks, with the block that each byte came from."""

    def __init__(self, blocks: Iterator[tuple[int, bytes]]):
        self.blocks, self.data, self.at = blocks, b"", 0
        self.marks: list[tuple[int, int]] = []  # place in data and in the file, of each block that has bytes there

    def have(self, n: int) -> bool:
        """Whether n bytes lie ahead, after reading blocks as needed."""
        if len(self.data) - self.at >= n:
            return True
        keep = 0
        while keep + 1 < len(self.marks) and self.marks[keep + 1][0] <= self.at:
            keep += 1
        base = self.marks[keep][0] if self.marks else 0
        parts, length = [self.data[base:]], len(self.data) - base
        self.marks = [(p - base, c) for p, c in self.marks[keep:]]
        self.at -= base
        while length - self.at < n and (block := next(self.blocks, None)):
            if block[1]:
                self.marks.append((length, block[0]))
                parts.append(block[1])
                length += len(block[1])
        self.data = b"".join(parts)
        return len(self.data) - self.at >= n

    def place(self) -> tuple[int, int]:
        """Block and byte within it of the next byte; there must be one."""
        while len(self.marks) > 1 and self.marks[1][0] <= self.at:
            self.marks.pop(0)
        return self.marks[0][1], self.at - self.marks[0][0]

    def take(self, n: int) -> bytes:
        if not self.have(n):
            raise ValueError("the file ends within a record")
        self.at += n
        return self.data[self.at - n : self.at]


def _header(take) -> list[tuple[str, int]]:
    """Names and lengths of the reference sequences; the stream stands at the first record then."""
    if take(4) != b"BAM\1":
        raise ValueError("not a BAM file")
    (size,) = struct.unpack("<i", take(4))
    take(size)
    (count,) = struct.unpack("<i", take(4))
    found = []
    for _ in range(count):
        (size,) = struct.unpack("<i", take(4))
        name = take(size)[:-1].decode()
        found.append((name, struct.unpack("<i", take(4))[0]))
    return found


# ---------------------------------------------------------------- records


def _turned(values: bytes, table: bytes, never: bytes) -> bytes:
    found = values.translate(table, never)
    if len(found) != len(values):
        raise ValueError("a quality is out of range")
    return found


def _md(data: bytes) -> str | None:
    if data[:3] == b"MDZ":
        return data[3 : data.index(0, 3)].decode()
    at = 0
    while at + 3 <= len(data):
        tag, kind = data[at : at + 2], chr(data[at + 2])
        at += 3
        if kind in "ZH":
            end = data.index(0, at)
            if tag == b"MD":
                return data[at:end].decode()
            at = end + 1
        elif kind == "B":
            (count,) = struct.unpack_from("<i", data, at + 1)
            at += 5 + SIZES[chr(data[at])] * count
        else:
            at += SIZES[kind]
    return None


@lru_cache(65_536)
def _cigar(packed: bytes) -> str:
    return "".join(f"{p >> 4}{OPERATIONS[p & 15]}" for p in struct.unpack(f"<{len(packed) // 4}I", packed)) or "*"


@lru_cache(65_536)
def _packed_cigar(cigar: str) -> tuple[int, bytes, int]:
    """Number of operations, their bytes, and the bases that they take."""
    operations = [(int(n), OPERATIONS.index(o)) for n, o in re.findall(r"(\d+)([MIDNSHP=X])", cigar)]
    return len(operations), b"".join(struct.pack("<I", n << 4 | o) for n, o in operations), sum(n for n, o in operations if OPERATIONS[o] in "MIS=X")


def _decoded(block: bytes, names: list[str]) -> tuple:
    """read_id, flag, contig, cigar, qual, md of a record."""
    ref, _, name_size, _, _, operations, flag, bases, _, _, _ = _FIXED.unpack_from(block)
    at = _FIXED.size
    name = block[at : at + name_size - 1].decode()
    at += name_size
    cigar = _cigar(block[at : at + 4 * operations])
    at += 4 * operations + (bases + 1) // 2
    quality = block[at : at + bases]
    shown = "*" if not quality or quality[0] == 0xFF else _turned(quality, _SHOWN, _TOO_HIGH).decode("latin-1")
    return name, flag, names[ref] if ref >= 0 else "*", cigar, shown, _md(block[at + bases :])


def _size_of(data: bytes, at: int, count: int) -> int | None:
    """Bytes of the record at a place of ``data``, by its fixed part; None where that can't be one."""
    (size,) = struct.unpack_from("<i", data, at)
    ref, start, name_size, _, _, operations, _, bases, mate, mate_start, _ = _FIXED.unpack_from(data, at + 4)
    if not (32 <= size <= MOST_RECORD_BYTES and -1 <= ref < count and -1 <= mate < count and name_size and bases >= 0 and start >= -1 and mate_start >= -1):
        return None
    return None if 32 + name_size + 4 * operations + (bases + 1) // 2 + bases > size else size + 4


def _reads_well(data: bytes, at: int) -> bool:
    """Whether the name and the operations of the record at a place are such."""
    name_size, operations = data[at + 12], struct.unpack_from("<H", data, at + 16)[0]
    name = data[at + 36 : at + 36 + name_size]
    return name[-1] == 0 and all(33 <= c <= 126 for c in name[:-1]) and all(p & 15 < len(OPERATIONS) for p in struct.unpack_from(f"<{operations}I", data, at + 36 + name_size))


def _chained(stream: _Stream, count: int) -> bool:
    """Whether a chain of records begins at the next byte: CHAIN of them, or as many as there are to the file's end."""
    ahead = 0
    for _ in range(CHAIN):
        if ahead and not stream.have(ahead + 1):
            return True
        if not stream.have(ahead + 36) or (size := _size_of(stream.data, stream.at + ahead, count)) is None:
            return False
        if not stream.have(ahead + size) or not _reads_well(stream.data, stream.at + ahead):
            return False
        ahead += size
    return True


def _find_record(stream: _Stream, count: int, end: int) -> bool:
    """Moves a stream to the first record that starts in it before block ``end``."""
    while stream.have(1) and stream.place()[0] < end:
        if _chained(stream, count):
            return True
        stream.at += 1
    return False


def _opened(path: str):
    """The file system and plain path of an address."""
    import os

    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else os.path.abspath(path))


def bam_files(path: str) -> list[str]:
    """Addresses of the BAM files of a folder, a glob or a single file, by name."""
    from pyarrow import fs

    system, plain = _opened(path)
    folder, pattern = (posixpath.dirname(plain), posixpath.basename(plain)) if any(c in plain for c in "*?[") else (plain, "*.bam")
    prefix = path[: len(path) - len(plain)] if path.endswith(plain) else ""
    if system.get_file_info(folder).type == fs.FileType.File:
        return [prefix + folder]
    found = system.get_file_info(fs.FileSelector(folder))
    return sorted(prefix + f.path for f in found if f.type == fs.FileType.File and fnmatch.fnmatch(f.base_name, pattern))


def _whole(file, size: int) -> Iterator[tuple[int, bytes]]:
    """Unpacked pieces of a file that is gzip but not BGZF, as if each were a block."""
    import gzip

    with gzip.GzipFile(fileobj=file) as stream:
        at = 0
        while piece := stream.read(1 << 20):
            yield at, piece
            at += 1


@lru_cache(2)
def _known_header(path: str, size: int, changed: int | None) -> tuple[list[str], tuple[int, int] | None]:
    """Names of the reference sequences of a BGZF file, and the first record's place, if it has one.

    A worker reads many stretches of a file, and every one needs the whole header, which may have as many names as there are contigs.
    """
    system, plain = _opened(path)
    with system.open_input_file(plain) as file:
        stream = _Stream(_blocks(file, 0))
        names = [n for n, _ in _header(stream.take)]
        return names, stream.place() if stream.have(1) else None


def records(path: str, start: int, end: int | None) -> Iterator[tuple[int, tuple]]:
    """(ord, fields) of the records that start in bytes start to end of a file; ``end`` is None where it can't be split.

    ord is the block's place and the record's within it, as one number; in a file that can't be split the record's number.
    """
    system, plain = _opened(path)
    info = system.get_file_info(plain)
    size = info.size
    with system.open_input_file(plain) as file:
        if end is None:
            stream = _Stream(_whole(file, size))
            names, number = [n for n, _ in _header(stream.take)], 0
            while stream.have(4):
                yield number, _decoded(stream.take(struct.unpack("<i", stream.take(4))[0]), names)
                number += 1
            return
        names, first = _known_header(path, size, info.mtime_ns)
        if first is None:
            return
        if start > first[0]:
            begin = _first_block(file, start, size)
            stream = _Stream(_blocks(file, begin))
            if not _find_record(stream, len(names), end):
                return
        else:
            stream = _Stream(_blocks(file, first[0]))
            stream.have(first[1] + 1)
            stream.at = first[1]
        while stream.have(4) and (place := stream.place())[0] < end:
            yield place[0] << 16 | place[1], _decoded(stream.take(struct.unpack_from("<i", stream.data, stream.at)[0] + 4)[4:], names)


# ---------------------------------------------------------------- Spark sources


class _Split(InputPartition):
    def __init__(self, path: str, start: int, end: int | None):
        super().__init__((path, start))
        self.path, self.start, self.end = path, start, end


class BamReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.split = options["path"], max(1, int(options.get("split", SPLIT_BYTES)))
        self.sample = options.get("sample", SAMPLE)

    def name_of(self, path: str) -> str:
        base = posixpath.basename(path)
        met = re.fullmatch(self.sample, base)
        return met[1] if met else base

    def partitions(self) -> list[InputPartition]:
        found = []
        for path in bam_files(self.path):
            system, plain = _opened(path)
            with system.open_input_file(plain) as file:
                size, blocked = file.size(), _block_size(file.read(18)) is not None
            found += [_Split(path, at, min(size, at + self.split)) for at in range(0, size, self.split)] if blocked else [_Split(path, 0, None)]
        return found

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        sample, rows = self.name_of(partition.path), []
        for order, (name, *rest) in records(partition.path, partition.start, partition.end):
            rows.append((sample, name, order, *rest))
            if len(rows) == BATCH_RECORDS:
                yield _batch(rows)
                rows = []
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(_TYPES)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _TYPES, strict=True)], schema=_TYPES)


class HeaderReader(BamReader):
    def partitions(self) -> list[InputPartition]:
        return [_Split(p, 0, None) for p in bam_files(self.path)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        """Reads no further than the header."""
        system, plain = _opened(partition.path)
        with system.open_input_file(plain) as file:
            for i, (name, size) in enumerate(_header(_Stream(_whole(file, 0)).take)):
                yield self.name_of(partition.path), i, name, size


class BamSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return BamReader(self.options)


class HeaderSource(BamSource):
    @classmethod
    def name(cls) -> str:
        return "bam_header"

    def schema(self) -> str:
        return "sample STRING, ref_id INT, name STRING, length INT"

    def reader(self, schema) -> DataSourceReader:
        return HeaderReader(self.options)


def register(spark) -> None:
    for source in (BamSource, HeaderSource):
        spark.dataSource.register(source)


def bam_contigs(spark, path: str, least: int = 2000) -> DataFrame:
    """(ref_id, name, length) of the headers of BAM files, read by executors."""
    register(spark)
    return spark.read.format("bam_header").load(path).select("ref_id", "name", "length").distinct().filter(F.col("length") >= least)


# ---------------------------------------------------------------- writing


def packed_record(name: str, flag: int, ref: int, cigar: str, qual: str, md: str | None) -> bytes:
    """A record's bytes; bases are unknown (N), as many as there are qualities or, without any, as the operations take."""
    count, operations, taken = _packed_cigar(cigar)
    bases = len(qual) if qual != "*" else taken
    quality = _turned(qual.encode("latin-1"), _HIDDEN, _TOO_LOW) if qual != "*" else b"\xff" * bases
    body = _FIXED.pack(ref, 0 if ref >= 0 else -1, len(name.encode()) + 1, 255, 0, count, flag, bases, -1, -1, 0)
    body += name.encode() + b"\0" + operations + b"\xff" * ((bases + 1) // 2) + quality
    body += b"MDZ" + md.encode() + b"\0" if md is not None else b""
    return struct.pack("<i", len(body)) + body


def packed_header(contigs: list[tuple[str, int]], text: str = "@HD\tVN:1.6\tSO:unsorted\n") -> bytes:
    head = text.encode()
    parts = [struct.pack("<i", len(n.encode()) + 1) + n.encode() + b"\0" + struct.pack("<i", size) for n, size in contigs]
    return b"BAM\1" + struct.pack("<i", len(head)) + head + struct.pack("<i", len(contigs)) + b"".join(parts)


def packed_block(data: bytes) -> bytes:
    """One BGZF block of at most BLOCK_BYTES."""
    squeeze = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = squeeze.compress(data) + squeeze.flush()
    return b"\x1f\x8b\x08\x04" + b"\0" * 4 + b"\0\xff" + struct.pack("<H", 6) + b"BC" + struct.pack("<HH", 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


class _Writer:
    """Packs bytes into blocks of a file as they come."""

    def __init__(self, path: str):
        system, plain = _opened(path)
        system.create_dir(posixpath.dirname(plain), recursive=True)
        self.out, self.held = system.open_output_stream(plain), bytearray()

    def add(self, data: bytes) -> None:
        self.held += data
        while len(self.held) >= BLOCK_BYTES:
            self.out.write(packed_block(bytes(self.held[:BLOCK_BYTES])))
            del self.held[:BLOCK_BYTES]

    def close(self) -> None:
        if self.held:
            self.out.write(packed_block(bytes(self.held)))
        self.out.write(END_BLOCK)
        self.out.close()


#: The sample of a file that ``write`` made.
WRITTEN_SAMPLE = r"(.*)\.\d+\.bam"


def write(records: DataFrame, contigs: DataFrame, folder: str, parts: int = 1) -> DataFrame:
    """Writes records (the columns of SCHEMA) as folder/<sample>.<part>.bam and gives (path, records) of the files.

    ``contigs`` (ref_id, name, length) make the header, which every writer holds.  All records of a read of a sample
    are in one file, in their order; a sample with many reads is written by ``parts`` tasks.  A task that is
    repeated writes its file anew.  Sample and read must not be null; a contig that the header lacks is written as ``*``.
    """
    header = [(r["name"], r["length"]) for r in contigs.orderBy("ref_id").select("name", "length").collect()]  # as large as the header
    numbers = {n: i for i, (n, _) in enumerate(header)}
    placed = records.withColumn("part", F.pmod(F.xxhash64("read_id"), F.lit(parts)).cast("int"))
    columns = ["sample", "part", "read_id", "flag", "contig", "cigar", "qual", "md"]

    def run(batches):
        held, writer, count, head = None, None, 0, None
        for batch in batches:
            done = []
            for sample, part, name, flag, contig, cigar, qual, md in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (sample, part) != held:
                    if writer:
                        writer.close()
                        done.append((f"{folder}/{held[0]}.{held[1]}.bam", count))
                    held, count = (sample, part), 0
                    writer = _Writer(f"{folder}/{sample}.{part}.bam")
                    head = head or packed_header(header)
                    writer.add(head)
                writer.add(packed_record(name, flag or 0, numbers.get(contig, -1), cigar or "*", qual or "*", md))
                count += 1
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], ["path", "records"])
        if writer:
            writer.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{held[0]}.{held[1]}.bam"]), pa.array([count], pa.int64())], ["path", "records"])

    ordered = placed.repartition("sample", "part").sortWithinPartitions("sample", "part", "read_id", "ord").select(*columns)
    return cut(ordered.mapInArrow(run, "path string, records long"))
