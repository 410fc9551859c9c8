"""Capture files as frames. Classic ones are split by byte ranges.

A capture has no marks to find record starts from, so a range on its own cannot
tell where its first record begins. Each range therefore maps every start that
could be one to the place where its chain of records leaves the range; starts
that run into an impossible header drop out. Following these maps from the first
record of the file gives the true start of every range, exactly, without reading
the file in one piece. Files of a single range skip that step.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from floodsift.schemas import FRAMES
from floodsift.session import settle

SPLIT_BYTES = 32 << 20
BATCH_ROWS = 4096

# Fixed values of the file formats: sizes, the magic numbers with the byte order and the fraction of a
# second they stand for, the snap length of files that name none, the link type of Ethernet, and the
# block types of the block format.
FILE_HEADER, RECORD_HEADER = 24, 16
MAGICS = {
    b"\xd4\xc3\xb2\xa1": ("<", 1_000_000),
    b"\xa1\xb2\xc3\xd4": (">", 1_000_000),
    b"\x4d\x3c\xb2\xa1": ("<", 1_000_000_000),
    b"\xa1\xb2\x3c\x4d": (">", 1_000_000_000),
}
UNLIMITED = 262_144
ETHERNET = 1
GZIP = b"\x1f\x8b"
SECTION, BYTE_ORDER = b"\x0a\x0d\x0d\x0a", b"\x4d\x3c\x2b\x1a"
INTERFACE, SIMPLE, ENHANCED = 1, 3, 6
LONGEST_BLOCK = 16 << 20
# A packet's number is its file's place among those of the link and its offset in the file.
OFFSET_BITS = 40

FOUND = pa.schema(
    [
        ("path", pa.string()),
        ("link_id", pa.string()),
        ("file", pa.int64()),
        ("packet_id", pa.int64()),
        ("us", pa.int64()),
        ("frame", pa.binary()),
        ("error", pa.string()),
    ]
)


class Damaged(ValueError):
    """A place in a capture that cannot be read on from."""

    def __init__(self, path: str, at: int, what: str) -> None:
        super().__init__(f"{path}: {what} at byte {at}")
        self.at, self.what = at, what

    def __reduce__(self):
        return ValueError, (str(self),)


def _opened(path: str):
    """(file system, name) of a path as Spark lists it; Spark's names of S3 are mapped."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    scheme, mark, rest = path.partition("://")
    return fs.FileSystem.from_uri(f"s3://{rest}" if mark and scheme in ("s3a", "s3n") else path)


def _link_checked(path: str, link_type: int, at: int) -> None:
    if link_type != ETHERNET:
        raise Damaged(path, at, f"link type {link_type}, not Ethernet,")


class _Capture:
    """One opened file; positions are byte offsets in it."""

    def __init__(self, path: str, length: int) -> None:
        self.path = path
        system, name = _opened(path)
        self.file = system.open_input_file(name)
        self.length = length
        head = bytes(self.file.read_at(FILE_HEADER, 0))
        if head[:4] not in MAGICS or len(head) < FILE_HEADER:
            raise Damaged(path, 0, "no capture file header")
        self.order, self.fraction = MAGICS[head[:4]]
        self.longest, link_type = struct.unpack(self.order + "II", head[16:])
        self.longest = self.longest or UNLIMITED
        _link_checked(path, link_type & 0xFFFFFFF, 20)
        self.header = struct.Struct(self.order + "IIII")

    def load(self, start: int, stop: int) -> None:
        self.base = start
        self.data = bytes(self.file.read_at(min(stop, self.length) - start, start))

    def next_record(self, at: int) -> int | None:
        """Where the record at ``at`` ends, or None if there can be none or the file ends in it."""
        inside = at - self.base
        if inside + RECORD_HEADER > len(self.data):
            return None
        _, part, kept, original = self.header.unpack_from(self.data, inside)
        stop = at + RECORD_HEADER + kept
        possible = part < self.fraction and kept <= min(original, self.longest) and stop <= self.length
        return stop if possible else None

    def cut_off(self, at: int) -> bool:
        """Whether the end of the file cuts off a possible record at ``at``."""
        inside = at - self.base
        if at + RECORD_HEADER > self.length:
            return True
        _, part, kept, original = self.header.unpack_from(self.data, inside)
        possible = part < self.fraction and kept <= min(original, self.longest)
        return possible and at + RECORD_HEADER + kept > self.length

    def possible_starts(self, start: int, stop: int) -> list[int]:
        """Offsets in a range whose bytes could be a record header, by the same rule."""
        count = min(stop - start, self.longest + RECORD_HEADER, len(self.data) - RECORD_HEADER + 1)
        if count <= 0:
            return []
        raw = np.frombuffer(self.data, np.uint8, count + RECORD_HEADER - 1).astype(np.uint32)
        shifts = (0, 8, 16, 24) if self.order == "<" else (24, 16, 8, 0)

        def field(position: int) -> np.ndarray:
            parts = [raw[position + i : position + i + count] << s for i, s in enumerate(shifts)]
            return parts[0] | parts[1] | parts[2] | parts[3]

        kept = field(8)
        good = (field(4) < self.fraction) & (kept <= np.minimum(field(12), self.longest))
        return (np.flatnonzero(good) + start).tolist()


def _exits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each range, every start that survives it and where its chain leaves it."""
    for batch in batches:
        for row in batch.itertuples():
            capture = _Capture(row.path, row.length)
            capture.load(row.start, row.stop + RECORD_HEADER)
            first = row.range == 0
            starts = [FILE_HEADER] if first else capture.possible_starts(row.start, row.stop)
            leaves: dict[int, int | None] = {}
            for start in starts:
                chain, at = [], start
                while at is not None and at < row.stop and at not in leaves:
                    chain.append(at)
                    at = capture.next_record(at)
                leaving = leaves[at] if at in leaves else at
                leaves.update(dict.fromkeys(chain, leaving))
            found = [(row.path, row.range, s, leaves[s]) for s in starts if leaves.get(s) is not None]
            yield pd.DataFrame(found, columns=["path", "range", "entry", "exit"])


def _follow(exits: pd.DataFrame) -> pd.DataFrame:
    """The true start of each range of one file; a file has one range per 32 MiB."""
    path = exits["path"].iloc[0]
    maps: dict[int, dict[int, int]] = {}
    for number, entry, leaving in zip(exits["range"], exits["entry"], exits["exit"]):
        maps.setdefault(number, {})[entry] = leaving
    at, found = FILE_HEADER, []
    for number in range(max(maps) + 1):
        found.append((path, number, at))
        if at not in maps.get(number, {}):
            break  # the file is cut off or damaged in this range; its reader tells which
        at = maps[number][at]
    return pd.DataFrame(found, columns=["path", "range", "entry"])


def _records(capture: _Capture, entry: int, stop: int) -> Iterator[tuple[int, int, bytes]]:
    """Offset, microseconds and bytes of the records that start before ``stop``."""
    # The last record may reach past the range.
    capture.load(entry, stop + RECORD_HEADER + capture.longest)
    per_micro = capture.fraction // 1_000_000
    at = entry
    while at < stop and (after := capture.next_record(at)) is not None:
        inside = at - capture.base
        second, part, kept, _ = capture.header.unpack_from(capture.data, inside)
        begin = inside + RECORD_HEADER
        yield at, second * 1_000_000 + part // per_micro, capture.data[begin : begin + kept]
        at = after
    if at < stop and not capture.cut_off(at):
        raise Damaged(capture.path, at, "no possible record")


class _Stream:
    """A file read once from front to back, decompressed if need be."""

    def __init__(self, path: str) -> None:
        system, name = _opened(path)
        packed = bytes(system.open_input_file(name).read_at(2, 0)) == GZIP
        self.file = system.open_input_stream(name, compression="gzip" if packed else None)
        self.path, self.at = path, 0

    def take(self, size: int) -> bytes | None:
        """The next ``size`` bytes; None if the file ends before."""
        found = bytes(self.file.read(size))
        self.at += len(found)
        return found if len(found) == size else None


def _in_order(path: str) -> Iterator[tuple[int, int, bytes]]:
    """Like :func:`_records` for files that are read in one piece."""
    stream = _Stream(path)
    magic = stream.take(4)
    if magic == SECTION:
        yield from _blocks(stream)
    elif magic in MAGICS:
        yield from _plain(stream, magic)
    else:
        raise Damaged(path, 0, "no capture file header")


def _plain(stream: _Stream, magic: bytes) -> Iterator[tuple[int, int, bytes]]:
    order, fraction = MAGICS[magic]
    rest = stream.take(FILE_HEADER - 4)
    if rest is None:
        raise Damaged(stream.path, 0, "no capture file header")
    longest, link_type = struct.unpack(order + "II", rest[12:])
    _link_checked(stream.path, link_type & 0xFFFFFFF, 20)
    at = stream.at
    while (head := stream.take(RECORD_HEADER)) is not None:
        second, part, kept, original = struct.unpack(order + "IIII", head)
        if part >= fraction or kept > min(original, longest or UNLIMITED):
            raise Damaged(stream.path, at, "no possible record")
        if (frame := stream.take(kept)) is None:
            return
        yield at, second * 1_000_000 + part // (fraction // 1_000_000), frame
        at = stream.at


def _blocks(stream: _Stream) -> Iterator[tuple[int, int, bytes]]:
    """Packets of the block format; their times are counted in the units of their interface."""
    order, kind, at = "<", SECTION, 0
    units: list[int] = []
    while kind is not None:
        if kind == SECTION:
            head = stream.take(8)
            if head is None:
                return
            order = "<" if head[4:] == BYTE_ORDER else ">"
            if head[4:] not in (BYTE_ORDER, BYTE_ORDER[::-1]):
                raise Damaged(stream.path, at, "no section header")
            size, read, units = struct.unpack(order + "I", head[:4])[0], 12, []
        else:
            head = stream.take(4)
            if head is None:
                return
            size, read = struct.unpack(order + "I", head)[0], 8
        if size % 4 or not read + 4 <= size <= LONGEST_BLOCK:
            raise Damaged(stream.path, at, "no possible block")
        body = stream.take(size - read)
        if body is None:
            return
        number = None if kind == SECTION else struct.unpack(order + "I", kind)[0]
        try:
            if struct.unpack(order + "I", body[-4:])[0] != size:
                raise Damaged(stream.path, at, "no possible block")
            if number == INTERFACE:
                _link_checked(stream.path, struct.unpack_from(order + "H", body)[0], at)
                units.append(_units(body, order))
            elif number == ENHANCED:
                interface, high, low, kept, _ = struct.unpack_from(order + "IIIII", body)
                if kept > len(body) - 24:
                    raise Damaged(stream.path, at, "no possible block")
                yield at, ((high << 32) | low) * 1_000_000 // units[interface], body[20 : 20 + kept]
            elif number == SIMPLE:
                raise Damaged(stream.path, at, "packet without a time")
        except (struct.error, IndexError):
            raise Damaged(stream.path, at, "no possible block") from None
        at, kind = stream.at, stream.take(4)


def _units(body: bytes, order: str) -> int:
    """Units of time a second of an interface: option 9, microseconds by default."""
    at = 8
    while at + 4 <= len(body) - 4:
        code, size = struct.unpack_from(order + "HH", body, at)
        if code == 0:
            break
        if code == 9:
            value = body[at + 4]
            return 1 << (value & 127) if value & 128 else 10**value
        at += 4 + size + -size % 4
    return 1_000_000


def _kinds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """How each file is read, and the time of its first packet."""
    for batch in batches:
        found = []
        for row in batch.itertuples():
            system, name = _opened(row.path)
            magic = bytes(system.open_input_file(name).read_at(4, 0))
            whole = magic == SECTION or magic[:2] == GZIP
            first = None
            try:
                if whole:
                    records = _in_order(row.path)
                else:
                    capture = _Capture(row.path, row.length)
                    records = _records(capture, FILE_HEADER, min(FILE_HEADER + 1, row.length))
                first = next((us for _, us, _ in records), None)
            except Damaged:
                pass  # reported where the file is read
            found.append((row.path, row.length, whole, first))
        yield pd.DataFrame(found, columns=["path", "length", "whole", "first_us"]).astype({"first_us": "Int64"})


def _frames(raising: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                records = _reported(row, raising)
                while rows := list(islice(records, BATCH_ROWS)):
                    same = ([row[name]] * len(rows) for name in ("path", "link_id", "file"))
                    columns = [*same, *zip(*rows)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, field.type) for c, field in zip(columns, FOUND)], schema=FOUND
                    )

    return read


def _reported(row: dict, raising: bool) -> Iterator[tuple]:
    """(offset, microseconds, frame, error); the last row of a damaged piece is its error."""
    try:
        if row["entry"] is None:
            records = _in_order(row["path"])
        else:
            records = _records(_Capture(row["path"], row["length"]), row["entry"], row["stop"])
        for at, us, frame in records:
            yield at, us, frame, None
    except Damaged as damaged:
        if raising:
            raise
        yield damaged.at, None, None, damaged.what


def _read(spark: SparkSession, path: str, split_bytes: int, link: Column | None, raising: bool) -> DataFrame:
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    listed = listed.select("path", "length")
    files = settle(
        listed.repartition(max(1, min(listed.count(), 100_000)), "path").mapInPandas(
            _kinds, "path string, length bigint, whole boolean, first_us bigint"
        )
    )
    named = files.withColumn("link_id", (F.col("path") if link is None else link).cast("string"))
    earlier = Window.partitionBy("link_id").orderBy(F.asc_nulls_first("first_us"), "path")
    numbers = named.select("path", "link_id", (F.row_number().over(earlier) - 1).cast("bigint").alias("file"))

    last = F.expr(f"greatest(length - 1, 0) div {split_bytes}")
    ranges = (
        files.where("not whole")
        .select("path", "length")
        .withColumn("range", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
        .withColumn("start", F.col("range") * split_bytes)
        .withColumn("stop", F.least(F.col("start") + split_bytes, F.col("length")))
    )
    tasks = max(1, min(ranges.count() + files.where("whole").count(), 100_000))
    several = F.col("length") > split_bytes
    exits = (
        ranges.where(several)
        .repartition(tasks, "path", "range")
        .mapInPandas(_exits, "path string, range bigint, entry bigint, exit bigint")
    )
    entries = exits.groupBy("path").applyInPandas(_follow, "path string, range bigint, entry bigint")
    single = ranges.where(~several).select("path", "range", F.lit(FILE_HEADER).cast("bigint").alias("entry"))
    placed = ranges.join(entries.unionByName(single), ["path", "range"]).select("path", "length", "stop", "entry")
    whole = files.where("whole").select(
        "path", "length", F.col("length").alias("stop"), F.lit(None).cast("bigint").alias("entry")
    )
    # Links and numbers are joined to the ranges: frames that were read are neither moved nor broadcast.
    return placed.unionByName(whole).join(numbers, "path").repartition(tasks, "path", "stop").mapInArrow(
        _frames(raising),
        "path string, link_id string, file bigint, packet_id bigint, us bigint, frame binary, error string",
    )


def read_captures(
    spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES, link: Column | None = None, raising: bool = True
) -> DataFrame:
    """``frames`` of all capture files under ``path``; gzip and the block format are recognised.

    ``link`` names a file's link as an expression over ``path``, so that rotated files can form one
    link; by default every file is a link of its own, named by its whole path. ``packet_id`` is the
    file's place among the link's files, by the time of their first packets, and the offset in the
    file: unique within the link and in capture order, but not dense. With ``raising`` off the rest
    of a damaged piece is left out; see :func:`capture_errors`. Link types other than Ethernet are
    refused.
    """
    if split_bytes <= UNLIMITED + RECORD_HEADER:
        raise ValueError("a range must be longer than the longest record")
    found = _read(spark, path, split_bytes, link, raising).where("error IS NULL")
    number = F.call_function("shiftleft", F.col("file"), F.lit(OFFSET_BITS)) + F.col("packet_id")
    return found.select(
        "link_id", number.alias("packet_id"), F.timestamp_micros("us").alias("ts"), "frame"
    ).to(FRAMES)


def capture_errors(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(path, at, error): the places from which a capture, or the rest of a range, could not be read."""
    found = _read(spark, path, split_bytes, None, raising=False).where("error IS NOT NULL")
    return found.select("path", F.col("packet_id").alias("at"), "error")


def write_captures(frames: DataFrame, folder: str, files: Column, blocks: bool = False) -> DataFrame:
    """Write frames to one capture file for each value of ``files``, a name under ``folder``.

    Returns (file, packets); nothing is written until it is evaluated. A file is written whole by
    one task, in the order of ``packet_id``, so a task that is repeated writes the same bytes.
    ``blocks`` chooses the block format.
    """
    named = frames.select(
        files.alias("file"), "packet_id", F.unix_micros("ts").alias("us"), "frame"
    ).repartition("file").sortWithinPartitions("file", "packet_id")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, out, count = None, None, 0
        for batch in batches:
            for row in batch.to_pylist():
                if row["file"] != name:
                    if out is not None:
                        out.close()
                        yield _written(name, count)
                    name, count = row["file"], 0
                    system, at = _opened(f"{folder}/{name}")
                    system.create_dir(at.rpartition("/")[0], recursive=True)
                    out = system.open_output_stream(at)
                    out.write(_section() if blocks else struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65_535, ETHERNET))
                out.write((_packet_block if blocks else _record)(row["us"], bytes(row["frame"])))
                count += 1
        if out is not None:
            out.close()
            yield _written(name, count)

    return named.mapInArrow(write, "file string, packets bigint")


def _written(name: str, count: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"file": [name], "packets": [count]})


def _record(us: int, frame: bytes) -> bytes:
    return struct.pack("<IIII", us // 1_000_000, us % 1_000_000, len(frame), len(frame)) + frame


def _section() -> bytes:
    section = struct.pack("<4sI4sHHqI", SECTION, 28, BYTE_ORDER, 1, 0, -1, 28)
    return section + struct.pack("<IIHHII", INTERFACE, 20, ETHERNET, 0, 65_535, 20)


def _packet_block(us: int, frame: bytes) -> bytes:
    padded = frame + bytes(-len(frame) % 4)
    size = 32 + len(padded)
    head = struct.pack("<IIIIIII", ENHANCED, size, 0, us >> 32, us & 0xFFFFFFFF, len(frame), len(frame))
    return head + padded + struct.pack("<I", size)
