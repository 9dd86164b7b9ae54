"""Capture files: frames one behind the other, as they came over a connection.

A connection is one file, or a directory of parts named by the sequence number of their first frame. Where frames begin
can only be told by following their lengths from the start of a part. So a part is read in two passes: one task follows
its headers, skipping the payloads, and writes down where splits begin; then every split is read by a task of its own.
Where a part's frames are not numbered one by one, their numbers lie beside it in a file of eight bytes each.

A write goes to a folder of its own, ``job-…``, which gets its name, in one step, when all of it is there. So a write
never touches what was there before; a reader takes no folder whose name begins with an underscore.
"""

import array
import posixpath
import re
import struct
import uuid
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceWriter,
    InputPartition,
    WriterCommitMessage,
)

from podweave.functions.bytes import floor_div
from podweave.operators.frames import frame_bytes

SUFFIX, NUMBERS = ".frames", ".seq"
JOB = re.compile(r"job-[0-9a-f]{32}/")
TRUNCATED = "unexpected end of file"
SCHEMA = "conn string, seq bigint, type int, payload binary, error string"
# Bytes of a split, and of a block in which headers are looked for.
SPLIT, HEADERS = 64 << 20, 1 << 16
MAX_PAYLOAD = 1 << 30
MOST_TASKS = 100_000


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """File system of a URI or a plain path."""
    return fs.FileSystem.from_uri(path if "://" in path else path.removeprefix("file:"))


class Part(InputPartition):
    def __init__(self, path: str):
        self.path = path


def parts(directory: str) -> list[tuple[str, int]]:
    """(path, bytes) of the parts below the directory."""
    files, root = filesystem(directory)
    found = files.get_file_info(fs.FileSelector(root, recursive=True))
    inside = lambda path: path.removeprefix(root.rstrip("/") + "/")
    return [(i.path, i.size) for i in found if i.is_file and i.path.endswith(SUFFIX) and not inside(i.path).startswith("_")]


class CaptureReader(DataSourceReader):
    def __init__(self, options):
        self.directory = options["path"]
        self.limit = int(options.get("maxPayload", MAX_PAYLOAD))

    def partitions(self) -> list[Part]:
        return [Part(path) for path, _ in parts(self.directory)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        return read_split(self.directory, partition.path, 0, None, 0, self.limit)


def read_split(directory: str, path: str, start: int, end: int | None, before: int, limit: int) -> Iterator[pa.RecordBatch]:
    """The frames of a part that begin in bytes start..end (to its end without one); ``before`` frames lie ahead of them."""
    files, root = filesystem(directory)
    name = JOB.sub("", path.removeprefix(root.rstrip("/") + "/"), count=1)
    stem = posixpath.basename(name).removesuffix(SUFFIX)
    conn = posixpath.dirname(name) if stem.isdigit() else name
    first, numbers = int(stem) + before if stem.isdigit() else before, path.removesuffix(SUFFIX) + NUMBERS
    listed = None
    if files.get_file_info(numbers).is_file:
        listed = files.open_input_file(numbers)
        listed.seek(8 * before)
    rows, held = [], 0
    with files.open_input_file(path) as file:
        file.seek(start)
        stream = pa.BufferedInputStream(file, 1 << 20)
        at, left = start, iter(walk(stream, limit))
        while end is None or at < end:
            frame = next(left, None)
            if frame is None:
                break
            size, kind, payload, error = frame
            number = listed.read(8) if listed else b""
            rows.append((conn, struct.unpack("q", number)[0] if len(number) == 8 else first, kind, payload, error))
            at, first, held = at + 5 + size, first + 1, held + len(payload or b"")
            if held >= 1 << 22 or len(rows) >= 10_000:
                yield batch_of(rows)
                rows, held = [], 0
    if listed:
        listed.close()
    if rows:
        yield batch_of(rows)


def splits_of(directory: str, path: str, size: int, split: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, frames before) of the splits of a part: the first frame at or behind each multiple of about ``split``
    bytes begins one. Only headers are looked at; a payload longer than a block is never read."""
    if size <= split:
        yield 0, size, 0
        return
    files, _ = filesystem(directory)
    with files.open_input_file(path) as file:
        at, begun, count, counted, base, block = 0, 0, 0, 0, 0, b""
        while at + 5 <= size:
            if at + 5 > base + len(block):
                file.seek(at)
                base, block = at, file.read(HEADERS)
            at += 5 + struct.unpack_from(">I", block, at - base)[0]
            count += 1
            if at - begun >= split and at < size:
                yield begun, at, counted
                begun, counted = at, count
        yield begun, size, counted


def walk(stream, limit: int) -> Iterator[tuple[int, int | None, bytes | None, str | None]]:
    """(payload's size, type, payload, error) per frame. An end of file inside a frame is an error row, the last one of the file."""
    while True:
        header = stream.read(5)
        if not header:
            return
        if len(header) < 5:
            yield 0, None, None, TRUNCATED
            return
        size, kind = struct.unpack(">IB", header)
        if size > limit:
            yield size, kind, None, f"payload of {size} bytes is over the reader's limit"
            left = size
            while left > 0 and (skipped := stream.read(min(left, 1 << 20))):
                left -= len(skipped)
            continue
        payload = stream.read(size)
        if len(payload) < size:
            yield size, kind, None, TRUNCATED
            return
        yield size, kind, payload, None


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.string()]
    names = ["conn", "seq", "type", "payload", "error"]
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows), kinds)], names=names)


class Written(WriterCommitMessage):
    pass


class CaptureWriter(DataSourceWriter):
    """Tasks write below a hidden folder of this job; renaming it is the whole commit. A repeated task writes the same
    part under a name of its own and takes the first one's place, inside the hidden folder only."""

    def __init__(self, options):
        self.directory, self.job = options["path"], uuid.uuid4().hex

    def write(self, iterator) -> Written:
        files, root = filesystem(self.directory)
        hidden, part, out = posixpath.join(root, f"_job-{self.job}"), None, None
        for row in iterator:
            if part != (row.conn, row.part):
                if out is not None:
                    out.close()
                part, out = (row.conn, row.part), OpenPart(files, posixpath.join(hidden, inside(row.conn)), row.seq)
            out.add(row.seq, row.frame)
        if out is not None:
            out.close()
        return Written()

    def commit(self, messages) -> None:
        files, root = filesystem(self.directory)
        hidden = posixpath.join(root, f"_job-{self.job}")
        if files.get_file_info(hidden).type == fs.FileType.Directory:
            files.move(hidden, posixpath.join(root, f"job-{self.job}"))

    def abort(self, messages) -> None:
        files, root = filesystem(self.directory)
        hidden = posixpath.join(root, f"_job-{self.job}")
        if files.get_file_info(hidden).type == fs.FileType.Directory:
            files.delete_dir(hidden)


class OpenPart:
    """One part being written: its frames, and their numbers if they are not consecutive."""

    def __init__(self, files: fs.FileSystem, folder: str, first: int):
        files.create_dir(folder, recursive=True)
        self.files, self.name, self.first = files, posixpath.join(folder, f"{first:020d}"), first
        self.temporary = posixpath.join(folder, f"_{uuid.uuid4().hex}")
        self.sink, self.numbers = files.open_output_stream(self.temporary), array.array("q")

    def add(self, seq: int, frame: bytes) -> None:
        self.numbers.append(seq)
        self.sink.write(frame)

    def close(self) -> None:
        self.sink.close()
        if any(seq != self.first + at for at, seq in enumerate(self.numbers)):
            with self.files.open_output_stream(self.temporary + NUMBERS) as sink:
                sink.write(self.numbers.tobytes())
            self.files.move(self.temporary + NUMBERS, self.name + NUMBERS)
        self.files.move(self.temporary, self.name + SUFFIX)


def inside(conn: str) -> str:
    """The connection's name as a path that stays below the directory; anything else is an error."""
    parts = (conn or "").split("/")
    if not conn or conn.startswith("/") or any(p in ("", ".", "..") or p.startswith("_") for p in parts) or "://" in conn:
        raise ValueError(f"no name for a connection's folder: {conn!r}")
    return conn


class CaptureSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "podweave_frames"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> CaptureReader:
        return CaptureReader(self.options)

    def writer(self, schema, overwrite) -> CaptureWriter:
        return CaptureWriter(self.options)


def read_capture(spark: SparkSession, directory: str, split_bytes: int = SPLIT, max_payload: int = MAX_PAYLOAD) -> DataFrame:
    """``conn, seq, type, payload, error`` of all ``*.frames`` files: conn is the path below the directory, seq the number
    that was written, or counted from the part's first.

    The driver lists the parts; a part of more than ``split_bytes`` is read by several tasks. A payload over
    ``max_payload`` is an error row.
    """
    found = parts(directory)
    tasks = min(max(1, sum(-(-size // split_bytes) for _, size in found)), MOST_TASKS)

    def places(batches):
        for batch in batches:
            for path, size in zip(batch.column("path").to_pylist(), batch.column("size").to_pylist()):
                for some in in_lists(splits_of(directory, path, size, split_bytes), 10_000):
                    starts, ends, before = (pa.array(v, pa.int64()) for v in zip(*some))
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(some)), starts, ends, before], ["path", "start", "end", "before"])

    def frames(batches):
        for batch in batches:
            for row in batch.to_pylist():
                yield from read_split(directory, row["path"], row["start"], row["end"], row["before"], max_payload)

    listed = spark.createDataFrame(found, "path string, size bigint").repartition(min(max(1, len(found)), tasks), "path")
    splits = listed.mapInArrow(places, "path string, start bigint, end bigint, before bigint")
    return splits.repartition(tasks, "path", "start").mapInArrow(frames, SCHEMA)


def in_lists(rows: Iterator, most: int) -> Iterator[list]:
    while some := list(islice(rows, most)):
        yield some


def write_capture(frames: DataFrame, directory: str, frames_per_part: int = 10_000) -> None:
    """Write frames (``conn, seq, type, payload``) as captures, each connection in parts, in the order of seq.

    Adds to what lies there. ``conn`` is a relative path; one that is absolute, empty, or leads upwards is an error.
    """
    frames.sparkSession.dataSource.register(CaptureSource)
    parts = frames.select(
        F.col("conn").cast("string").alias("conn"), F.col("seq").cast("bigint").alias("seq"),
        floor_div(F.col("seq").cast("bigint"), frames_per_part).alias("part"),
        frame_bytes(F.col("type"), F.col("payload")).alias("frame"),
    )
    ordered = parts.repartition("conn", "part").sortWithinPartitions("conn", "part", "seq")
    ordered.write.format("podweave_frames").mode("append").save(directory)
