"""Growing ``*.log`` files as a stream: each trigger reads the lines completed since the last one.

For log directories on mounted paths. The driver only lists and measures files: the stream's offset maps each file, told
by device, inode and birth, to the size up to which it has been dealt with, and a line belongs to the trigger that holds
its line feed. The task that reads a range looks back for the start of its first line. So a file that is renamed is read
to its end, under the path it had first; a file that shrank is read from its start, and so is one that appears after the
start. A line without its line feed waits. (Where a file system does not tell when a file was made, a new file that gets
the inode of a removed one within one trigger, and is no shorter, is taken for that one.)
"""

import json
import os
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from podweave.sources.identity import measured

STEP = 64 * 1024
SPLIT = 64 * 1024 * 1024
SCHEMA = "path string, chunk bigint, offset bigint, line binary"


def named_log(name: str) -> bool:
    """Whether the extension is exactly ``log``."""
    return os.path.splitext(name)[1] == ".log"


def files(directory: str, wanted=named_log) -> Iterator[tuple[str, str, int]]:
    """(identity, path, size) of the files below the directory whose name is wanted; links are followed."""
    for folder, _, names in os.walk(directory, followlinks=True):
        for name in names:
            if wanted(name):
                path = os.path.join(folder, name)
                found = measured(path)
                if found:
                    yield found[0], path, found[1]


def start_of_line(file: BinaryIO, at: int) -> int:
    """Where the line begins that holds byte ``at``: behind the last line feed before it."""
    while at > 0:
        start = max(0, at - STEP)
        file.seek(start)
        found = file.read(at - start).rfind(b"\n")
        if found >= 0:
            return start + found + 1
        at = start
    return 0


class LinesLost(Exception):
    """Lines that a trigger should have read are gone."""


class Range(InputPartition):
    def __init__(self, identity: str, path: str, place: str, start: int, end: int):
        """Lines of the file whose line feeds are in start..end. ``path`` is its first name, ``place`` its present one."""
        self.identity, self.path, self.place, self.start, self.end = identity, path, place, start, end


class Ranges(InputPartition):
    def __init__(self, ranges: list[Range]):
        """Ranges of several small files, read by one task."""
        self.ranges = ranges


def packed(ranges: list[Range], split: int) -> list[Range | Ranges]:
    """Neighbouring ranges of about ``split`` bytes together, in their order. A file takes ``STEP`` bytes at least, for
    being opened: so a task has a thousand files of a few lines at most, not one of them."""
    groups, held = [], split
    for part in ranges:
        weight = max(part.end - part.start, min(STEP, split))
        if held + weight > split:
            groups.append([])
            held = 0
        groups[-1].append(part)
        held += weight
    return [group[0] if len(group) == 1 else Ranges(group) for group in groups]


class TailReader(DataSourceStreamReader):
    def __init__(self, options):
        self.directory = options["path"]
        self.latest = options.get("startingPosition", "latest") == "latest"
        self.split = int(options.get("splitBytes", SPLIT))
        self.limit = int(options.get("maxBytesPerTrigger", 0))
        self.strict = options.get("failOnDataLoss", "true").lower() != "false"
        self.progress = options.get("progress")
        self.reached: dict | None = self._planned()
        self.first: dict | None = None

    def _planned(self) -> dict | None:
        if not self.progress or not os.path.exists(self.progress):
            return None
        with open(self.progress) as file:
            return json.load(file)

    def _plan(self, offset: dict) -> dict:
        """Keeps the planned end beside the checkpoint, so that the limit holds from the first trigger after a restart."""
        self.reached = offset
        if self.progress:
            os.makedirs(os.path.dirname(self.progress) or ".", exist_ok=True)
            with open(f"{self.progress}.new", "w") as file:
                json.dump(offset, file)
            os.replace(f"{self.progress}.new", self.progress)
        return offset

    def _listing(self) -> dict:
        """Identity to path, place and size, of all log files and of those known before under whatever name."""
        before = self.reached or {}
        found = {}
        for identity, path, size in files(self.directory):
            found[identity] = {"path": before.get(identity, {}).get("path", path), "place": path, "size": size}
        missing = {}
        for identity in before.keys() - found.keys():
            # a file that had been renamed before is looked for under that name first
            place = before[identity]["place"]
            now = measured(place)
            if now and now[0] == identity:
                found[identity] = {"path": before[identity]["path"], "place": place, "size": now[1]}
            else:
                missing[identity] = before[identity]
        if missing:
            for identity, place, size in files(self.directory, lambda name: not named_log(name)):
                if identity in missing:
                    found[identity] = {"path": missing.pop(identity)["path"], "place": place, "size": size}
        for entry in missing.values():
            if entry["end"] < entry["size"] and self.strict:
                raise LinesLost(f"{entry['path']} is gone with {entry['size'] - entry['end']} bytes not read")
        return found

    def initialOffset(self) -> dict:
        if self.first is None:
            self.first = {k: {**e, "end": e["size"]} for k, e in self._listing().items()} if self.latest else {}
            self.reached = self.reached or self.first
        return self.first

    def latestOffset(self) -> dict:
        if self.reached is None and self.progress:  # nothing has been planned yet: Spark may ask for the end first
            self.initialOffset()
        left, out = self.limit, {}
        bounded = self.limit and self.reached is not None
        for identity, entry in sorted(self._listing().items(), key=lambda x: (x[1]["path"], x[0])):
            start = resume_at((self.reached or {}).get(identity), entry)
            end = min(entry["size"], start + left) if bounded else entry["size"]
            left -= end - start
            if end > 0:
                out[identity] = {**entry, "end": end}
        return self._plan(out)

    def partitions(self, start: dict, end: dict) -> list[Range | Ranges]:
        ranges = []
        for identity, entry in sorted(end.items(), key=lambda x: (x[1]["path"], x[0])):
            for at in range(resume_at(start.get(identity), entry), entry["end"], self.split):
                ranges.append(Range(identity, entry["path"], entry["place"], at, min(at + self.split, entry["end"])))
        self.reached = end
        return packed(ranges, self.split)

    def read(self, partition: Range | Ranges) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for part in partition.ranges if isinstance(partition, Ranges) else [partition]:
            for at, line in self._lines(part):
                rows.append((part.path, part.start, at, line))
                held += len(line) + 1
                if held >= 1 << 20:
                    yield self._batch(rows)
                    rows, held = [], 0
        if rows:
            yield self._batch(rows)

    def _lines(self, part: Range) -> Iterator[tuple[int, bytes]]:
        """(offset, line) of a range."""
        file = opened(part)
        if file is None:
            if self.strict:
                raise LinesLost(f"{part.path} went before its bytes {part.start} to {part.end} were read")
            return
        with file:
            at = start_of_line(file, part.start)
            file.seek(at)
            while at < part.end:
                line = file.readline(part.end - at)
                if not line.endswith(b"\n"):
                    break
                yield at, line[:-1]
                at += len(line)
            if os.fstat(file.fileno()).st_size < part.end and self.strict:
                raise LinesLost(f"{part.path} was cut shorter while bytes {part.start} to {part.end} were read")

    @staticmethod
    def _batch(rows: list[tuple[str, int, int, bytes]]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.binary()]
        names = ["path", "chunk", "offset", "line"]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows), kinds)], names=names)


def opened(partition: Range) -> BinaryIO | None:
    """The file of the range, which may have got another name in its folder since the trigger was planned."""
    folder = os.path.dirname(partition.place)
    names = [partition.place]
    while names:
        place = names.pop(0)
        try:
            file = open(place, "rb")
        except OSError:
            file = None
        if file is not None:
            if measured(file.fileno())[0] == partition.identity:
                return file
            file.close()
        if place == partition.place and os.path.isdir(folder):
            number = int(partition.identity.split(":")[1])
            with os.scandir(folder) as entries:
                names += [e.path for e in entries if e.inode() == number]
    return None


def resume_at(old: dict | None, new: dict) -> int:
    """Where to go on in a file: 0 when it is new or cut shorter than what was dealt with."""
    return 0 if old is None or new["size"] < old["end"] else old["end"]


class TailSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "podweave_tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options)


def stream_logs(spark: SparkSession, directory: str, starting: str = "latest", **options) -> DataFrame:
    """Streaming ``path, chunk, offset, line`` of a log directory.

    ``starting``: 'latest' skips what the files hold when the stream first starts (a line half written then is emitted
    whole once it is complete), 'earliest' reads it. ``splitBytes`` bounds a task, which reads many small
    files (``packed``), ``maxBytesPerTrigger`` a trigger: its
    ranges together have so many bytes at most. Spark does not tell a source how far an earlier run came before it asks
    for the first trigger's end; with ``progress``, a file of this stream's own on a path of the driver, that trigger is
    bounded too (a run that ends between planning and logging a trigger may add one more limit to it). Under
    ``availableNow`` Spark asks once, so a bounded run is one trigger.

    A file that goes with bytes known and not read, or goes or shrinks while it is read, ends the stream with `LinesLost`;
    ``failOnDataLoss=False`` goes on without them. What was written and removed between two triggers is not known of.
    """
    spark.dataSource.register(TailSource)
    reader = spark.readStream.format("podweave_tail").option("startingPosition", starting)
    for name, value in options.items():
        reader = reader.option(name, str(value))
    return reader.load(directory).withColumn("line", F.col("line").cast("string"))
