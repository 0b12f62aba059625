"""Sealed record files as a Spark data source, with position-aware recovery.

A record is 20,480 bytes: a 16-byte seal, a label area, and at byte 3,072 a cell that starts with a 64-byte header
(opcode, subject, predicate, target, flags, epoch; little-endian).  The reader cuts files into ranges of records, checks
the seals of a range together, and reports each record's health instead of failing.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

#: Fixed values of the format.
RECORD, SEAL, CELL, HEADER = 20_480, 16, 3_072, 64
LANE1, LANE2 = 14695981039346656037, 1099511628211099511
MULT1, MULT2 = 1099511628211, 14695981039346656037
#: Records read and checked together (10 MB).
RANGE = 512
SCHEMA = "path string, slot long, opcode long, subject_id binary, predicate_id binary, target_id binary, flags long, epoch long, fault string"


def seals(rows: np.ndarray) -> np.ndarray:
    """Seals of records (one a row), all rows at a time, byte by byte; 64-bit arithmetic wraps."""
    n = len(rows)
    h1, h2 = np.full(n, LANE1, dtype=np.uint64), np.full(n, LANE2, dtype=np.uint64)
    columns = np.ascontiguousarray(rows[:, SEAL:].T)
    for i, column in enumerate(columns):
        b = column.astype(np.uint64)
        h1 = (h1 ^ b) * np.uint64(MULT1)
        h2 = ((h2 ^ b) + (b << np.uint64(i % 7 * 8))) * np.uint64(MULT2)
    return np.stack((h1, h2), axis=1).astype("<u8").view(np.uint8).reshape(n, SEAL)


def build(opcode: int, subject: bytes, predicate: bytes, target: bytes, flags: int, epoch: int, payload: bytes = b"") -> bytes:
    """A record without its seal; ids are padded to 16 bytes and refused beyond."""
    if max(map(len, (subject, predicate, target))) > 16:
        raise ValueError("an id is longer than 16 bytes")
    head = opcode.to_bytes(8, "little") + b"".join(x.ljust(16, b"\0") for x in (subject, predicate, target)) + flags.to_bytes(4, "little") + epoch.to_bytes(4, "little")
    body = (head + payload).ljust(RECORD - CELL, b"\0")
    if len(body) > RECORD - CELL:
        raise ValueError("the payload does not fit")
    return bytes(CELL) + body


def seal_all(records: list[bytes]) -> list[bytes]:
    """The records with their seals."""
    if not records:
        return []
    rows = np.frombuffer(b"".join(records), dtype=np.uint8).reshape(-1, RECORD).copy()
    rows[:, :SEAL] = seals(rows)
    return [r.tobytes() for r in rows]


def faults(rows: np.ndarray) -> list[str | None]:
    """unwritten, opcode, seal, or none, for each record."""
    blank = ~rows[:, :HEADER].any(axis=1)
    no_opcode = ~rows[:, CELL : CELL + 8].any(axis=1)
    broken = (rows[:, :SEAL] != seals(rows)).any(axis=1)
    return ["unwritten" if a else "opcode" if b else "seal" if c else None for a, b, c in zip(blank, no_opcode, broken, strict=True)]


class _Range(InputPartition):
    def __init__(self, path: str, first: int, count: int, tail: bool):
        self.path, self.first, self.count, self.tail = path, first, count, tail


class _Reader(DataSourceReader):
    def __init__(self, uri: str):
        self.uri = uri

    def partitions(self) -> list[InputPartition]:
        from pyarrow.fs import FileSelector, FileSystem, FileType

        files, place = FileSystem.from_uri(self.uri)
        found = []
        for info in sorted(files.get_file_info(FileSelector(place)), key=lambda i: i.path):
            if info.type == FileType.File and not info.base_name.startswith((".", "_")):
                whole = info.size // RECORD
                found += [_Range(info.path, i, min(RANGE, whole - i), False) for i in range(0, whole, RANGE)]
                if info.size % RECORD:
                    found.append(_Range(info.path, whole, 0, True))
        return found

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        files, _ = FileSystem.from_uri(self.uri)
        name = part.path.rsplit("/", 1)[-1]
        if part.tail:  # less than a record stands at the end
            rows, found = np.zeros((1, RECORD), dtype=np.uint8), ["partial"]
        else:
            with files.open_input_file(part.path) as file:
                file.seek(part.first * RECORD)
                rows = np.frombuffer(file.read(part.count * RECORD), dtype=np.uint8).reshape(-1, RECORD)
            found = faults(rows)
        cell = rows[:, CELL : CELL + HEADER]
        number = lambda a, b: np.ascontiguousarray(cell[:, a:b]).view(f"<u{b - a}")[:, 0].astype(np.int64)
        ids = lambda a: pa.array([r.tobytes() for r in cell[:, a : a + 16]], pa.binary())
        yield pa.RecordBatch.from_arrays(
            [pa.array([name] * len(rows)), pa.array(np.arange(part.first, part.first + len(rows))), pa.array(number(0, 8)), ids(8), ids(24), ids(40), pa.array(number(56, 60)), pa.array(number(60, 64)), pa.array(found, pa.string())],
            ["path", "slot", "opcode", "subject_id", "predicate_id", "target_id", "flags", "epoch", "fault"],
        )


class _Written(WriterCommitMessage):
    def __init__(self, draft: str, path: str):
        self.draft, self.path = draft, path


class _Writer(DataSourceWriter):
    """One file a task; drafts get their names at the commit of the job."""

    def __init__(self, uri: str):
        self.uri = uri

    def write(self, rows: Iterator) -> WriterCommitMessage:
        from pyarrow.fs import FileSystem
        from pyspark import TaskContext

        files, place = FileSystem.from_uri(self.uri)
        files.create_dir(place, recursive=True)
        draft = f"{place}/.{uuid.uuid4().hex}"
        with files.open_output_stream(draft, compression=None) as out:
            for row in rows:
                out.write(bytes(row[0]))
        return _Written(draft, f"{place}/part-{TaskContext.get().partitionId():05d}.rec")

    def commit(self, messages: list) -> None:
        from pyarrow.fs import FileSystem

        files, _ = FileSystem.from_uri(self.uri)
        for m in messages:
            if m is not None:
                files.move(m.draft, m.path)

    def abort(self, messages: list) -> None:
        from pyarrow.fs import FileSystem

        files, _ = FileSystem.from_uri(self.uri)
        for m in messages:
            if m is not None:
                files.delete_file(m.draft)


class SealedSource(DataSource):
    """``spark.read.format("sealed").load(uri)``; writing takes one binary column of whole records."""

    @classmethod
    def name(cls) -> str:
        return "sealed"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"])


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    spark.dataSource.register(SealedSource)


def recover(records: DataFrame, watermark: int) -> DataFrame:
    """Add health to the records of each file: healthy, corrupt (below the watermark) or torn; what follows a torn one goes.

    One aggregate a file finds the first torn slot; the join reads a row a file.
    """
    torn = records.where(F.col("fault").isNotNull() & (F.col("slot") >= watermark)).groupBy(F.col("path").alias("p")).agg(F.min("slot").alias("torn_at"))
    out = records.join(torn, F.col("path") == F.col("p"), "left").where(F.col("torn_at").isNull() | (F.col("slot") <= F.col("torn_at")))
    health = F.when(F.col("fault").isNull(), "healthy").when(F.col("slot") < watermark, "corrupt").otherwise("torn")
    return out.withColumn("health", health).drop("p", "torn_at")


def readable(records: DataFrame, mode: str = "permissive") -> DataFrame:
    """Corrupt rows kept (permissive), left out (dropcorrupt) or refused (failfast)."""
    if mode == "permissive":
        return records
    if mode == "dropcorrupt":
        return records.where("fault IS NULL")
    guarded = F.when(F.col("fault").isNotNull(), F.raise_error(F.concat(F.lit("corrupt slot "), F.col("slot").cast("string")))).otherwise(F.col("opcode"))
    return records.withColumn("opcode", guarded)
