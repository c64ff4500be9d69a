"""A sink of event frames for Structured Streaming, as a Python data source with a two-phase commit.

Each task writes the frames of its rows into a file of its own under `data` and tells its name; the driver's commit of a batch
puts the names of the files of that batch into `commits`, under the batch's number. What no commit names was never
sent: files of tasks that failed, of batches that were aborted, and of a batch that ran, committed and ran again after
a restart, which then has the names of its second run alone. So every frame is read once.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, WriterCommitMessage

from millrace.session import reachable

NAME = "event_frames"


def file_system(uri: str):
    """(pyarrow file system, path) of a folder that driver and executors share."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


@dataclass
class Written(WriterCommitMessage):
    """A task's file and the number of its frames; no file if it had none."""

    file: str | None
    frames: int


class FrameWriter(DataSourceStreamWriter):
    def __init__(self, path: str, columns: list[str]):
        self.path, self.columns = path, columns

    def write(self, iterator: Iterator) -> Written:
        fs, root = file_system(self.path)
        rows = (json.dumps(dict(zip(self.columns, r)), ensure_ascii=False) for r in iterator)
        first = next(rows, None)
        if first is None:
            return Written(None, 0)
        fs.create_dir(os.path.join(root, "data"), recursive=True)
        name, n = f"{uuid.uuid4().hex}.json", 1
        with fs.open_output_stream(os.path.join(root, "data", name)) as out:
            out.write(first.encode() + b"\n")
            for r in rows:
                out.write(r.encode() + b"\n")
                n += 1
        return Written(name, n)

    def commit(self, messages: list[Written | None], batchId: int) -> None:
        fs, root = file_system(self.path)
        fs.create_dir(os.path.join(root, "commits"), recursive=True)
        lines = [json.dumps({"batch": batchId, "file": m.file, "frames": m.frames}) for m in messages if m is not None and m.file]
        part = os.path.join(root, f".{uuid.uuid4().hex}")
        with fs.open_output_stream(part) as out:
            out.write("".join(x + "\n" for x in lines).encode())
        fs.move(part, os.path.join(root, "commits", f"{batchId:010d}.json"))

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        fs, root = file_system(self.path)
        for m in messages:
            if m is not None and m.file:
                fs.delete_file(os.path.join(root, "data", m.file))


class EventFrames(DataSource):
    """Rows as event frames in a folder, the option `path`."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def streamWriter(self, schema, overwrite: bool) -> FrameWriter:
        return FrameWriter(self.options["path"], schema.names)


def register(spark: SparkSession) -> None:
    reachable(spark)
    spark.dataSource.register(EventFrames)


def committed(spark: SparkSession, path: str) -> DataFrame:
    """batch, file, frames of what was sent."""
    return spark.read.schema("batch long, file string, frames long").json(f"{path}/commits")


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The frames that were sent, each once."""
    rows = spark.read.schema(schema).json(f"{path}/data")
    return rows.select("*", F.col("_metadata.file_name").alias("_file")).join(committed(spark, path).select(F.col("file").alias("_file")), "_file", "left_semi").drop("_file")
