"""A journal folder that holds each batch once, and snapshots that are replaced as a whole.

The journal is a data source of Spark's Python API.  Tasks write their lines to files of their own; the commit of a
batch publishes one small file, named by the writer and the batch, that lists them.  Readers read listed files only:
what a failed task, an aborted batch or a batch that was run again has left behind is not seen.

A snapshot is a new folder for each version; a version's pointer is published last, and never replaced.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..sources import stores

#: Name under which the journal is registered.
FORMAT = "turnstream_journal"
_LISTS = "_batches"


@dataclass
class _Written(WriterCommitMessage):
    file: str | None


class _Writer:
    """What the batch and the streaming writer share; path, writer: the folder and the name of who writes."""

    def __init__(self, path: str, writer: str):
        self.path, self.writer = path, writer

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Written:
        lines = [v for b in batches for v in b.column(0).to_pylist() if v is not None]
        if not lines:
            return _Written(None)
        name = f"lines-{uuid.uuid4().hex}"
        stores.write_file(f"{self.path}/{name}", "".join(f"{x}\n" for x in lines).encode())
        return _Written(name)

    def publish(self, messages: list, batch: str) -> None:
        files = [m.file for m in messages if m is not None and m.file]
        if not stores.publish(f"{self.path}/{_LISTS}/{batch}", json.dumps(files).encode()):
            self.discard(messages)

    def discard(self, messages: list) -> None:
        for m in messages:
            if m is not None and m.file:
                stores.remove(f"{self.path}/{m.file}")


class _BatchWriter(_Writer, DataSourceArrowWriter):
    def commit(self, messages: list) -> None:
        self.publish(messages, self.writer)

    def abort(self, messages: list) -> None:
        self.discard(messages)


class _StreamWriter(_Writer, DataSourceStreamArrowWriter):
    def commit(self, messages: list, batchId: int) -> None:
        self.publish(messages, f"{self.writer}-{batchId:012d}")

    def abort(self, messages: list, batchId: int) -> None:
        self.discard(messages)


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        listed = [f for n in stores.names(f"{self.path}/{_LISTS}") for f in json.loads(stores.read_file(f"{self.path}/{_LISTS}/{n}"))]
        return [InputPartition(f) for f in listed] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.value:
            for line in stores.read_file(f"{self.path}/{partition.value}").decode().split("\n")[:-1]:
                yield (line,)


class Journal(DataSource):
    """Lines (value string) of a folder; options: path (qualified) and, to write, writer."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "value string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _BatchWriter(self.options["path"], self.options["writer"])

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamArrowWriter:
        return _StreamWriter(self.options["path"], self.options["writer"])


def _lines(events: DataFrame) -> DataFrame:
    return events.select(F.to_json(F.struct(*events.columns)).alias("value"))


def append_events(events: DataFrame, path: str, batch: str | None = None) -> None:
    """Add a batch of events to a journal folder, as lines of JSON: all of it or, if it fails, nothing.

    batch: a name of the batch; one that the folder holds already is not added again.
    """
    spark = events.sparkSession
    spark.dataSource.register(Journal)
    _lines(events).write.format(FORMAT).mode("append").option("writer", f"batch-{batch or uuid.uuid4().hex}").save(stores.qualified(spark, path))


def read_events(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The events of all committed batches."""
    spark.dataSource.register(Journal)
    lines = spark.read.format(FORMAT).load(stores.qualified(spark, path))
    return lines.select(F.from_json("value", schema).alias("e")).select("e.*")


def tail(stream: DataFrame, path: str, checkpoint: str):
    """Follow a stream of events into a journal folder.

    Batches are known by the checkpoint and their number: one that a restart runs again is listed once, so no event is
    lost or doubled.  The folder may take several streams, and batches of append_events beside them.
    """
    spark = stream.sparkSession
    spark.dataSource.register(Journal)
    writer = f"stream-{hashlib.sha1(stores.qualified(spark, checkpoint).encode()).hexdigest()[:16]}"
    return _lines(stream).writeStream.format(FORMAT).option("path", stores.qualified(spark, path)).option("writer", writer).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


_VERSIONS = "_versions"


def _versions(spark: SparkSession, path: str) -> list[str]:
    return stores.names(f"{stores.qualified(spark, path)}/{_VERSIONS}")


def write_snapshot(rows: DataFrame, path: str) -> int:
    """Replace a snapshot of JSON rows; its version.

    The rows go to a folder of their own first; only when all are there is the next version's pointer published.  A
    write that fails leaves the version before it, and readers that began with that one go on.  Of two that publish at
    once, each gets a version.  Old folders stay until drop_versions.
    """
    spark = rows.sparkSession
    folder = f"data-{uuid.uuid4().hex}"
    rows.write.json(f"{path}/{folder}")
    where = f"{stores.qualified(spark, path)}/{_VERSIONS}"
    version = max(map(int, _versions(spark, path)), default=0) + 1
    while not stores.publish(f"{where}/{version:012d}", folder.encode()):
        version += 1
    return version


def read_snapshot(spark: SparkSession, path: str, schema: str, version: int | None = None) -> DataFrame:
    """The rows of a version, or of the latest; none if there is none."""
    known = _versions(spark, path)
    name = f"{version:012d}" if version else known[-1] if known else None
    if name is None or name not in known:
        return spark.createDataFrame([], schema)
    folder = stores.read_file(f"{stores.qualified(spark, path)}/{_VERSIONS}/{name}").decode()
    return spark.read.schema(schema).json(f"{path}/{folder}")


def drop_versions(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Delete all but the latest versions and their rows."""
    import pyarrow.fs as pafs

    where = stores.qualified(spark, path)
    for name in _versions(spark, path)[:-keep] if keep else _versions(spark, path):
        folder = stores.read_file(f"{where}/{_VERSIONS}/{name}").decode()
        stores.remove(f"{where}/{_VERSIONS}/{name}")
        store, at = stores.open_store(f"{where}/{folder}")
        if store.get_file_info(at).type == pafs.FileType.Directory:
            store.delete_dir(at)
