"""Files in whatever store a path names, on the driver and in tasks."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme and host that Spark itself would use for it; resolved on the driver, so that tasks need no Hadoop settings."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()


def shared(spark: SparkSession) -> str | None:
    """spark.checkpoint.dir, which driver and executors share."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share; where all is one process it may be unset."""
    base = shared(spark) or spark.conf.get("turnstream.work.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="turnstream-")
        spark.conf.set("turnstream.work.dir", base)
    return f"{qualified(spark, base).rstrip('/')}/turnstream/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder once for all that read it; where spark.checkpoint.dir is unset, df itself."""
    spark = df.sparkSession
    if not shared(spark):
        return df
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def open_store(path: str):
    """(file system, path) of a qualified path."""
    import pyarrow.fs as pafs

    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(path)


def read_file(path: str) -> bytes:
    store, where = open_store(path)
    with store.open_input_stream(where, compression=None) as f:
        return f.read()


def write_file(path: str, body: bytes) -> None:
    store, where = open_store(path)
    store.create_dir(os.path.dirname(where), recursive=True)
    with store.open_output_stream(where, compression=None) as f:
        f.write(body)


def publish(path: str, body: bytes) -> bool:
    """Write a file that is whole as soon as it is seen, unless there is one already; whether it was written.

    Of writers at once one succeeds where the store can link (a local disk) or refuses to move onto a file (HDFS); an object
    store has neither, so there a path should have one writer at a time.
    """
    folder, _, name = path.rpartition("/")
    if name in names(folder, name):
        return False
    part = f"{folder}/.{uuid.uuid4().hex}"
    write_file(part, body)
    store, where = open_store(path)
    if not path.startswith("file:"):
        store.move(open_store(part)[1], where)
        return True
    try:
        os.link(open_store(part)[1], where)
        return True
    except FileExistsError:
        return False
    finally:
        remove(part)


def names(folder: str, prefix: str = "") -> list[str]:
    """Names of the files of a folder that begin with prefix, in order; hidden ones are left out."""
    import pyarrow.fs as pafs

    store, where = open_store(folder)
    found = (f.base_name for f in store.get_file_info(pafs.FileSelector(where, allow_not_found=True)) if f.type == pafs.FileType.File)
    return sorted(n for n in found if n.startswith(prefix) and not n.startswith("."))


def remove(path: str) -> None:
    store, where = open_store(path)
    store.delete_file(where)
