"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``.

    Where that is unset, a session of one process (``local[..]``, as in tests)
    gets a temporary folder; on a cluster it is an error, since executors would
    not see a folder of the driver.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        context = spark.sparkContext
        if not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors see")
        base = _LOCAL.get(context.applicationId)
        if base is None:
            base = _LOCAL[context.applicationId] = tempfile.mkdtemp(prefix="spark-shared-")
    return base.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` into the shared folder and read it back: its lineage ends there."""
    path = new_path(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._shared_path = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared storage."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def forget(*tables: DataFrame | None) -> None:
    """Remove the files of tables of :func:`materialize` that nothing reads any more."""
    for df in tables:
        path = None if df is None else df.__dict__.pop("_shared_path", None)
        if path:
            remove(df.sparkSession, path)


def open_shared(uri: str, mode: str):
    """Open a file of the shared storage inside a task, as a binary stream.

    Plain paths and ``file:`` are opened directly; other schemes through Arrow's
    file systems.
    """
    parsed = urlparse(uri)
    if parsed.scheme in ("", "file"):
        path = unquote(parsed.path) if parsed.scheme else uri
        if "w" in mode:
            os.makedirs(os.path.dirname(path), exist_ok=True)
        return open(path, mode)
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    if "w" in mode:
        store.create_dir(path.rpartition("/")[0], recursive=True)
        return store.open_output_stream(path)
    return store.open_input_file(path)
