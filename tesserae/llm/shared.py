"""The folder that driver and executors share, and files written in it from tasks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Where it is unset, a temporary folder becomes it, but only if all runs on this machine."""
    found, context = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    if found:
        if context.getCheckpointDir() is None:  # set after the context was made
            context.setCheckpointDir(found)
        return found.rstrip("/")
    if (own := context.getCheckpointDir()) is not None:
        return own.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = f"file://{tempfile.mkdtemp(prefix='tesserae-')}"
    context.setCheckpointDir(own)
    return own


def new_folder(spark: SparkSession, name: str) -> str:
    """URI of a folder of its own for one run of an operator, in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def filesystem(uri: str):
    """The pyarrow file system of a URI (local paths, hdfs, s3, gs) and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def remove(uri: str) -> None:
    """Delete a folder of ``new_folder`` and all in it, once nothing reads it any more."""
    fs, path = filesystem(uri)
    fs.delete_dir(path)


class Replacing:
    """A file that appears under its name only when it is whole, so that a repeated task attempt replaces it."""

    def __init__(self, uri: str):
        self.fs, self.path = filesystem(uri)
        self.tmp = f"{self.path}.{uuid.uuid4().hex}.tmp"

    def __enter__(self):
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.out = self.fs.open_output_stream(self.tmp)
        return self.out

    def __exit__(self, failed, *_):
        self.out.close()
        if failed:
            self.fs.delete_file(self.tmp)
        else:
            self.fs.move(self.tmp, self.path)


def checkpointed(df):
    """The rows, written to the shared folder; its lineage ends there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
