"""The shared folder of a session, and paths in it."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a local one is set only where that is unset and the master is local."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tidemill-")
        atexit.register(shutil.rmtree, path[7:], ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", path)
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tidemill/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def publish(spark: SparkSession, path: str, content: bytes) -> bool:
    """Make a file appear under its name with its whole content, or not at all; False if the name is taken.

    The content is written under another name of the same folder first. On a local disk it then gets its name by
    a hard link, elsewhere by a rename, neither of which replaces a file (as on HDFS; a store whose rename does
    replace files can't keep two writers apart)."""
    jvm = spark._jvm
    final = jvm.org.apache.hadoop.fs.Path(path)
    fs = final.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(final.getParent())
    draft = jvm.org.apache.hadoop.fs.Path(final.getParent(), f".{uuid.uuid4().hex}.draft")
    out = fs.create(draft, False)
    out.write(bytearray(content))
    out.close()
    try:
        if fs.makeQualified(final).toUri().getScheme() == "file":
            try:
                os.link(draft.toUri().getPath(), final.toUri().getPath())
            except FileExistsError:
                return False
            return True
        return not fs.exists(final) and bool(fs.rename(draft, final))
    finally:
        fs.delete(draft, False)
