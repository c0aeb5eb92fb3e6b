"""Folders that the driver and the executors share, for tables written and read back."""

from __future__ import annotations

import os
import sys
import tempfile
import uuid
import zipfile

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the session's ``spark.checkpoint.dir``. Only with a local master, where it is
    unset, a temporary folder takes its place; on a cluster that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not jdir.isDefined():
            master = spark.sparkContext.master
            if master != "local" and not master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-ckpt-"))
            jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = jdir.get()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, so that later steps do not compute it again."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def opened(spark: SparkSession, root: str) -> tuple[fs.FileSystem | None, str, str]:
    """How tasks open ``root`` without Spark: the file system (None: only Hadoop can), the path in it, and what such paths lack to be whole ones."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(root)
    uri = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(hadoop).toString()
    if uri.startswith("file:"):
        path = "/" + uri[len("file:"):].lstrip("/")
        return fs.LocalFileSystem(), path, "file:"
    try:
        store, path = fs.FileSystem.from_uri(uri)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError):
        return None, root, ""
    return store, path, uri.removesuffix(path)


def ship(spark: SparkSession) -> None:
    """Sends this package, and the module beside it, to Python workers that would not find it.

    Workers find what lies in their PYTHONPATH or in the folder they start in; in any other case the
    sources go along as a zip file, once per session.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    context = spark.sparkContext
    if getattr(context, "_rl_shipped", False) or root in os.environ.get("PYTHONPATH", "").split(os.pathsep) or os.getcwd() == root:
        return
    name = os.path.join(tempfile.mkdtemp(prefix="rasterloom-"), "rasterloom.zip")
    package = os.path.basename(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    with zipfile.ZipFile(name, "w") as z:
        for folder, _, files in os.walk(os.path.join(root, package)):
            for f in files:
                if f.endswith(".py"):
                    z.write(os.path.join(folder, f), os.path.relpath(os.path.join(folder, f), root))
        for f in os.listdir(root):
            if f.endswith(".py") and not f.startswith("_"):
                z.write(os.path.join(root, f), f)
    before = list(sys.path)
    context.addPyFile(name)
    # The driver keeps to its own sources.
    sys.path[:] = before
    context._rl_shipped = True
