"""The folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import SparkSession

_OWN: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir), with its scheme, so that Spark and Python mean the same place.

    Where that is unset, a single local process has a temporary folder of its own, deleted when it ends; on a cluster
    it is an error, as executors do not see the driver's disk.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="termatlas-"))
            atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
        root = f"file://{_OWN[0]}"
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path)
    return found.toString().rstrip("/")


def open_shared(uri: str):
    """(filesystem, path) of a URI in the shared folder, for executors' own file formats."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:"):]
    return fs.FileSystem.from_uri(uri)
