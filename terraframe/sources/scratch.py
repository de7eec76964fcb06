"""The folder for tables that a query writes on its way.

They are below ``spark.checkpoint.dir``, which a cluster shares, in a folder of the
application.  A query's result may read one, so it stays until :func:`clean_up`, which a
long-lived session calls when its results are used; a folder that was made here goes with the process.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; in a local session without one, a folder of its own."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir is unset: set it to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="terraframe-")
        atexit.register(shutil.rmtree, _OWN[app], True)
    return f"file://{_OWN[app]}"


def own_folder(spark: SparkSession) -> str:
    """The application's folder in the shared one."""
    return f"{shared_dir(spark)}/terraframe-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    """A path that nothing has been written to."""
    return f"{own_folder(spark)}/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    """Remove a path of any file system that Spark knows."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def clean_up(spark: SparkSession) -> None:
    """Delete all tables that this application's queries have written; results that read them are gone as well."""
    delete(spark, own_folder(spark))
