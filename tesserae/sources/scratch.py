"""Intermediate tables in the folder that the driver and all executors share.

The folder is the one the session names in ``spark.checkpoint.dir``.  A table written
there is re-read from shared storage, so losing an executor loses nothing.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"
#: Rows of a file, where a bound on the rows is known.
FILE_ROWS = 100_000
_own: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder; only a local session without one gets a folder of its own."""
    named = spark.conf.get(_KEY, None) or spark.sparkContext.getConf().get(_KEY)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
        raise ValueError(f"set {_KEY} to a folder that the driver and all executors share")
    if "dir" not in _own:
        _own["dir"] = tempfile.mkdtemp(prefix="tesserae-")
        atexit.register(shutil.rmtree, _own["dir"], ignore_errors=True)
    return "file://" + _own["dir"]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, removed when the driver's JVM ends."""
    path = f"{scratch_root(spark)}/tesserae-{uuid.uuid4().hex}/{name}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    return path


def materialize(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and return the table read back.

    This cuts lineage as ``checkpoint()`` does, but keeps columnar pruning and pushdown.  With
    ``rows``, a bound on how many narrow rows there are, it takes no more files than these need.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    if rows is not None:
        df = df.coalesce(rows // FILE_ROWS + 1)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
