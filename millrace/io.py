"""Reading tables, cutting lineage, and broadcasting behind a size check."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
import warnings
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own_dirs: dict[str, str] = {}
_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the engine's Parquet tables (a file or a directory)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Only a local master may do without it; then a temporary folder is set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    if not re.match(r"local($|\[)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="millrace-")
        spark.sparkContext.setCheckpointDir(_own_dirs[app])
    return _own_dirs[app]


@contextlib.contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """What is written within leaves no shuffle files behind."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)


def cut(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """``df`` written to a table in the shared folder and read back: lineage ends here.

    The table survives the loss of executors and is removed when the session's process ends.  The shuffle files of the write
    are removed with its end, not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    with tidy(spark):
        writer.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared folder, for tables that several steps share; removed as those of :func:`cut` are."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release() -> None:
    """Delete the tables written by :func:`cut` and :func:`scratch`; call it once results are stored.

    What cannot be deleted is told and does not keep the rest from being deleted; tables of ended sessions are passed over.
    """
    while _written:
        spark, path = _written.pop()
        if spark.sparkContext._jsc is None or spark.sparkContext._jsc.sc().isStopped():
            continue
        try:
            delete(spark, path)
        except Exception as e:  # noqa: BLE001 - the gateway may be going down
            warnings.warn(f"could not delete {path}: {type(e).__name__}", stacklevel=2)


atexit.register(release)


def bounded(df: DataFrame, max_rows: int) -> tuple[DataFrame, bool]:
    """``df`` with a broadcast hint if it has at most ``max_rows`` rows, else unchanged.

    The rows are counted up to the bound only; beyond it the join stays a shuffle join.
    """
    fits = df.limit(max_rows + 1).count() <= max_rows
    return (F.broadcast(df) if fits else df), fits
