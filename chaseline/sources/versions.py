"""A table in versions: each write goes to a folder of its own, and a pointer, moved last, names the one that readers get.

A write that fails or is cut off leaves the pointer, and so the table, as it was. Files are
reached through Hadoop's file systems, so any store that Spark writes to will do.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

POINTER = "CURRENT"


def _store(spark: SparkSession, root: str):
    """(file system of ``root``, a maker of its paths)."""
    jvm = spark._jvm
    path = lambda name="": jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{name}" if name else root)
    return path().getFileSystem(spark._jsc.hadoopConfiguration()), path


def current_version(spark: SparkSession, root: str) -> str | None:
    """Name of the version that readers get; None if nothing was published yet."""
    files, path = _store(spark, root)
    if not files.exists(path(POINTER)):
        return None
    return spark.read.text(f"{root.rstrip('/')}/{POINTER}", wholetext=True).first()[0].strip()


def _publish(spark: SparkSession, root: str, version: str) -> None:
    """Puts a new pointer in the old one's place by a rename, which readers see at once or not at all."""
    files, path = _store(spark, root)
    fresh = path(f"_{POINTER}-{uuid.uuid4().hex}")
    out = files.create(fresh, True)
    out.write(bytearray(version.encode()))
    out.close()
    jvm = spark._jvm
    overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.makeQualified(path()).toUri(), spark._jsc.hadoopConfiguration())
    context.rename(files.makeQualified(fresh), files.makeQualified(path(POINTER)), overwrite)


def write_version(df: DataFrame, root: str, partition_by: tuple[str, ...] = ()) -> str:
    """Writes ``df`` as Parquet to the next version's folder and then publishes it; returns its name.

    The folder's name has a number, for order, and a random part, so two writers at once don't
    mix; the last to publish wins.
    """
    spark = df.sparkSession
    last = current_version(spark, root)
    number = 1 + (int(re.match(r"v(\d+)", last)[1]) if last else 0)
    version = f"v{number:06d}-{uuid.uuid4().hex[:8]}"
    df.write.partitionBy(*partition_by).parquet(f"{root.rstrip('/')}/{version}")
    _publish(spark, root, version)
    return version


def read_version(spark: SparkSession, root: str, version: str | None = None) -> DataFrame:
    """The published version, or the named one. Raises if there is none."""
    version = version or current_version(spark, root)
    if version is None:
        raise FileNotFoundError(f"no version of {root} is published")
    return spark.read.parquet(f"{root.rstrip('/')}/{version}")


def append_columns(spark: SparkSession, root: str, extend: Callable[[DataFrame], DataFrame], partition_by: tuple[str, ...] = ()) -> str:
    """Publishes a version whose rows are ``extend`` of the current ones, which must keep all of their columns."""
    now = read_version(spark, root)
    wider = extend(now)
    lost = sorted(set(now.columns) - set(wider.columns))
    if lost:
        raise ValueError(f"columns would be lost: {', '.join(lost)}")
    return write_version(wider, root, partition_by)
