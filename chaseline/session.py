"""Session helpers: making the package importable on executors."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = Path(__file__).resolve().parent


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors, once a context, as ``--py-files`` would."""
    context = spark.sparkContext
    if getattr(context, "_chaseline_shipped", False):
        return
    archive = Path(tempfile.mkdtemp(prefix="chaseline-ship-")) / "chaseline_package.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(_PACKAGE.rglob("*.py")):
            out.write(source, source.relative_to(_PACKAGE.parent))
    context.addPyFile(str(archive))
    context._chaseline_shipped = True


def _shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.

    Where that is unset, a temporary folder is set on a local master, as in tests; on any
    other it raises, for executors don't see each other's disks.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and context.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="chaseline-"))
    return context.getCheckpointDir()


def shared_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{_shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder."""
    _shared_folder(df.sparkSession)
    return df.checkpoint()
