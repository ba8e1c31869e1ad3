"""What the operators share: settings, names and small column helpers."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, shared_path

__all__ = ["cut", "free_names", "id_and_text", "setting", "table", "tidied", "written"]


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """``key`` has ``value`` inside the block and its former value, or none, after it."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores before it as tell it from all columns of ``df``, whatever their case."""
    taken = {c.lower() for c in df.columns}
    return ["_" * next(k for k in range(len(taken) + 1) if ("_" * k + n).lower() not in taken) + n for n in names]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame, id_col: str, text_col: str, keep_null: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns an operator reads, as ``doc_id`` and ``text`` (null: empty unless ``keep_null``), then ``kept_*`` ones."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1024")  # texts may be long
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), (text if keep_null else F.coalesce(text, F.lit(""))).alias("text"), *(F.col(f"`{c}`").alias(f"kept_{c}") for c in keep))


def tidied(df: DataFrame) -> DataFrame:
    """``df``, written by ``cut``, with the driver's garbage collected.

    Spark frees shuffle files, broadcasts and what it knows of finished steps only once the
    driver's heap happens to be collected; over many short steps on many partitions the heap
    grows instead.
    """
    df = cut(df)
    df.sparkSession.sparkContext._jvm.System.gc()
    return df


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder, for rows with texts of which later passes read some columns."""
    path = shared_path(df.sparkSession, "written")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)
