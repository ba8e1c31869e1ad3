"""Report sinks and the reader of their tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def write_ball_table(balls: DataFrame, path: str) -> None:
    """Parquet by split, so that a filter on the split prunes files. A scored table goes to a path of its own."""
    balls.write.mode("overwrite").partitionBy("split").parquet(path)


def write_leaderboard(table: DataFrame, path: str, n: int = 20) -> None:
    """The first ``n`` ranks as one CSV file."""
    table.orderBy("rank").limit(n).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def markdown(table: DataFrame, digits: int = 4) -> str:
    """A small result as a pipe table."""
    rows = table.collect()
    cell = lambda v: f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(table.columns) + " |", "|" + "---|" * len(table.columns)]
    return "\n".join([*lines, *("| " + " | ".join(cell(v) for v in row) + " |" for row in rows)]) + "\n"


def read_markdown_table(spark: SparkSession, path: str, heading: str, columns: int) -> DataFrame:
    """``row, c0, c1, ...``: the first pipe table behind a heading of a report, without its head."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("row", "line"))
    order = Window.orderBy("row")  # one small file
    lines = lines.withColumn("section", F.last(F.when(F.col("line").startswith("#"), F.trim(F.regexp_replace("line", "^#+", ""))), ignorenulls=True).over(order))
    rows = lines.filter((F.col("section") == heading) & F.col("line").startswith("|"))
    rows = rows.withColumn("run", F.col("row") - F.row_number().over(order)).withColumn("first_run", F.min("run").over(Window.partitionBy())).filter("run = first_run")
    body = rows.withColumn("k", F.row_number().over(order)).filter("k > 2")
    cells = F.split(F.regexp_replace("line", r"^\||\|\s*$", ""), r"\|")
    return body.select("row", *(F.trim(F.element_at(cells, i + 1)).alias(f"c{i}") for i in range(columns)))


def block_length(label: str) -> F.Column:
    """The number in labels such as ``block_20``."""
    return F.try_to_number(F.nullif(F.regexp_extract(label, r"block_(\d+)", 1), F.lit("")), F.lit("999999")).cast("int")


def bounds(label: str) -> tuple[F.Column, F.Column]:
    """Both ends of a range written ``a..b``."""
    parts = F.split(label, r"\.\.")
    return parts[0].cast("double"), parts[1].cast("double")
