"""Sources of raw deliveries: CSV files, and a mapping from an order-line table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_I, _S = T.IntegerType(), T.StringType()
RAW_SCHEMA = T.StructType(
    [
        T.StructField(name, kind)
        for name, kind in (
            ("match_id", T.LongType()), ("seq", _I), ("innings", _I), ("over", _I), ("date", T.DateType()), ("season", _S), ("batting_team", _S), ("bowling_team", _S),
            ("valid_ball", _I), ("runs_total", _I), ("team_runs", _I), ("team_balls", _I), ("team_wicket", _I), ("runs_target", _I), ("match_won_by", _S), ("result_type", _S),
            ("method", _S), ("overs", _I), ("batter_balls", _I), ("batter", _S), ("bowler", _S), ("bat_pos", _I),
        )
    ]
)


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` if it has all ``names``; else an error that lists the missing ones, before anything is planned."""
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


#: Column of the parsed rows that holds a line with a cell of the wrong type or a wrong number of cells; null for sound lines.
REJECTED = "_rejected"


def scan_csv(spark: SparkSession, path: str) -> DataFrame:
    """Raw deliveries with declared types, and ``_rejected``: the whole line where a cell doesn't fit its type or cells are missing or too many.

    Columns are matched by the names in the files' first line, whatever their order; others
    are read as text and dropped, but count as cells. A cell that doesn't fit is null.
    """
    head = spark.read.option("header", True).csv(path).columns
    require_columns(spark.createDataFrame([], ", ".join(f"`{c}` string" for c in head)), [f.name for f in RAW_SCHEMA])
    declared = {f.name: f for f in RAW_SCHEMA}
    schema = T.StructType([declared.get(c, T.StructField(c, _S)) for c in head] + [T.StructField(REJECTED, _S)])
    rows = spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", REJECTED).option("columnPruning", False).csv(path)  # else only the cells asked for are looked at
    return rows.select(*(f.name for f in RAW_SCHEMA), REJECTED)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """The sound rows of ``scan_csv``; ``rejected`` counts the others."""
    return scan_csv(spark, path).filter(F.col(REJECTED).isNull()).drop(REJECTED)


def rejected(scanned: DataFrame) -> DataFrame:
    """One row: all rows of a scan, rejected ones, and how many rejected rows lack a value in each column."""
    bad = F.col(REJECTED).isNotNull()
    lacking = (F.count_if(bad & F.col(f.name).isNull()).alias(f"null_{f.name}") for f in RAW_SCHEMA)
    return scanned.agg(F.count("*").alias("n"), F.count_if(bad).alias("rejected"), *lacking)


#: Rows that a task sorts at once: several sorts of the same rows stand in a task's memory together.
ROWS_A_TASK = 100_000


def _tasks(rows: DataFrame) -> int:
    """Tasks for windows over ``rows``: more for more rows, so that a task's memory doesn't grow."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // ROWS_A_TASK))


def from_order_lines(lineitem: DataFrame) -> DataFrame:
    """Deliveries made of order lines: a supplier's lines in a total order, cut into innings of 150."""
    tasks = _tasks(lineitem)
    lineitem = lineitem.repartition(tasks, "l_suppkey")
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax"]
    rn = F.row_number().over(Window.partitionBy("l_suppkey").orderBy(*order)) - 1
    cut = lineitem.withColumn("rn", rn).withColumn("match_id", F.col("l_suppkey") * 1000 + F.floor(F.col("rn") / 150)).withColumn("seq", (F.col("rn") % 150).cast("int")).repartition(tasks, "match_id")
    game = Window.partitionBy("match_id")
    played = game.orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    quantity = F.col("l_quantity")
    runs = F.when(quantity <= 15, 0).when(quantity <= 34, 1).when(quantity <= 38, 2).when(quantity <= 39, 3).when(quantity <= 45, 4).when(quantity <= 48, 6).otherwise(0)
    rows = cut.withColumn("chunk", F.count("*").over(game)).withColumn("date", F.min("l_shipdate").over(game).cast("date")).filter("chunk = 150")
    rows = rows.withColumn("valid_ball", F.when((F.col("l_tax") >= 0.075) & (F.col("l_discount") >= 0.05), 0).otherwise(1)).withColumn("runs_total", runs).withColumn("wicket", (quantity >= 49).cast("int"))
    rows = rows.withColumns({"team_runs": F.sum("runs_total").over(played), "team_balls": F.sum("valid_ball").over(played), "team_wicket": F.sum("wicket").over(played), "runs_target": 125 + F.col("match_id") * 37 % 90, "player": F.col("l_partkey") % 44})
    rows = rows.withColumn("batter_balls", F.count("*").over(Window.partitionBy("match_id", "player").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    rows = rows.filter("team_balls - valid_ball < 120 and team_wicket - wicket < 10 and team_runs - runs_total < runs_target")
    rows = rows.withColumn("final", F.max("team_runs").over(game))
    m = F.col("match_id")
    team, other = F.concat(F.lit("T"), (m % 8).cast("string")), F.concat(F.lit("T"), ((m + 3) % 8).cast("string"))
    columns = {
        "innings": F.when(m % 29 == 0, 1).otherwise(2), "over": F.floor((F.col("team_balls") - F.col("valid_ball")) / 6), "season": F.year("date").cast("string"), "batting_team": team, "bowling_team": other,
        "match_won_by": F.when(F.col("final") >= F.col("runs_target"), team).otherwise(other), "result_type": F.when(m % 43 == 0, "no result").when(F.col("final") == F.col("runs_target") - 1, "tie"),
        "method": F.when(m % 41 == 0, "D/L"), "overs": F.when(m % 47 == 0, 18).when(m % 53 == 0, None).otherwise(20),
        "batter": F.concat(F.lit("P"), F.col("player").cast("string")), "bowler": F.concat(F.lit("B"), (F.col("l_orderkey") % 30).cast("string")), "bat_pos": 1 + F.col("player") % 11,
    }
    rows = rows.withColumns(columns)
    return rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in RAW_SCHEMA))
