"""Next-ball outcome distributions: recency weights, hierarchical shrinkage and lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import chase
from ..session import cut

ALPHA = 10.0
ERA_HALF_LIFE = 0.75


def with_recency(train: DataFrame, half_life: float | None, keys: tuple[str, ...] = ()) -> DataFrame:
    """``train`` with a ``weight`` that halves every ``half_life`` seasons back, of mean 1 in each group of ``keys``.

    Ages count from the newest season of the group itself. None gives weights of 1.
    """
    if half_life is None:
        return train.withColumn("weight", F.lit(1.0))
    seasons = train.groupBy(*keys, "season").agg(F.min("date").alias("first_date"), F.count("*").alias("n"))
    newest = Window.partitionBy(*keys).orderBy(F.desc("first_date"), F.desc("season"))
    aged = seasons.withColumn("raw", F.pow(F.lit(0.5), (F.row_number().over(newest) - 1) / F.lit(float(half_life))))
    group = Window.partitionBy(*keys)
    weights = aged.withColumn("weight", F.col("raw") * (F.sum("n").over(group) / F.sum(F.col("raw") * F.col("n")).over(group)))
    return train.join(F.broadcast(weights.select(*keys, "season", "weight")), [*keys, "season"])


def _counts(train: DataFrame, keys: list[str]) -> DataFrame:
    """``counts``: array of the weights of each outcome, in the fixed order."""
    sums = [F.sum(F.when(F.col("outcome") == o, F.col("weight")).otherwise(0.0)) for o in chase.OUTCOMES]
    return train.groupBy(*keys).agg(F.array(*sums).alias("counts")) if keys else train.agg(F.array(*sums).alias("counts"))


def _total(counts: str) -> F.Column:
    return F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)


def _shrunk(counts: str, prior: str, alpha: float) -> F.Column:
    return F.transform(F.arrays_zip(F.col(counts).alias("c"), F.col(prior).alias("p")), lambda x: (x["c"] + F.lit(alpha) * x["p"]) / (_total(counts) + F.lit(alpha)))


def base_distribution(train: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """``base``: outcome shares of all balls with half a ball added to each outcome."""
    floored = _counts(train, list(keys)).withColumn("f", F.transform("counts", lambda x: x + 0.5))
    return floored.select(*keys, F.transform("f", lambda x: x / _total("f")).alias("base"))


def parents(train: DataFrame, base: DataFrame, keys: tuple[str, ...] = (), alpha: float = ALPHA) -> DataFrame:
    """``phase, w, parent``: shares by phase and wickets, drawn towards the base."""
    counts = _counts(train, [*keys, "phase", "w"])
    joined = counts.join(F.broadcast(base), list(keys)) if keys else counts.crossJoin(F.broadcast(base))
    return joined.select(*keys, "phase", "w", _shrunk("counts", "base", alpha).alias("parent"))


def _summed(counts: str, group: Window) -> F.Column:
    """Element-wise sums of ``counts`` over a window of cells."""
    return F.array(*(F.sum(F.col(counts)[k]).over(group) for k in range(len(chase.OUTCOMES))))


def _shrunk_cells(counted: DataFrame, keys: tuple[str, ...], alpha: float) -> DataFrame:
    """Base, parent and cell distributions of rows that hold a cell's ``counts``, 180 a model at most: sums of cells are those of balls."""
    rows = counted.withColumn("parent_counts", _summed("counts", Window.partitionBy(*keys, "phase", "w")))
    rows = rows.withColumn("base_counts", F.transform(_summed("counts", Window.partitionBy(*keys)), lambda x: x + 0.5))
    rows = rows.withColumn("base", F.transform("base_counts", lambda x: x / _total("base_counts")))
    rows = rows.withColumn("parent", _shrunk("parent_counts", "base", alpha))
    return rows.withColumn("cell", _shrunk("counts", "parent", alpha)).drop("parent_counts", "base_counts")


def _cell_counts(train: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return _counts(train.withColumn("rrr_bin", chase.rrr_bin("rrr")), [*keys, "rrr_bin", "w", "phase"])


def cells(train: DataFrame, keys: tuple[str, ...] = (), alpha: float = ALPHA) -> DataFrame:
    """``rrr_bin, w, phase, base, parent, cell`` of each seen cell: its shares drawn towards those of its phase and wickets, and these towards the base.

    The balls are read and aggregated once, by cell.
    """
    return _shrunk_cells(_cell_counts(train, keys), keys, alpha).select(*keys, "rrr_bin", "w", "phase", "base", "parent", "cell")


def full_grid(train: DataFrame, keys: tuple[str, ...] = (), alpha: float = ALPHA) -> DataFrame:
    """``cell_id, rrr_bin, w, phase, p, base``: the distribution of each of the 180 cells; one without balls has its parent's, and without those the base.

    The balls are read and aggregated once, by cell; without any, all distributions are even.
    """
    spark = train.sparkSession
    counted = _cell_counts(train, keys)
    axis = lambda n, start=0: F.explode(F.sequence(F.lit(start), F.lit(start + n - 1)))
    grid = spark.range(1).select(axis(chase.RRR_BINS).alias("rrr_bin")).withColumn("w", axis(chase.WICKETS, 1)).withColumn("phase", F.explode(F.array(*map(F.lit, chase.PHASES))))
    if keys:
        counted = cut(counted)  # small, and read twice
        grid = counted.select(*keys).distinct().crossJoin(F.broadcast(grid))  # 180 rows a model
    none = F.array(*(F.lit(0.0) for _ in chase.OUTCOMES))
    full = grid.join(counted, [*keys, "rrr_bin", "w", "phase"], "left").withColumn("counts", F.coalesce("counts", none))
    rows = _shrunk_cells(full, keys, alpha)
    return cut(rows.select(*keys, chase.cell_id("rrr_bin", "w", chase.phase_index("phase")).alias("cell_id"), "rrr_bin", "w", "phase", F.col("cell").alias("p"), "base"))


def flat_grid(train: DataFrame) -> DataFrame:
    """The grid of a model whose distribution is the base everywhere."""
    return full_grid(train).withColumn("p", F.col("base"))


def with_distribution(balls: DataFrame, grid: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """``balls`` with the distribution ``p`` of their state. The grid has 180 rows a model."""
    coded = balls.withColumn("cell_id", chase.cell_id(chase.rrr_bin("rrr"), "w", chase.phase_index("phase")))
    return coded.join(F.broadcast(grid.select(*keys, "cell_id", "p")), [*keys, "cell_id"])


MODELS = ("base", "rrr")


def grid_of(kind: str, train: DataFrame) -> DataFrame:
    """The grid of a named model: ``base``, one distribution for all states, or ``rrr``, one a cell."""
    if kind not in MODELS:
        raise ValueError(f"unknown model {kind!r}; known: {', '.join(MODELS)}")
    return flat_grid(train) if kind == "base" else full_grid(train)
