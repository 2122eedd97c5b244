"""Parameter sweeps: config grids, resuming by row, logs whose columns evolve."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def config_grid(spark: SparkSession, options: dict[str, list]) -> DataFrame:
    """A row for each combination; values are exploded beside one another."""
    grid = spark.range(1).drop("id")
    for name, values in options.items():
        grid = grid.select("*", F.explode(F.array(*map(F.lit, values))).alias(name))
    return grid


def pending(grid: DataFrame, log: DataFrame) -> DataFrame:
    """Configs that no row of the log equals in the columns both have; nulls are equal."""
    shared = [c for c in grid.columns if c in log.columns]
    done = log.select(*shared).distinct()
    return grid.join(done, reduce(lambda a, b: a & b, [grid[c].eqNullSafe(done[c]) for c in shared]), "left_anti") if shared else grid


def append(log: DataFrame, rows: DataFrame) -> DataFrame:
    """Both, with the columns of either; what a side lacks is null. New columns stand
    behind the ones that come before them in ``rows``."""
    order = list(log.columns)
    for i, c in enumerate(rows.columns):
        if c not in order:
            before = next((x for x in reversed(rows.columns[:i]) if x in order), None)
            order.insert(order.index(before) + 1 if before else 0, c)
    return log.unionByName(rows, allowMissingColumns=True).select(*order)


def summarise(log: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    return log.groupBy(*by).agg(*[f(v).alias(f"{n}_{v}") for v in values for n, f in (("mean", F.avg), ("max", F.max))])
