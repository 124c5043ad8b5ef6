"""Pareto frontier of quality against an axis, by windows instead of a join of all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

AXES = {"cost": "mean_cost", "latency": "mean_latency", "tokens": "mean_output_tokens", "throughput": "mean_total_tokens"}
_COVERAGE = {"tokens": "n_token_epochs", "throughput": "n_total_token_epochs"}


def axis_value(axis: str) -> Column:
    """The value on an axis; null when it is NaN, or when tokens were not measured in all epochs."""
    if axis not in AXES:
        raise ValueError(f"axis must be one of {sorted(AXES)}")
    value = F.nanvl(F.col(AXES[axis]), F.lit(None).cast("double"))
    return F.when(F.col(_COVERAGE[axis]) >= F.col("n_epochs"), value) if axis in _COVERAGE else value


def mark_frontier(cells: DataFrame, axis: str = "latency", within: tuple[str, ...] = ("task_id",)) -> DataFrame:
    """Adds ``pareto``: no other cell of the task is at least as good and as cheap, and better in one.

    A cell is on the frontier if it has the best quality up to its x, and the least x of its quality.
    A missing x or quality is never on it and dominates nothing; ties stay together.
    """
    x, q = axis_value(axis), F.nanvl(F.col("mean_value"), F.lit(None).cast("double"))
    marked = cells.withColumn("_x", x).withColumn("_q", F.when(x.isNotNull(), q))
    upto = Window.partitionBy(*within).orderBy(F.col("_x").asc_nulls_last()).rangeBetween(Window.unboundedPreceding, 0)
    same = Window.partitionBy(*within, "_q")
    on = (F.col("_q") == F.max("_q").over(upto)) & (F.col("_x") == F.min("_x").over(same))
    return marked.withColumn("pareto", F.coalesce(on, F.lit(False))).drop("_x", "_q")


def staircase(cells: DataFrame) -> DataFrame:
    """Frontier cells numbered by rising x, for drawing."""
    return cells.filter("pareto").withColumn("step", F.row_number().over(Window.partitionBy("task_id").orderBy("x", "model", "effort", "variant")))


def effort_order(effort: Column, efforts: tuple[str, ...]) -> Column:
    """The key by which drawings order efforts: known ones by their level, others behind them by name."""
    at = F.array_position(F.array(*(F.lit(e) for e in efforts)), effort)
    return F.struct(F.when(at > 0, at).otherwise(len(efforts) + 1).alias("level"), F.when(at > 0, "").otherwise(effort).alias("name"))


def drawing(cells: DataFrame, low: str, high: str) -> DataFrame:
    """Per task whether its x axis is better logarithmic, and per cell the lengths of its error bars, none of them negative."""
    x = F.col("x")
    of_task = Window.partitionBy("task_id")
    log_x = F.coalesce((F.min("x").over(of_task) > 0) & (F.max("x").over(of_task) >= 10 * F.min("x").over(of_task)), F.lit(False))
    bar = lambda length: F.when(length.isNotNull(), F.greatest(F.lit(0.0), length))
    return cells.withColumn("log_x", log_x).withColumn("bar_low", bar(x - F.col(low))).withColumn("bar_high", bar(F.col(high) - x))
