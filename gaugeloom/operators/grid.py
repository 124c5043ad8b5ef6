"""Grids of runs: expansion with pruning, and what is left to do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import variant_parts
from ..schema import LEDGER_KEY, RUN_KEY
from .dedupe import latest_ok

#: Model families whose effort setting changes nothing; whole words, any case.
INERT_FAMILIES = ("haiku",)


def inert(model: Column, families: tuple[str, ...] = INERT_FAMILIES) -> Column:
    return model.rlike(r"(?i)\b(" + "|".join(families) + r")\b")


def _listed(axis: DataFrame, *columns: str) -> Column:
    """All rows of an axis of a grid, which is as short as a person writes it, as one array value, in the order of the first column."""
    return axis.agg(F.array_sort(F.collect_list(F.struct(*columns)))).scalar()


def expand(tasks: DataFrame, models: DataFrame, efforts: DataFrame, variants: DataFrame, epochs: int, support: DataFrame | None = None, families: tuple[str, ...] = INERT_FAMILIES) -> DataFrame:
    """Cells of a grid with their place in it (pos).

    ``tasks`` (task_id, repo, task_pos), ``models`` (model, model_pos), ``efforts`` (effort, effort_pos),
    ``variants`` (variant, variant_pos); ``support`` (model, effort) lists what a model permits, and a model
    without rows permits all. An inert model keeps its first permitted effort only. The short axes are single array values
    that each task unfolds after they are pruned, so nothing is joined but what a model permits.
    """
    if epochs < 1:
        raise ValueError("epochs must be at least 1")
    permitted = _listed(efforts, "effort_pos", "effort")
    pairs = models.withColumn("efforts", permitted)
    if support is not None:
        listed = support.groupBy("model").agg(F.collect_set("effort").alias("permits"))
        pairs = pairs.join(listed, "model", "left")
        pairs = pairs.withColumn("efforts", F.filter("efforts", lambda e: F.col("permits").isNull() | F.array_contains("permits", e["effort"])))
    pairs = pairs.withColumn("efforts", F.when(inert(F.col("model"), families), F.slice("efforts", 1, 1)).otherwise(F.col("efforts")))
    pairs = pairs.select("model_pos", "model", F.explode("efforts").alias("e")).select("model_pos", F.col("e.effort_pos").alias("effort_pos"), "model", F.col("e.effort").alias("effort"))
    repo, _ = variant_parts(F.col("variant"))
    usable = variants.withColumn("variant_repo", repo).filter((F.col("variant") == "none") | F.col("variant_repo").isNotNull())
    cells = tasks.withColumn("v", F.explode(_listed(usable, "variant_pos", "variant", "variant_repo")))
    fits = F.when(F.col("repo").isNull(), F.col("v.variant") == "none").otherwise(F.col("v.variant_repo").eqNullSafe(F.col("repo")))
    cells = cells.filter(fits).withColumn("p", F.explode(_listed(pairs, "model_pos", "effort_pos", "model", "effort")))
    cells = cells.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(epochs - 1).cast("long"))))
    pos = F.array("task_pos", "v.variant_pos", "p.model_pos", "p.effort_pos", F.col("epoch").cast("int"))
    return cells.select("task_id", F.col("p.model").alias("model"), F.col("p.effort").alias("effort"), F.col("v.variant").alias("variant"), "epoch", pos.alias("pos"))


def resume(cells: DataFrame, ledger: DataFrame, sequence: str = "seq") -> DataFrame:
    """Adds ``action``: skip (settled under this grader version and spec), regrade (run, but not so graded) or run.

    ``cells`` has the run key, grader_version and spec_sha. The ledger is read once: the last row of each version of a run
    gives the grades, and the last of these the run.
    """
    narrow = ledger.select(*LEDGER_KEY, "run_status", "spec_sha", "grade_status", F.col(sequence).alias("seq"))
    by_grade = latest_ok(narrow.withColumn("at", F.col("seq")), LEDGER_KEY, "seq")
    by_run = by_grade.groupBy(*RUN_KEY).agg(F.max_by("spec_sha", "at").alias("run_spec"), F.collect_list(F.struct("grader_version", "spec_sha", "grade_status")).alias("grades"))
    joined = cells.join(by_run, list(RUN_KEY), "left")
    settled = F.exists("grades", lambda g: g["grader_version"].eqNullSafe(F.col("grader_version")) & (g["spec_sha"] == F.col("spec_sha")) & (g["grade_status"] != "grader_error"))
    action = F.when(F.coalesce(settled, F.lit(False)), "skip").when(F.coalesce(F.col("run_spec") == F.col("spec_sha"), F.lit(False)), "regrade").otherwise("run")
    return joined.withColumn("action", action).drop("run_spec", "grades")


def plan_sizes(cells: DataFrame) -> DataFrame:
    """Cells of a dry run by (task, model, effort, variant)."""
    return cells.groupBy("task_id", "model", "effort", "variant").agg(F.count(F.lit(1)).alias("n_cells"))
