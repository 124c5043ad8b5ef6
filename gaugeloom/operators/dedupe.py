"""Latest rows by key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schema import DEFINITIVE


def latest_grade(rows: DataFrame, ties: tuple[str, ...] = ()) -> DataFrame:
    """The newest grade of each successful run, if it is definitive.

    The status of the grade is tested after the choice, so a newer grader error evicts an older grade.
    Equal times and versions fall back on ``ties``, descending.
    """
    order = [F.col("ts").desc_nulls_last(), F.col("grader_version").desc_nulls_last(), *(F.col(c).desc_nulls_last() for c in ties)]
    newest = Window.partitionBy("run_id").orderBy(*order)
    ranked = rows.filter(F.col("run_status") == "ok").withColumn("rn", F.row_number().over(newest))
    return ranked.filter((F.col("rn") == 1) & F.col("grade_status").isin(*DEFINITIVE)).drop("rn")


def marked_runs(rows: DataFrame, cell: tuple[str, ...], ties: tuple[str, ...] = ()) -> DataFrame:
    """All rows with two marks: ``chosen``, the definitive newest grade of its successful run (as ``latest_grade``), and ``drop``, one row of a run that failed in a cell.

    Both windows take the rows as one exchange by run has dealt them. What they ask of the statuses goes along as two booleans, so the texts are moved only if they are read later.
    """
    ran, definite = F.col("_ran"), F.col("_definite")
    order = [ran.desc_nulls_last(), F.col("ts").desc_nulls_last(), F.col("grader_version").desc_nulls_last(), *(F.col(c).desc_nulls_last() for c in ties)]
    failed = F.coalesce(~ran, F.lit(False))
    marked = rows.withColumns({"_ran": F.col("run_status") == "ok", "_definite": F.col("grade_status").isin(*DEFINITIVE)})
    marked = marked.withColumn("rn", F.row_number().over(Window.partitionBy("run_id").orderBy(*order)))
    marked = marked.withColumn("dn", F.row_number().over(Window.partitionBy("run_id", *cell, failed).orderBy(F.col("ts"))))
    chosen = (F.col("rn") == 1) & ran & definite
    return marked.withColumn("chosen", F.coalesce(chosen, F.lit(False))).withColumn("drop", failed & (F.col("dn") == 1)).drop("rn", "dn", "_ran", "_definite")


def latest_ok(rows: DataFrame, key: tuple[str, ...], sequence: str = "seq") -> DataFrame:
    """The last successful row of each key in the order of ``sequence``, by an aggregate with partial sums."""
    ok = rows.filter(F.col("run_status") == "ok")
    rest = [c for c in rows.columns if c not in key]
    return ok.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col(sequence)).alias("r")).select(*key, "r.*")


def duplicates(rows: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Keys that occur more than once, with how often."""
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
