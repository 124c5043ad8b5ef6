"""Paired comparison of two variants over the configurations that have both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import ALPHA, EXACT_LIMIT, bootstrap_means, percentile_interval, sign_flip_p
from ..schema import CONFIG
from .dedupe import latest_grade


def config_means(grades: DataFrame, a: str, b: str) -> DataFrame:
    """One row a configuration with the means of both variants (missing values left out) and their unparseable grades."""
    wanted = grades.filter(F.col("variant").isin(a, b))
    of = lambda v, c: F.when(F.col("variant") == v, c)
    bad = (F.col("grade_status") == "unparseable").cast("long")
    return wanted.groupBy(*CONFIG).agg(
        F.avg(of(a, F.col("value"))).alias("mean_a"), F.avg(of(b, F.col("value"))).alias("mean_b"),
        F.coalesce(F.sum(of(a, bad)), F.lit(0)).alias("bad_a"), F.coalesce(F.sum(of(b, bad)), F.lit(0)).alias("bad_b"),
    )


def compare(rows: DataFrame, a: str, b: str, ties: tuple[str, ...] = ()) -> DataFrame:
    """One row a task with a pair: means, mean difference (b - a) with its interval (context only), sign-flip p, whether it is real, and a note."""
    pairs = config_means(latest_grade(rows, ties), a, b).filter("mean_a is not null and mean_b is not null")
    pairs = pairs.withColumn("diff", F.round(F.col("mean_b") - F.col("mean_a"), 12))
    tasks = pairs.groupBy("task_id").agg(
        F.count(F.lit(1)).alias("n_pairs"), F.avg("mean_a").alias("mean_a"), F.avg("mean_b").alias("mean_b"), F.avg("diff").alias("delta"),
        F.count_if(F.col("diff") != 0).alias("n_nonzero"), F.sum(F.col("bad_a") + F.col("bad_b")).alias("n_unparseable"),
        F.transform(F.array_sort(F.collect_list(F.struct("model", "effort", "diff"))), lambda x: x["diff"]).alias("diffs"),
    )
    low, high = percentile_interval(F.col("means"))
    tasks = tasks.withColumn("p_value", sign_flip_p("diffs")).withColumn("means", bootstrap_means("diffs", least=2))
    tasks = tasks.withColumns({"ci_low": low, "ci_high": high}).drop("means")
    return tasks.withColumn("real", F.coalesce(F.col("p_value") <= ALPHA, F.lit(False))).withColumn("note", note())


def ordered(compared: DataFrame) -> DataFrame:
    """The order in which compared tasks are shown."""
    return compared.orderBy("task_id")


#: Least differing pairs with which p can reach ALPHA.
LEAST_PAIRS = 6


def note() -> Column:
    """What limits the verdict of a compared task; where nothing does, the test that gave it."""
    # Wording of the notes.
    n, least_p = F.col("n_nonzero"), F.regexp_replace((2 / F.pow(F.lit(2.0), F.col("n_nonzero"))).cast("string"), r"\.0$", "")
    limits = F.concat_ws(
        "; ",
        F.when(F.col("p_value").isNull(), "all diffs zero — no directional evidence"),
        F.when(F.col("p_value").isNotNull() & (n < LEAST_PAIRS), F.concat(F.lit("n_nonzero="), n.cast("string"), F.lit(f" < {LEAST_PAIRS} — p cannot reach {ALPHA:g} (min p = "), least_p, F.lit(")"))),
        F.when(F.col("ci_low") == F.col("ci_high"), "CI degenerate (all diffs identical)"),
    )
    return F.when(limits != "", limits).when(n > EXACT_LIMIT, "sampled sign-flip test").otherwise("exact sign-flip test")
