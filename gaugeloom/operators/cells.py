"""Cells: aggregates of the latest grades by (task, model, effort, variant)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import CELL, DEFINITIVE, TOKENS
from .dedupe import marked_runs
from .intervals import BUCKETS, RESAMPLES, bootstrap_intervals, bucket_of, interval_of

LEAKAGE_BAND = 0.05
#: Names of the intervals, with what they are of.
MEASURES = {"value": "value", "cost": "cost_usd", "latency": "latency_s", "output_tokens": "output_tokens", "total_tokens": "total_tokens"}


def strict_mean(c: str) -> Column:
    """Mean that is NaN as soon as a value is missing."""
    return F.when(F.count(c) < F.count(F.lit(1)), F.lit(float("nan"))).otherwise(F.avg(c))


def distinct_with_null(c: str) -> Column:
    """Number of distinct values, null counted as one; there are few, so they are gathered rather than repeated for a distinct aggregate."""
    return (F.size(F.collect_set(c)) + F.max(F.col(c).isNull().cast("int"))).cast("long")


def dropped_runs(rows: DataFrame) -> DataFrame:
    """n_dropped by cell: distinct runs that did not succeed."""
    return rows.filter(F.col("run_status") != "ok").groupBy(*CELL).agg(F.count_distinct("run_id").alias("n_dropped"))


def fully_dropped(rows: DataFrame, grades: DataFrame) -> DataFrame:
    """Cells with dropped runs only."""
    return dropped_runs(rows).join(grades.select(*CELL).distinct(), list(CELL), "left_anti")


def _derived(grades: DataFrame) -> DataFrame:
    rows = grades.withColumn("total_tokens", sum((F.col(t) for t in TOKENS[1:]), F.col(TOKENS[0])))
    return rows.withColumn("shuffled", F.get_json_object("subscores", "$.shuffled_auroc").try_cast("double"))


def aggregate(grades: DataFrame) -> DataFrame:
    """One row a cell: means, spread, coverage of tokens, versions and the leakage flag."""
    return _derived(grades).groupBy(*CELL).agg(
        F.count(F.lit(1)).alias("n_epochs"), strict_mean("value").alias("mean_value"), F.stddev_samp("value").alias("std_value"), strict_mean("cost_usd").alias("mean_cost"), strict_mean("latency_s").alias("mean_latency"),
        distinct_with_null("spec_sha").alias("n_spec"), distinct_with_null("grader_version").alias("n_grader_versions"), F.count_if(F.col("grade_status") == "unparseable").alias("n_unparseable"),
        F.avg("output_tokens").alias("mean_output_tokens"), F.count("output_tokens").alias("n_token_epochs"), F.avg("total_tokens").alias("mean_total_tokens"), F.count("total_tokens").alias("n_total_token_epochs"),
        F.avg("shuffled").alias("mean_shuffled_auroc"), F.coalesce(F.max(F.abs(F.col("shuffled") - 0.5)) > LEAKAGE_BAND, F.lit(False)).alias("leakage"),
    )


def intervals(grades: DataFrame, resamples: int = RESAMPLES) -> DataFrame:
    """CELL with the bootstrap intervals of all MEASURES, of cells of any size; a measure with fewer than three values has none."""
    return bootstrap_intervals(_derived(grades), CELL, "run_id", MEASURES, resamples=resamples)


def _partial() -> list[Column]:
    """What is kept of the rows of a cell that are in one bucket; what isn't ``chosen`` is null but for ``drop``. Bucket -1 keeps nothing but its versions."""
    real = F.col("bucket") >= 0
    of = lambda c: F.when(real, F.col(c))
    kept = [F.count_if(real & F.col("chosen")).alias("n"), F.count_if(real & F.col("drop")).alias("dropped"), F.count_if(real & F.col("unparseable")).alias("bad")]
    for name, c in MEASURES.items():
        kept += [F.sum(of(c).cast("double")).alias(f"s_{name}"), F.count(of(c)).alias(f"k_{name}")]
    return [*kept, F.var_pop(of("value")).alias("var"), F.sum(of("shuffled")).alias("s_shuffled"), F.count(of("shuffled")).alias("k_shuffled"), F.max(F.abs(of("shuffled") - 0.5)).alias("off")]


def _stats() -> list[Column]:
    """What a cell's buckets add up to, and as ``parts`` their sums."""
    n = F.sum("n")
    mean = lambda m: F.try_divide(F.sum(f"s_{m}"), F.sum(f"k_{m}").cast("double"))
    strict = lambda m: F.when(F.sum(f"k_{m}") < n, F.lit(float("nan"))).otherwise(mean(m))
    real = F.col("bucket") >= 0
    sized = F.filter(F.collect_list(F.struct(F.col("k_value").alias("k"), F.col("s_value").alias("s"), F.col("var"))), lambda x: x["k"] > 0)
    about = F.aggregate(sized, F.lit(0.0), lambda a, x: a + x["k"] * (x["var"] + F.pow(x["s"] / x["k"] - mean("value"), F.lit(2))))
    n_of = lambda c: (F.size(F.collect_set(c)) + F.max((~real & F.col(c).isNull()).cast("int"))).cast("long")
    return [
        n.alias("n_epochs"), strict("value").alias("mean_value"), F.when(F.sum("k_value") > 1, F.sqrt(about / (F.sum("k_value") - 1))).alias("std_value"), strict("cost").alias("mean_cost"), strict("latency").alias("mean_latency"),
        n_of("spec_sha").alias("n_spec"), n_of("grader_version").alias("n_grader_versions"), F.sum("bad").alias("n_unparseable"), mean("output_tokens").alias("mean_output_tokens"), F.sum("k_output_tokens").alias("n_token_epochs"),
        mean("total_tokens").alias("mean_total_tokens"), F.sum("k_total_tokens").alias("n_total_token_epochs"), F.try_divide(F.sum("s_shuffled"), F.sum("k_shuffled").cast("double")).alias("mean_shuffled_auroc"),
        F.coalesce(F.max("off") > LEAKAGE_BAND, F.lit(False)).alias("leakage"), F.sum("dropped").alias("n_dropped"),
        F.collect_list(F.when(real, F.struct("bucket", *(F.col(f"{kind}_{m}") for m in MEASURES for kind in "sk")))).alias("parts"),
    ]


def report(rows: DataFrame, ties: tuple[str, ...] = (), axis: str = "latency", resamples: int = RESAMPLES, buckets: int = BUCKETS) -> DataFrame:
    """The cells of a ledger with dropped runs, the Pareto mark on one axis and the bootstrap intervals of all measures.

    The ledger is scanned and dealt by run once. Its rows are summed by cell and bucket (see ``intervals``), and all that follows,
    the resamples too, works on those sums, at most ``buckets`` a cell.
    """
    from .frontier import mark_frontier

    # what is derived of a row is derived before it is moved, and a row that can't be chosen takes no measures along; ties are told by the values as they were
    tied = {f"_tie{i}": F.col(c) for i, c in enumerate(ties)}
    measured = ("value", "cost_usd", "latency_s", "output_tokens", "total_tokens", "shuffled", "spec_sha", "unparseable")
    eligible = (F.col("run_status") == "ok") & F.col("grade_status").isin(*DEFINITIVE)
    light = _derived(rows.withColumns(tied)).withColumn("unparseable", F.col("grade_status") == "unparseable").withColumns({c: F.when(eligible, F.col(c)) for c in measured})
    masked = marked_runs(light, CELL, tuple(tied)).withColumns({c: F.when(F.col("chosen"), F.col(c)) for c in measured})
    # each row counts in its bucket, and once more for its versions, of which there are few
    none = F.lit(None).cast("string")
    versions = ("spec_sha", "grader_version")
    twice = F.array(F.struct(bucket_of(F.col("run_id"), buckets).alias("bucket"), *(none.alias(c) for c in versions)), F.when(F.col("chosen"), F.struct(F.lit(-1).alias("bucket"), *versions)))
    dealt = masked.withColumn("key", F.explode(twice)).filter("key is not null").drop(*versions).select("*", "key.*")
    sums = dealt.groupBy(*CELL, "bucket", *versions).agg(*_partial())
    # a cell's sums meet in one task, at most ``buckets`` of them and one for each pair of versions, and stay there
    met = sums.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *CELL).groupBy(*CELL).agg(*_stats()).filter("n_epochs > 0")
    stats = [c for c in met.columns if c not in ("parts", *CELL)]
    found = met.withColumn("i", interval_of("parts", tuple(MEASURES), buckets, resamples))
    cells = found.select(*CELL, *(c for c in stats if c != "n_dropped"), "i.*", "n_dropped")
    return mark_frontier(cells, axis)


def ordered(cells: DataFrame) -> DataFrame:
    """The order in which cells are shown."""
    return cells.orderBy("task_id", F.col("mean_value").desc_nulls_last(), "model", "effort", "variant")


def suspect() -> Column:
    return F.col("leakage") | (F.col("n_spec") > 1) | (F.col("n_grader_versions") > 1) | (F.col("n_unparseable") > 0)
