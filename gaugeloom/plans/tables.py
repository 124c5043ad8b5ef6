"""Small results as text: cells, reports, comparisons, advice and estimates, each number in the form it is shown in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def number(value: Column, digits: int = 3, prefix: str = "", suffix: str = "") -> Column:
    """A number with some digits; a dash for null and NaN, which are not measured."""
    measured = value.isNotNull() & ~F.isnan(value)
    return F.when(measured, F.concat(F.lit(prefix), F.format_string(f"%.{digits}f", value.cast("double")), F.lit(suffix))).otherwise("-")


def interval(low: Column, high: Column, digits: int = 3) -> Column:
    return F.when(low.isNotNull(), F.concat(F.lit("["), number(low, digits), F.lit(", "), number(high, digits), F.lit("]"))).otherwise("")


def report_table(cells: DataFrame) -> DataFrame:
    """The report as it is shown: a mark for the frontier, warnings for what makes a number doubtful."""
    flags = F.concat_ws(
        ",", F.when(F.col("leakage"), "leak"), F.when(F.col("n_spec") > 1, "specs"), F.when(F.col("n_grader_versions") > 1, "graders"),
        F.when(F.col("n_unparseable") > 0, F.concat(F.lit("unparseable="), F.col("n_unparseable").cast("string"))), F.when(F.col("n_dropped") > 0, F.concat(F.lit("dropped="), F.col("n_dropped").cast("string"))),
    )
    return cells.select(
        "task_id", F.concat_ws("/", "model", "effort").alias("config"), "variant", F.col("n_epochs").cast("string").alias("n"), number(F.col("mean_value")).alias("value"), interval(F.col("value_low"), F.col("value_high")).alias("ci"),
        number(F.col("mean_cost"), 4, "$").alias("cost"), number(F.col("mean_latency"), 1, suffix="s").alias("latency"), F.when(F.col("pareto"), "*").otherwise("").alias("front"), flags.alias("flags"),
    )


def compare_table(compared: DataFrame) -> DataFrame:
    return compared.select(
        "task_id", F.col("n_pairs").cast("string").alias("pairs"), number(F.col("mean_a")).alias("a"), number(F.col("mean_b")).alias("b"), number(F.col("delta")).alias("delta"), interval(F.col("ci_low"), F.col("ci_high")).alias("ci"),
        number(F.col("p_value"), 4).alias("p"), F.when(F.col("real"), "yes").otherwise("no").alias("real"), "note",
    )


def advice_table(advice: DataFrame) -> DataFrame:
    config = lambda a: F.concat_ws("/", f"{a}_model", f"{a}_effort")
    return advice.select(
        "task_id", "variant", F.concat(config("reflex"), F.when(F.col("fallback"), " (fallback)").otherwise("")).alias("reflex"), config("rec").alias("recommended"), number(F.col("rec_value")).alias("value"),
        number(F.col("save_latency"), 1, suffix="s").alias("latency"), number(F.col("save_cost"), 4, "$").alias("cost"), number(F.col("save_tokens"), 0).alias("tokens"), "note",
    )


def estimate_table(projected: DataFrame) -> DataFrame:
    return projected.select(F.col("n_cells").cast("string").alias("cells"), number(F.col("cost_usd"), 2, "$").alias("cost"), number(F.col("latency_s") / 60, 1, suffix=" min").alias("time"), F.coalesce(F.col("tokens").cast("string"), F.lit("-")).alias("tokens"))


def shown(table: DataFrame, rows: int = 200) -> str:
    """The text of a table of few rows, with columns as wide as they need."""
    found = [[str(x) for x in r] for r in table.limit(rows).collect()]
    width = [max(len(c), *(len(r[i]) for r in found), 0) if found else len(c) for i, c in enumerate(table.columns)]
    line = lambda cells: "  ".join(x.ljust(w) for x, w in zip(cells, width)).rstrip()
    return "\n".join([line(table.columns), line(["-" * w for w in width]), *map(line, found)])
