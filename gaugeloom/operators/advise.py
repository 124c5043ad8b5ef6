"""Advice: the best cell on an axis among those not worse than the best by more than a margin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schema import EFFORTS, GROUP
from .cells import suspect
from .frontier import axis_value


def advise(cells: DataFrame, reflex: str, margin: float = 0.02, axis: str = "latency", efforts: tuple[str, ...] = EFFORTS) -> DataFrame:
    """One row a (task, variant): the reflex cell, the recommended cell, and what it saves.

    The reflex is ``model/effort``; where that cell is missing, the model's highest effort, else the dearest
    cell, stands for it. Candidates are within ``margin`` of the best quality. A group whose best quality is
    not above the margin is vacuous.
    """
    model, _, effort = reflex.partition("/")
    if not model or not effort:
        raise ValueError("reflex must be model/effort")
    if not 0 <= margin <= 1:
        raise ValueError("margin must be from 0 to 1")
    infinite = F.lit(float("inf"))
    key = F.coalesce(axis_value(axis), infinite)
    level = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for i, e in enumerate(efforts) for x in (e, i)]), F.col("effort")), F.lit(-1))
    group = Window.partitionBy(*GROUP)
    measured = F.nanvl(F.col("mean_value"), F.lit(None).cast("double"))  # a cell with a missing value is no candidate
    rows = cells.withColumn("axis_key", key).withColumn("mean_value", measured).withColumn("best", F.max("mean_value").over(group)).withColumn("suspect", suspect())
    rows = rows.withColumn("tokens", axis_value("throughput"))
    tier = F.when((F.col("model") == model) & (F.col("effort") == effort), 0).when(F.col("model") == model, 1).otherwise(2)
    cell = F.struct("model", "effort", "mean_value", "mean_cost", "mean_latency", "tokens", "suspect")
    reflex_order = F.struct(tier.alias("t"), F.when(tier == 1, -level).otherwise(0).alias("l"), (-F.col("mean_cost")).alias("c"), F.col("model").alias("m"), F.col("effort").alias("e"))
    choice_order = F.struct("axis_key", F.col("mean_latency").alias("l"), F.col("mean_cost").alias("c"), F.col("model").alias("m"), F.col("effort").alias("e"))
    good = F.coalesce(F.col("mean_value") >= F.col("best") - margin, F.lit(False))
    advice = rows.groupBy(*GROUP).agg(
        F.max("best").alias("best_value"), F.count(F.lit(1)).alias("n_cells"), F.count_if(good).alias("n_candidates"),
        F.min_by(cell, reflex_order).alias("r"), F.min_by(F.when(good, cell), F.when(good, choice_order)).alias("c"), F.min(tier).alias("tier"),
    )
    lead = {"cost": "save_cost", "latency": "save_latency", "tokens": "save_tokens", "throughput": "save_tokens"}[axis]
    advice = advice.select(
        *GROUP, "best_value", "n_cells", "n_candidates",
        F.col("r.model").alias("reflex_model"), F.col("r.effort").alias("reflex_effort"), (F.col("tier") > 0).alias("fallback"),
        F.col("c.model").alias("rec_model"), F.col("c.effort").alias("rec_effort"), F.col("c.mean_value").alias("rec_value"), (F.col("c.mean_value") - F.col("r.mean_value")).alias("quality_delta"),
        (F.col("r.mean_cost") - F.col("c.mean_cost")).alias("save_cost"), (F.col("r.mean_latency") - F.col("c.mean_latency")).alias("save_latency"), (F.col("r.tokens") - F.col("c.tokens")).alias("save_tokens"),
        F.when(F.col("c.mean_cost") > 0, F.col("r.mean_cost") / F.col("c.mean_cost")).alias("cost_multiple"),
        (F.col("best_value") <= margin).alias("vacuous"), (F.col("r.suspect") | F.col("c.suspect")).alias("suspect"),
    )
    return advice.withColumn("lead_saving", F.col(lead)).withColumn("note", note(axis, margin))


# Words of the notes (better, worse, equal, best) by axis.
WORDS = {
    "latency": ("faster", "slower", "same latency", "fastest"), "throughput": ("leaner", "heavier", "same throughput", "leanest"),
    "tokens": ("leaner", "heavier", "same tokens", "leanest"), "cost": ("cheaper", "pricier", "equal cost", "cheapest"),
}


def note(axis: str, margin: float) -> Column:
    """What an advice comes to: vacuous, no change, or the change of quality with the saving on the axis."""
    better, worse, equal, best = WORDS[axis]
    delta, saving = F.col("quality_delta"), F.col("lead_saving")
    same = (F.col("rec_model") == F.col("reflex_model")) & (F.col("rec_effort") == F.col("reflex_effort"))
    quality = (
        F.when(delta > 0, F.concat(F.lit("+"), F.format_string("%.3f", delta), F.lit(" quality vs reflex")))
        .when(delta < 0, F.concat(F.format_string("%.3f", -delta), F.lit(f" quality drop (≤ margin {margin:g})"))).when(delta == 0, "same quality as reflex").otherwise("quality of the reflex unmeasured")
    )
    change = F.when(saving.isNull() | F.isnan(saving), f"{axis} unmeasured (incomplete token coverage)").when(saving > 0, better).when(saving == 0, equal).otherwise(worse)
    base = (
        F.when(F.coalesce(F.col("vacuous"), F.lit(True)), "n/a: best config scores ≤ margin")
        .when(same, F.when(F.col("n_cells") > 1, f"reflex is already the {best}").otherwise("only one config ran")).otherwise(F.concat(quality, F.lit(", "), change))
    )
    return F.when(F.col("suspect"), F.concat(base, F.lit(" ⚠suspect"))).otherwise(base)


def ordered(advice: DataFrame) -> DataFrame:
    """The order in which advice is shown: the largest saving first, unmeasured ones last."""
    return advice.orderBy(F.col("lead_saving").desc_nulls_last(), *GROUP)


def total(advice: DataFrame) -> DataFrame:
    """The headline: what all groups that are not vacuous save together, and whether any has a mark."""
    return advice.agg(
        F.sum(F.when(~F.col("vacuous"), F.greatest(F.lit(0.0), F.col("lead_saving")))).alias("total_saving"),
        F.bool_or("fallback").alias("any_fallback"), F.bool_or("suspect").alias("any_suspect"), F.bool_or("vacuous").alias("any_vacuous"),
    )
