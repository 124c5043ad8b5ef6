"""Operators on the stream of runs: circuit breaker, tools, tallies, dispositions, projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import records as RE

FAILURES = ("infra_error", "timeout")
LIMIT = 5


def piece_summaries(runs: DataFrame, within: tuple[str, ...], order: tuple[str, ...], limit: int = LIMIT, pieces: int | None = None) -> DataFrame:
    """Sequences cut into pieces that follow each other (by ranges of the order), and a summary of each as column ``s``.

    A summary has what ``_joined`` needs: rows ``n``, whether a success ``resets``, failures before the first success (``head``, and in ``first``
    where the first ``limit`` of them stand), failures after the last (``tail``), the ``longest`` streak and the row of the first ``halt``.
    So a sequence of any length is as many tasks as it has ranges. ``pieces``: how many ranges (default: as Spark's shuffles are set).
    """
    cut = [*within, *order]
    ranged = runs.select(*dict.fromkeys(cut), "run_status")
    ranged = ranged.repartitionByRange(pieces, *cut) if pieces else ranged.repartitionByRange(*cut)
    here = Window.partitionBy(*within, "piece").orderBy(*order)
    upto = here.rowsBetween(Window.unboundedPreceding, 0)
    ok, failed = F.coalesce(F.col("run_status") == "ok", F.lit(False)), F.coalesce(F.col("run_status").isin(*FAILURES), F.lit(False))
    rows = ranged.withColumns({"piece": F.spark_partition_id(), "ok": ok, "failed": failed})
    rows = rows.withColumns({"at": F.row_number().over(here).cast("long"), "failures": F.sum(F.col("failed").cast("long")).over(upto)})
    rows = rows.withColumn("settled", F.max(F.when(F.col("ok"), F.col("failures"))).over(upto))
    streak, open_head = F.col("failures") - F.coalesce("settled", F.lit(0)), F.col("settled").isNull()
    return rows.groupBy(*within, "piece").agg(F.struct(
        F.count(F.lit(1)).alias("n"), F.max("ok").alias("resets"), F.coalesce(F.max(F.when(open_head, F.col("failures"))), F.lit(0)).cast("long").alias("head"),
        F.array_sort(F.collect_list(F.when(open_head & F.col("failed") & (F.col("failures") <= limit), F.col("at")))).alias("first"),
        F.max_by(streak, "at").alias("tail"), F.max(streak).alias("longest"), F.min(F.when(streak >= limit, F.col("at"))).alias("halt"),
    ).alias("s"))


def _joined(a: Column, b: Column, limit: int) -> Column:
    """The summary of a piece ``a`` that ``b`` follows. The operation is associative: a streak goes on from a's tail into b's head, and the failure of b that fills it to ``limit`` halts."""
    filling = F.try_element_at(b["first"], (F.lit(limit) - a["tail"]).cast("int"))
    both = F.concat(a["first"], F.transform(b["first"], lambda x: x + a["n"]))
    return F.struct(
        (a["n"] + b["n"]).alias("n"), (a["resets"] | b["resets"]).alias("resets"), F.when(a["resets"], a["head"]).otherwise(a["head"] + b["head"]).alias("head"),
        F.when(a["resets"], a["first"]).otherwise(F.slice(both, 1, limit)).alias("first"), F.when(b["resets"], b["tail"]).otherwise(a["tail"] + b["tail"]).alias("tail"),
        F.greatest(a["longest"], b["longest"], a["tail"] + b["head"]).alias("longest"), F.coalesce(a["halt"], F.when(a["tail"] < limit, a["n"] + filling), a["n"] + b["halt"]).alias("halt"),
    )


def breaker(runs: DataFrame, within: tuple[str, ...], order: tuple[str, ...], limit: int = LIMIT, pieces: int | None = None) -> DataFrame:
    """Per sequence, the longest streak of infrastructure failures and where it first reaches the limit (null: never).

    A success resets the streak; other statuses, and none, neither add nor reset. Ranges of a sequence are summed up where they lie, and
    the summaries, of which a sequence has at most as many as there are ranges, are folded in order. ``order`` should tell the rows of a sequence apart.
    """
    if limit < 1:
        raise ValueError("limit must be positive")
    parts = piece_summaries(runs, within, order, limit, pieces).groupBy(*within).agg(F.array_sort(F.collect_list(F.struct("piece", "s"))).alias("parts"))
    whole = F.aggregate(F.slice("parts", 2, F.greatest(F.size("parts") - 1, F.lit(0))), F.col("parts")[0]["s"], lambda a, b: _joined(a, b["s"], limit))
    folded = parts.select(*within, whole.alias("s"))
    return folded.select(*within, F.col("s.n").alias("n_runs"), F.col("s.longest").alias("longest"), F.col("s.halt").alias("halt_at"))


def tool_histogram(runs: DataFrame, key: str, tools: str) -> DataFrame:
    """(key, tool, n) from an array column; null arrays are not measured and give no row."""
    return runs.select(key, F.explode(tools).alias("tool")).groupBy(key, "tool").agg(F.count(F.lit(1)).alias("n"))


def tool_counts(tools: str | F.Column) -> F.Column:
    """Map of tool to how often an array names it; null stays null (not measured), an empty array is an empty map."""
    tools = F.col(tools) if isinstance(tools, str) else tools
    count = lambda name: F.size(F.filter(tools, lambda x: x == name)).cast("long")
    return F.map_from_entries(F.transform(F.array_sort(F.array_distinct(tools)), lambda name: F.struct(name.alias("key"), count(name).alias("value"))))


def tallies(rows: DataFrame) -> DataFrame:
    """How many runs and grades have each status."""
    return rows.groupBy("run_status", "grade_status").agg(F.count(F.lit(1)).alias("n"))


def sweep_summary(planned: DataFrame) -> DataFrame:
    """One row about cells with an ``action`` (skip, regrade, run) and, where one was taken, run_status and grade_status: counts of dispositions, which add up to n_cells, and of grades."""
    done, action = F.col("run_status") == "ok", F.col("action")
    graded = lambda s: F.count_if((action != "skip") & done & (F.col("grade_status") == s))
    return planned.agg(
        F.count(F.lit(1)).alias("n_cells"), F.count_if(action == "skip").alias("skipped"), F.count_if(action == "regrade").alias("regraded"), F.count_if((action == "run") & done).alias("ran"),
        F.count_if((action == "run") & ~F.coalesce(done, F.lit(False))).alias("failed"), graded("ok").alias("graded_ok"), graded("unparseable").alias("unparseable"), graded("grader_error").alias("grader_error"),
    )


def calibration_cell(cells: DataFrame) -> DataFrame:
    """The first cell of a grid, the one that an estimate runs."""
    return cells.orderBy("pos").limit(1)


def projection(cells: DataFrame, cost_usd: float, latency_s: float, tokens: int | None) -> DataFrame:
    """What a sweep of ``cells`` takes if each is like the calibrated one; a null stays unknown."""
    n = F.count(F.lit(1))
    return cells.agg(n.alias("n_cells"), (n * F.lit(cost_usd)).alias("cost_usd"), (n * F.lit(latency_s)).alias("latency_s"), (n * F.lit(tokens).cast("long")).alias("tokens"))


def regrade_selection(ledger: DataFrame, tasks: DataFrame, sequence: str = "seq") -> DataFrame:
    """The last successful row of each run whose task is still in the suite; these are graded again."""
    from ..schema import RUN_KEY
    from .dedupe import latest_ok

    return latest_ok(ledger.join(tasks.select("task_id").distinct(), "task_id", "left_semi"), RUN_KEY, sequence)


def regraded(rows: DataFrame, score: str, version: str, ts: str) -> DataFrame:
    """Ledger rows with the grade columns of a new ``score`` and a note of which grade it replaces; the run's columns stay."""
    details = F.map_concat(F.map_filter(f"{score}.details", lambda k, v: k != "regrade_of"), F.create_map(F.lit("regrade_of"), F.coalesce("grader_version", F.lit(""))))
    fresh = {"value": F.col(f"{score}.value"), "grade_status": F.col(f"{score}.status"), "subscores": F.to_json(f"{score}.subscores"), "details": F.to_json(details), "grader_version": F.lit(version), "ts": F.lit(ts)}
    return rows.withColumns(fresh).drop(score)


def run_rows(records: DataFrame, payload: str = "payload", returncode: str = "returncode") -> DataFrame:
    """The columns of ``records`` with what the JSON object ``payload`` tells of a run: status, cost, turns, model, measured tokens and whether its usage has drifted."""
    v = F.try_parse_json(payload)
    usage = F.try_variant_get(v, "$.usage", "variant")
    get = lambda path, kind="string": F.try_variant_get(v, path, kind)
    return records.withColumns({
        "run_status": F.when(v.isNull(), "parse_fail").otherwise(RE.run_status(get("$.is_error", "boolean"), get("$.api_error_status", "bigint"), get("$.result"), F.col(returncode))),
        "cost_usd": RE.finite(get("$.total_cost_usd")), "num_turns": RE.finite_count(get("$.num_turns")), "session_id": get("$.session_id"),
        "model_resolved": RE.first_model(F.get_json_object(payload, "$.modelUsage")), "usage_drifted": RE.usage_drifted(usage),
        **{column: RE.measured_tokens(usage, key) for key, column in RE.USAGE.items()},
    })
