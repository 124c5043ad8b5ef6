"""What a report moves, and how often: rows of some tasks are made once, and a row takes along only what counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeloom.operators import cells, sanitize
from gaugeloom.schema import CELL
from tests.test_semantics import rows


def test_rows_of_some_tasks_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def counted(i):
        made.add(1)
        return i >= 0

    kept = sanitize.only_tasks(spark.range(40).select(F.concat(F.lit("t"), (F.col("id") % 2).cast("string")).alias("task_id"), "id").filter(counted("id")).repartition(3, "id"), ("t1",))
    assert sorted(r.id for r in kept.collect()) == list(range(1, 40, 2))
    assert made.value == 20


def _moved(plan, found):
    """Names of the columns that reach a window by run, in an optimized plan."""
    children = [plan.children().apply(i) for i in range(plan.children().size())]
    if plan.nodeName() == "Window" and "run_id" in plan.partitionSpec().toString():
        output = children[0].output()
        found.append({output.apply(i).name() for i in range(output.size())})
    for child in children:
        _moved(child, found)
    return found


def test_report_moves_no_texts_that_it_can_do_without(spark):
    ledger = rows(spark, {}, {"run_status": "timeout"})
    found = _moved(cells.report(ledger)._jdf.queryExecution().optimizedPlan(), [])
    assert len(found) == 2 and {"run_id", "ts", "grader_version", "shuffled", "total_tokens", *CELL} <= found[-1]
    assert not found[-1] & {"subscores", "input_tokens", "cache_read_tokens", "cache_creation_tokens", "run_status", "grade_status", "details"}


def test_ties_are_told_by_measures_of_rows_that_cannot_be_chosen(spark):
    ledger = rows(
        spark,
        {"run_id": "a", "value": 0.5}, {"run_id": "a", "value": 0.9, "grade_status": "grader_error"},  # the error evicts
        {"run_id": "b", "value": 0.4, "grade_status": "grader_error"}, {"run_id": "b", "value": 0.7, "subscores": '{"shuffled_auroc": 0.75}', "input_tokens": 1, "output_tokens": 2, "cache_read_tokens": 3, "cache_creation_tokens": 4},
        {"run_id": "c", "value": 0.9, "run_status": "timeout"}, {"run_id": "c", "value": 0.0, "grade_status": "unparseable"},
        {"run_id": "d", "run_status": None}, {"run_id": "e", "grade_status": None},
    )
    r = cells.report(ledger, ("value",)).first()
    assert (r.n_epochs, r.mean_value, r.n_unparseable, r.n_dropped, r.mean_shuffled_auroc, r.leakage) == (2, 0.35, 1, 1, 0.75, True)
    assert (r.mean_total_tokens, r.n_total_token_epochs, r.n_spec, r.n_grader_versions) == (10.0, 1, 1, 1)
