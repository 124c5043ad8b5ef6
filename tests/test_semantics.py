"""The ledger's rules on small cases."""

import pytest
from pyspark.sql import functions as F

from gaugeloom.functions import text
from gaugeloom.operators import advise, cells, dedupe, frontier, paired, runs
from gaugeloom.schema import LEDGER
from gaugeloom.sources import ledger

BASE = {"task_id": "t", "model": "m", "effort": "low", "variant": "base", "epoch": 3, "grader_version": "g7", "run_status": "ok", "grade_status": "ok", "value": 0.8, "cost_usd": 0.25, "latency_s": 1.0, "spec_sha": "f00", "subscores": "{}", "ts": "2026-01-01"}


def rows(spark, *changes):
    return spark.createDataFrame([tuple({**BASE, "run_id": f"r{i}", **c}.get(n) for n in LEDGER.names) for i, c in enumerate(changes)], LEDGER)


def test_newer_grade_wins_and_newer_error_evicts(spark):
    r = rows(spark, {"run_id": "a", "value": 0.5}, {"run_id": "a", "value": 0.9, "ts": "2026-01-02"}, {"run_id": "b"}, {"run_id": "b", "ts": "2026-01-02", "grade_status": "grader_error"})
    assert [(x.run_id, x.value) for x in dedupe.latest_grade(r).collect()] == [("a", 0.9)]


def test_unparseable_counts_as_zero_and_dropped_runs_are_counted(spark):
    r = rows(spark, {}, {"grade_status": "unparseable", "value": 0.0}, {"run_status": "timeout"}, {"run_status": "parse_fail"})
    c = cells.report(r).first()
    assert (c.n_epochs, c.mean_value, c.n_unparseable, c.n_dropped) == (2, 0.4, 1, 2)


def test_null_cost_is_nan_and_never_on_the_frontier(spark):
    r = rows(spark, {"model": "a", "cost_usd": None}, {"model": "b", "cost_usd": 0.5}, {"model": "c", "cost_usd": 0.6})
    marked = frontier.mark_frontier(cells.aggregate(r), "cost").collect()
    assert {x.model for x in marked if x.pareto} == {"b"}


def test_partial_token_coverage_is_off_the_token_frontier(spark):
    r = rows(spark, {"output_tokens": 5}, {"output_tokens": None}, {"model": "n", "output_tokens": 9})
    assert {x.model for x in frontier.mark_frontier(cells.aggregate(r), "tokens").collect() if x.pareto} == {"n"}


def test_worst_epoch_leaks(spark):
    r = rows(spark, *({"subscores": f'{{"shuffled_auroc": {x}}}'} for x in (0.5, 0.85, 0.5)))
    assert cells.aggregate(r).first().leakage


@pytest.mark.parametrize("n, p, real", [(6, 2 / 64, True), (4, 0.125, False)])
def test_sign_flip(spark, n, p, real):
    r = rows(spark, *({"model": f"m{i}", "variant": v, "value": x} for i in range(n) for v, x in (("a", 0.5), ("b", 0.8))))
    out = paired.compare(r, "a", "b").first()
    assert (out.n_pairs, out.n_nonzero, out.real) == (n, n, real) and out.p_value == pytest.approx(p)


def test_all_ties_have_no_p(spark):
    r = rows(spark, *({"model": f"m{i}", "variant": v} for i in range(3) for v in ("a", "b")))
    out = paired.compare(r, "a", "b").first()
    assert out.p_value is None and not out.real


def test_advice_takes_the_cheapest_good_cell(spark):
    r = rows(spark, {"model": "opus", "effort": "high", "value": 1.0, "latency_s": 9.0}, {"model": "sonnet", "value": 0.99, "latency_s": 3.0}, {"model": "haiku", "value": 0.5, "latency_s": 1.0})
    out = advise.advise(cells.aggregate(r), "opus/max").first()
    assert (out.rec_model, out.reflex_effort, out.fallback, out.lead_saving) == ("sonnet", "high", True, 6.0)
    with pytest.raises(ValueError):
        advise.advise(cells.aggregate(r), "opus")


def test_breaker(spark):
    statuses = ["timeout"] * 3 + ["parse_fail"] + ["infra_error"] * 2 + ["ok"] + ["timeout"] * 4
    r = rows(spark, *({"run_status": s, "ts": f"{i:02}"} for i, s in enumerate(statuses)))
    out = runs.breaker(r, ("task_id",), ("ts",)).first()
    assert (out.longest, out.halt_at) == (5, 6)


def test_ledger_files(spark, tmp_path):
    path = str(tmp_path / "l")
    assert ledger.read_ledger(spark, path).count() == 0
    ledger.append_ledger(rows(spark, {}, {}), path)
    assert ledger.read_ledger(spark, path).count() == 2 == ledger.read_ledger_checked(spark, path).count()
    one = tmp_path / "one.jsonl"
    one.write_text('{"task_id": "a"}\n\n{"task_id": "b", "new": 1}\n{"task_id": "c')
    assert sorted(r.task_id for r in ledger.read_ledger_checked(spark, str(one)).collect()) == ["a", "b"]
    one.write_text('{"task_id": "a"}\n{"task_\n{"task_id": "c"}\n')
    with pytest.raises(ValueError):
        ledger.read_ledger_checked(spark, str(one))
    with pytest.raises(ValueError):
        ledger.write_sanitized(rows(spark, {"ts": "/home/x"}), str(tmp_path / "s"), ("task_id", "ts"), ("/home/",))


def test_text_functions(spark):
    one = spark.range(1)
    got = one.select(
        text.verdict(F.lit("Injection!")), text.verdict(F.lit("both safe injection")), text.bare_integer(F.lit("`1,234`")), text.bare_integer(F.lit("12 apples")),
        text.normalized(F.lit("a  b\n")), text.first_number(F.lit("about 1,200.5 or 3")), text.rendered(F.lit("x {a} y"), {"a": F.lit("1")}), text.variant_parts(F.lit("r@x@y"))[1],
    ).first()
    assert tuple(got) == (1, None, "1234", None, "a b", 1200.5, "x 1 y", "x@y")
