"""Intervals of cells of any size, against plain Python and against the figures of one published ledger."""

import hashlib
import math

import pytest

from gaugeloom.operators import cells as CE
from gaugeloom.operators import frontier as FR
from gaugeloom.operators.dedupe import latest_grade
from gaugeloom.operators.intervals import POISSON, bootstrap_intervals
from gaugeloom.schema import LEDGER


def _md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def plain(values, buckets=1024, resamples=200):
    """(low, high) of the mean of {unit: value}."""
    values = {u: v for u, v in values.items() if v is not None}
    if len(values) < 3:
        return None, None
    means = []
    for b in range(1, resamples + 1):
        total = count = 0
        for unit, v in values.items():
            h = _md5(f"42:{int(_md5(unit)[:8], 16) % buckets}:{(b - 1) // 8}")
            w = sum(int(h[4 * ((b - 1) % 8) :][:4], 16) >= t for t in POISSON)
            total, count = total + w * v, count + w
        if count:
            means.append(total / count)
    means.sort()
    return tuple(means[max(1, math.ceil(len(means) * q - 1e-9)) - 1] for q in (0.025, 0.975))


@pytest.mark.parametrize("buckets", [1024, 16])
def test_intervals_equal_plain_python(spark, buckets):
    groups = {n: {f"r{n}-{i}": None if i == 1 and n == 5 else (i * 37 % 101) / 7 for i in range(n)} for n in (1, 2, 3, 4, 5, 30, 31, 400)}
    rows = spark.createDataFrame([(n, u, v) for n, g in groups.items() for u, v in g.items()], "n long, unit string, v double")
    got = {r.n: (r.v_low, r.v_high) for r in bootstrap_intervals(rows, ("n",), "unit", {"v": "v"}, buckets=buckets).collect()}
    assert got == {n: tuple(x if x is None else pytest.approx(x) for x in plain(g, buckets)) for n, g in groups.items()}


def test_an_interval_is_as_wide_as_the_normal_law_says(spark):
    n = 200_000
    rows = spark.range(n).selectExpr("1 as g", "id as unit", "cast(pmod(xxhash64(id), 1000) as double) as v")
    low, high = bootstrap_intervals(rows, ("g",), "unit", {"v": "v"}, resamples=1000).select("v_low", "v_high").first()
    assert low < 499.5 < high and (high - low) / 2 == pytest.approx(1.96 * 288.7 / math.sqrt(n), rel=0.15)


#: Cells of a published ledger: model, effort, then the values, costs, latencies and output tokens of three epochs.
PUBLISHED = [
    ("a", "low", (1, 1, 0), (0.072787, 0.0546724, 0.070182), (54.523, 55.6037, 54.3808), (10462, 10728, 9140)), ("a", "high", (1, 1, 1), (0.066517, 0.0323427, 0.0544877), (105.9817, 31.2374, 55.3007), (11844, 6262, 10691)),
    ("a", "xhigh", (1, 1, 1), (0.0747077, 0.0450227, 0.0421874), (69.5827, 47.5465, 34.4232), (14735, 8798, 6048)), ("b", "low", (1, 1, 1), (0.118065, 0.0293856, 0.0237006), (18.753, 16.5073, 13.3191), (1734, 1652, 1273)),
    ("b", "high", (1, 1, 1), (0.1100538, 0.0461556, 0.2435256), (26.1772, 28.7369, 131.4998), (2840, 2770, 15928)), ("b", "xhigh", (1, 1, 1), (0.285915, 0.0695106, 0.0666906), (100.4287, 36.4943, 37.0694), (12924, 4327, 4139)),
    ("c", "low", (1, 1, 1), (0.102485, 0.0571615, 0.0520865), (22.4452, 18.8883, 16.4995), (1505, 1236, 1033)), ("c", "high", (1, 1, 1), (0.121785, 0.0828865, 0.0801865), (26.4685, 26.6129, 27.0732), (2277, 2265, 2157)),
    ("c", "xhigh", (1, 1, 1), (0.13446, 0.1153115, 0.0994365), (30.7065, 38.6352, 33.9879), (2784, 3562, 2927)), ("d", "low", (1, 1, 1), (0.19922, 0.102528, 0.111428), (16.4201, 18.1576, 17.4887), (868, 974, 1152)),
    ("d", "high", (1, 1, 1), (0.23432, 0.145228, 0.132528), (21.8561, 25.0093, 21.1191), (1570, 1828, 1574)), ("d", "xhigh", (1, 1, 1), (0.24607, 0.139528, 0.158328), (24.3364, 22.3931, 28.0421), (1805, 1714, 2090)),
    ("d", "max", (1, 1, 1), (0.34702, 0.336578, 0.234678), (42.936, 59.8294, 42.8223), (3824, 5655, 3617)),
]
#: The means that were published of them: value, cost, latency, output tokens.
MEANS = {
    ("a", "low"): (0.6667, 0.0659, 54.84, 10110.0), ("a", "high"): (1.0, 0.0511, 64.17, 9599.0), ("a", "xhigh"): (1.0, 0.0540, 50.52, 9860.3), ("b", "low"): (1.0, 0.0571, 16.19, 1553.0), ("b", "high"): (1.0, 0.1332, 62.14, 7179.3),
    ("b", "xhigh"): (1.0, 0.1407, 58.00, 7130.0), ("c", "low"): (1.0, 0.0706, 19.28, 1258.0), ("c", "high"): (1.0, 0.0950, 26.72, 2233.0), ("c", "xhigh"): (1.0, 0.1164, 34.44, 3091.0), ("d", "low"): (1.0, 0.1377, 17.36, 998.0),
    ("d", "high"): (1.0, 0.1707, 22.66, 1657.3), ("d", "xhigh"): (1.0, 0.1813, 24.92, 1869.7), ("d", "max"): (1.0, 0.3061, 48.53, 4365.3),
}


@pytest.fixture(scope="module")
def published(spark):
    rows = []
    for model, effort, values, costs, latencies, tokens in PUBLISHED:
        for i in range(3):
            row = dict.fromkeys(LEDGER.names) | {"task_id": "t8", "model": model, "effort": effort, "variant": "none", "epoch": i, "run_id": f"{model}{effort}{i}", "run_status": "ok", "ts": f"2026-07-06T12:{i}"}
            rows.append(row | {"grade_status": "ok" if values[i] else "unparseable", "value": float(values[i]), "cost_usd": costs[i], "latency_s": latencies[i], "output_tokens": tokens[i], "grader_version": "v", "spec_sha": "s"})
    return spark.createDataFrame([tuple(r[c] for c in LEDGER.names) for r in rows], LEDGER)


def test_report_gives_the_published_figures(published):
    cells = {(r.model, r.effort): r for r in CE.report(published).collect()}
    assert len(cells) == 13
    for model, effort, *epochs in PUBLISHED:
        r = cells[model, effort]
        means = (r.mean_value, r.mean_cost, r.mean_latency, r.mean_output_tokens)
        assert all(abs(a - b) <= off for a, b, off in zip(means, MEANS[model, effort], (6e-5, 6e-5, 6e-3, 6e-2)))
        for name, of in zip(("value", "cost", "latency", "output_tokens"), epochs):  # of three epochs the interval is their range
            assert (r[f"{name}_low"], r[f"{name}_high"]) == (pytest.approx(min(of)), pytest.approx(max(of)))
        assert r.total_tokens_low is None and r.n_epochs == 3 and r.n_spec == r.n_grader_versions == 1 and r.n_dropped == 0
    assert cells["a", "low"].n_unparseable == 1 and cells["a", "low"].std_value == pytest.approx(math.sqrt(1 / 3)) and cells["b", "low"].std_value == 0


def test_frontiers_are_the_published_ones(published):
    for axis, winner in (("cost", ("a", "high")), ("latency", ("b", "low")), ("tokens", ("d", "low"))):
        assert [(r.model, r.effort) for r in CE.report(published, axis=axis).filter("pareto").collect()] == [winner]
    assert FR.mark_frontier(CE.aggregate(latest_grade(published)), "throughput").filter("pareto").count() == 0


def test_report_equals_the_aggregate_of_the_latest_grades(spark):
    rows = []
    for i in range(600):
        status = ["ok", "ok", "ok", "timeout", None][i % 5]
        row = dict.fromkeys(LEDGER.names) | {"task_id": f"t{i % 3}", "model": "m", "effort": "e", "variant": None if i % 7 == 0 else "v", "run_id": f"r{i % 250}", "run_status": status, "ts": str(i), "grade_status": ["ok", "unparseable", "grader_error", "ok"][i % 4]}
        rows.append(row | {"value": None if i % 90 == 4 else i / 7, "cost_usd": 0.1, "latency_s": float(i), "input_tokens": None if i % 4 == 1 else i, "output_tokens": i, "cache_read_tokens": 0, "cache_creation_tokens": 1, "grader_version": None if i % 11 == 0 else f"g{i % 3}", "spec_sha": f"s{i % 2}"})
    ledger = spark.createDataFrame([tuple(r[c] for c in LEDGER.names) for r in rows], LEDGER)
    report = CE.report(ledger)
    dropped = {tuple(r[c] for c in ("task_id", "variant")): r.n_dropped for r in CE.dropped_runs(ledger).collect()}
    expected = {(r.task_id, r.variant): r for r in CE.aggregate(latest_grade(ledger)).collect()}
    got = {(r.task_id, r.variant): r for r in report.collect()}
    assert got.keys() == expected.keys()
    for key, r in got.items():
        assert r.n_dropped == dropped.get(key, 0)
        for c in expected[key].__fields__:
            assert r[c] == (pytest.approx(expected[key][c], rel=1e-9, nan_ok=True) if isinstance(r[c], float) else expected[key][c]), (key, c)
