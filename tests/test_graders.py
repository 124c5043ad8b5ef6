"""Graders, records and notes on small cases."""

import datetime
import hashlib
import json
import math
import statistics

import pytest
from pyspark.sql import functions as F

from gaugeloom.functions import json_text as JT
from gaugeloom.functions import records as RE
from gaugeloom.functions import stats as ST
from gaugeloom.functions import text as TX
from gaugeloom.operators import advise, cells, frontier, graders, grading, paired, runs, sanitize, shuffled
from gaugeloom.plans import tables
from gaugeloom.sources import ledger, outputs, specs
from tests.test_semantics import rows


def mapped(spark, fn, *values):
    """What a column function makes of some strings."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r.y for r in df.select("i", fn(F.col("x")).alias("y")).orderBy("i").collect()]


def test_json_amid_chatter(spark):
    assert mapped(spark, JT.lenient_json, '{"a": 1}', 'well [1, 2] {"a": 1}', '{"a": 1} }', "[" * 3000, "no", None, '{"b": {"c": "é"}} trailing {', 'true story', '{"a": 1} {"b": 2}') == ['{"a":1}', "[1, 2]", '{"a": 1}', None, None, None, json.dumps({"b": {"c": "é"}}), None, '{"a": 1}']
    assert [x if x is None else json.dumps(json.loads(x)) for x in mapped(spark, JT.payload_object, "[1]", 'x\n{"a": 1}\n{"b": 2}\n{bad', 'p {"c": 3} q', "{}", "none", '{"a": 1}\n{"b": 2}')] == [None, '{"b": 2}', '{"c": 3}', "{}", None, '{"b": 2}']


def test_answers(spark):
    replies = ["ANSWER: a\nanswer = b  ", '"quoted"', "42", '{"value": null, "line": 7} and {"x": 1}', "t\n```\ncode\n```", "a ```\nx\n``` b ```\ny\n```", "  plain ", " \n\t", '[10, 20] {"answer": "z"} [30]']
    assert mapped(spark, JT.answer_of, *replies) == ["b", "quoted", "42", "7", "code", "a ```\nx\n``` b ```\ny\n```", "plain", None, "z"]
    assert mapped(spark, TX.bare_integer, "**7,334**", "2,4", "$-007$", "1" * 40, "+0", "7.") == ["7334", None, "-7", "1" * 40, "0", None]


def test_classification_value_and_status(spark):
    replies = spark.createDataFrame([(1, '{"results": [{"idx": "0", "label": "injection"}, {"idx": 1, "label": 0.2}, {"idx": 1, "label": "hm"}, 3]}'), (2, "nothing"), (3, "[]"), (4, "[]")], "k int, output string")
    gold = spark.createDataFrame([(k, i, y) for k in (1, 2, 3) for i, y in ((0, 1), (1, 0), (2, 1))] + [(5, 0, 1)], "k int, idx long, label int")
    got = {r.k: (r.status, r.value, r.missing_idx) for r in graders.classification(replies, gold, "k").collect()}
    assert got == {1: ("ok", 0.75, [2]), 2: ("unparseable", 0.0, None), 3: ("ok", 0.0, [0, 1, 2]), 4: ("grader_error", 0.0, None)}
    labels = spark.range(1).select(JT.label_map(F.create_map(*(F.lit(x) for x in ("1", "safe", "2", "0.7", "x", "1", "3", "hm")))).alias("m")).first().m
    assert labels == {1: 0, 2: 1}


def test_auroc_interval(spark):
    counts = spark.createDataFrame([(1, 40, 10, 40, 10), (2, 50, 0, 50, 0), (3, 2, 1, 2, 1), (4, 10, 0, 0, 5)], "k int, tp int, fp int, tn int, fn int")
    got = grading.auroc_interval(counts, "k").orderBy("k").collect()
    assert 0.68 < got[0].low < 0.75 and 0.85 < got[0].high < 0.9
    assert got[1].note == "degenerate" and [x.low for x in got[1:]] == [None] * 3


def _plain_auroc_interval(key, counts):
    """(low, high, note) by loops: Poisson draws by inversion, then the bias-corrected and accelerated bounds."""
    names, normal = ("tp", "fp", "tn", "fn"), statistics.NormalDist()

    def auroc(c):
        return (c[0] / (c[0] + c[3]) + c[2] / (c[2] + c[1])) / 2 if c[0] + c[3] and c[1] + c[2] else None

    def drawn(name, n, b):
        u, k = int(hashlib.md5(f"42:{b}:{name}:{key}".encode()).hexdigest()[:8], 16) / 2**32, 0
        upto = math.exp(-n)
        p = upto
        while upto < u:
            k += 1
            p *= n / k
            upto += p
        return k

    if sum(counts) < 10 or auroc(counts) is None:
        return None, None, None
    xs = sorted(x for x in (auroc([drawn(name, n, b) for name, n in zip(names, counts)]) for b in range(1000)) if x is not None)
    point = auroc(counts)
    left = [(n, auroc([m - (i == j) for j, m in enumerate(counts)])) for i, n in enumerate(counts) if n]
    left = [(n, x) for n, x in left if x is not None]
    mean = sum(n * x for n, x in left) / sum(n for n, _ in left) if left else 0
    square, cube = (sum(n * (mean - x) ** e for n, x in left) for e in (2, 3))
    share = (sum(x < point - 1e-12 for x in xs) + 0.5 * sum(abs(x - point) <= 1e-12 for x in xs)) / len(xs)
    if xs[0] == xs[-1] or not square or not 0 < share < 1:
        return None, None, "degenerate"
    z, a, bounds = normal.inv_cdf(share), cube / (6 * square**1.5), []
    for q in (normal.inv_cdf(0.025), normal.inv_cdf(0.975)):
        at = normal.cdf(z + (z + q) / (1 - a * (z + q))) * (len(xs) - 1)
        bounds.append(xs[math.floor(at)] * (1 - at % 1) + xs[math.ceil(at)] * (at % 1))
    return *bounds, None


def test_auroc_interval_equals_loops(spark):
    cases = {"a": (40, 10, 40, 10), "b": (3, 1, 5, 2), "c": (30, 0, 9, 1), "d": (1, 0, 300, 0), "e": (0, 8, 0, 9), "f": (12, 0, 0, 3), "": (5, 5, 5, 5), "g": (200, 3, 7, 400), "h": (0, 0, 0, 0)}
    frame = spark.createDataFrame([(k, *v) for k, v in cases.items()], "k string, tp long, fp long, tn long, fn long")
    got = {r.k: (r.low, r.high, r.note) for r in grading.auroc_interval(frame, "k").collect()}
    assert got == {k: tuple(pytest.approx(x, abs=1e-6) if isinstance(x, float) else x for x in _plain_auroc_interval(k, v)) for k, v in cases.items()}
    assert grading.auroc_interval(frame.limit(0), "k").count() == 0
    large = grading.auroc_interval(spark.createDataFrame([(None, 8_000_000, 1_000_000, 9_000_000, 2_000_000)], "k string, tp long, fp long, tn long, fn long"), "k").first()
    half = 1.96 * math.sqrt(0.8 * 0.2 / 10**7 + 0.9 * 0.1 / 10**7) / 2
    assert large.low == pytest.approx(0.85 - half, abs=half / 5) and large.high == pytest.approx(0.85 + half, abs=half / 5)


def test_normal_law(spark):
    normal = statistics.NormalDist()
    ps, xs = [1e-9, 0.0004, 0.02424, 0.02426, 0.3, 0.5, 0.8, 0.97, 0.99999], [-8.0, -6.5, -3.0, -0.1, 0.0, 1.96, 5.0, 7.5]
    got = spark.createDataFrame([(p,) for p in ps], "p double").select(ST.normal_quantile(F.col("p")).alias("z")).collect()
    assert [r.z for r in got] == [pytest.approx(normal.inv_cdf(p), rel=2e-9, abs=1e-12) for p in ps]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select(ST.normal_share(F.col("x")).alias("p")).collect()
    assert [r.p for r in got] == [pytest.approx(normal.cdf(x), abs=1e-11) for x in xs]


def test_shuffled_labels_are_near_a_half(spark):
    data = spark.createDataFrame([("a", i % 2, i % 2) for i in range(200)] + [("one", 1, 1)] * 5 + [("none", 1, None), ("none", 0, None)], "g string, y int, p int")
    got = {r.g: (r.n, r.shuffled_auroc) for r in shuffled.shuffled_auroc(data, "g", "y", "p").collect()}
    assert abs(got["a"][1] - 0.5) < 0.02 and got["a"][0] == 200 and got["one"] == (5, None)


def test_unmeasured_cells_are_no_candidates(spark):
    r = rows(spark, {"model": "a", "value": 1.0}, {"model": "b", "value": None}, {"model": "c", "value": 0.99, "latency_s": 0.5})
    out = advise.advise(cells.aggregate(r), "a/low").first()
    assert (out.best_value, out.rec_model, out.n_candidates, out.n_cells) == (1.0, "c", 2, 3) and out.note == "0.010 quality drop (≤ margin 0.02), faster"


def test_advice_notes_and_order(spark):
    def note(*changes, axis="latency"):
        return advise.advise(cells.aggregate(rows(spark, *changes)), "a/low", axis=axis).first().note

    assert note({"model": "a"}) == "only one config ran"
    assert note({"model": "a", "latency_s": 0.1}, {"model": "b"}) == "reflex is already the fastest"
    assert note({"model": "a", "value": 0.01}) == "n/a: best config scores ≤ margin"
    assert note({"model": "a"}, {"model": "b", "value": 0.9}, axis="throughput") == "+0.100 quality vs reflex, throughput unmeasured (incomplete token coverage)"
    assert note({"model": "a"}, {"model": "b", "grade_status": "unparseable"}, {"model": "b", "value": 0.9, "latency_s": 0.1}).endswith("faster ⚠suspect")
    many = advise.advise(cells.aggregate(rows(spark, *({"task_id": t, "model": m, "latency_s": x} for t, m, x in (("p", "a", 2.0), ("p", "b", 1.0), ("q", "a", 9.0), ("q", "b", 1.0))))), "a/low")
    assert [r.task_id for r in advise.ordered(many).collect()] == ["q", "p"]
    assert [r.task_id for r in tables.advice_table(many).collect()] == ["p", "q"] and tables.shown(tables.advice_table(many)).count("\n") == 3


@pytest.mark.parametrize("n, step, note", [(3, 0.0, "all diffs zero — no directional evidence; CI degenerate (all diffs identical)"), (5, 0.1, "n_nonzero=5 < 6 — p cannot reach 0.05 (min p = 0.0625)"), (7, 0.1, "exact sign-flip test"), (18, 0.1, "exact sign-flip test"), (41, 0.1, "sampled sign-flip test")])
def test_compare_notes(spark, n, step, note):
    r = rows(spark, *({"model": f"m{i:02}", "variant": v, "value": 0.1 + (v == "b") * step * (1 + i % 3)} for i in range(n) for v in "ab"))
    out = paired.compare(r, "a", "b").first()
    assert out.note == note and (out.p_value is None) == (step == 0) and out.ci_low <= out.delta + 1e-9 and out.delta <= out.ci_high + 1e-9
    assert tables.compare_table(paired.compare(r, "a", "b")).first().pairs == str(n)


def test_report_takes_one_scan_and_gives_all_intervals(spark):
    r = rows(spark, *({"value": x / 40, "output_tokens": x} for x in range(40)), *({"model": "few", "value": x} for x in (0.1, 0.5, 0.6)), {"model": "two"}, {"model": "two", "value": 0.1})
    report = cells.report(r)
    got = {x.model: x for x in report.collect()}
    assert got["m"].value_low == pytest.approx(19.5 / 40 - 1.96 * 0.292261 / 40**0.5, abs=0.03) and (got["few"].value_low, got["few"].value_high) == (pytest.approx(0.1), pytest.approx(0.6)) and got["two"].value_low is None
    assert got["m"].output_tokens_high > got["m"].mean_output_tokens and got["few"].output_tokens_low is None
    assert report.columns == cells.report(r.limit(0)).columns and cells.report(r.limit(0)).count() == 0
    assert {x.config: x.front for x in tables.report_table(report).collect()} == {"m/low": "*", "few/low": "", "two/low": ""}
    drawn = frontier.drawing(report.withColumn("x", F.col("mean_latency")), "latency_low", "latency_high").collect()
    assert all(x.bar_low is None or x.bar_low >= 0 for x in drawn) and not any(x.log_x for x in drawn)


def test_run_records(spark):
    records = spark.createDataFrame([("a", '{"is_error": true, "api_error_status": 429, "result": "Rate Limit", "usage": {}}', 0), ("b", "junk", 0), ("c", '{"usage": {"input_tokens": 0, "output_tokens": 1.5}, "modelUsage": {"x-1": {}}, "total_cost_usd": 0.5}', 0), ("d", "{}", 3), ("e", '{"usage": {"new": 1}, "total_cost_usd": "inf", "num_turns": -2}', 0)], "id string, payload string, returncode int")
    got = {r.id: r for r in runs.run_rows(records).collect()}
    assert [got[x].run_status for x in "abcde"] == ["rate_limited", "parse_fail", "ok", "infra_error", "ok"]
    assert (got["c"].input_tokens, got["c"].output_tokens, got["c"].cache_read_tokens, got["c"].model_resolved, got["c"].cost_usd) == (0, None, None, "x-1", 0.5)
    assert [got[x].usage_drifted for x in "abcde"] == [False, False, False, False, True] and (got["e"].cost_usd, got["e"].num_turns) == (0.0, 0)
    assert mapped(spark, RE.server_name, "srv: http://x", "plugin:a:b: cmd", "two words: x", "none") == ["srv", "plugin:a:b", None, None]
    assert mapped(spark, RE.slug, " A b/ç ") == ["a-b"]


def test_leaks_are_found_at_any_depth(spark):
    one = spark.range(1).select(
        F.lit('{"a": ["x/home/y"], "/home": 1}').alias("j"), F.create_map(F.lit("k"), F.array(F.lit("/home/z"))).alias("m"), F.struct(F.struct(F.lit("fine").alias("t")).alias("s")).alias("ok"), F.lit(None).cast("map<string,string>").alias("null_map"),
        F.lit('{"path": "\\/home\\u002f"}').alias("escaped"), F.lit("x" * 30).alias("long"),
    )
    assert sorted((r.field, r.value) for r in sanitize.violations(one, ("/home",), 20).collect()) == [("escaped", "/home/"), ("j", "/home"), ("j", "x/home/y"), ("long", "x" * 30), ("m", "/home/z")]
    with pytest.raises(ValueError):
        sanitize.require_tasks(rows(spark, {"task_id": "foreign"}), ("t",))
    with pytest.raises(ValueError):
        sanitize.only_tasks(rows(spark, {}), ("other",))


def test_specs(spark, tmp_path):
    tasks = tmp_path / "tasks"
    tasks.mkdir()
    (tasks / "b.yaml").write_text("id: b\ndomain: d\ngrader: g\nmode: agent\ntools: [Read]\ngold: {x: 1}\n")
    (tasks / "a.yaml").write_text("id: a\ndomain: d\ngrader: g\nmode: single\ntimeout_s: 5\n")
    got = specs.read_tasks(spark, str(tasks), ("Read", "Edit")).collect()
    assert [(r.task_id, r.tools, r.gold, r.timeout_s) for r in got] == [("a", None, None, 5.0), ("b", ["Read"], '{"x": 1}', None)]
    for bad in ("domain: d\n", "id: x\ndomain: d\ngrader: g\nmode: odd\n", "id: x\ndomain: d\ngrader: g\nmode: single\ntools: Read\n", "id: x\ndomain: d\ngrader: g\nmode: single\ntools: [Fly]\n"):
        (tmp_path / "bad.yaml").write_text(bad)
        with pytest.raises(ValueError):
            specs.read_tasks(spark, str(tmp_path / "bad.yaml"), ("Read",))
    (tmp_path / "grid.yaml").write_text("models: [m, haiku]\nefforts: [low, high]\nepochs: 2\neffort_support: {m: [high]}\n")
    grid = specs.read_grid(spark, str(tmp_path / "grid.yaml"))
    assert grid["epochs"] == 2 and [r.variant for r in grid["variants"].collect()] == ["none"] and grid["support"].count() == 1
    (tmp_path / "grid.yaml").write_text("models: []\nefforts: [low]\n")
    with pytest.raises(ValueError):
        specs.read_grid(spark, str(tmp_path / "grid.yaml"))
    (tmp_path / "files.json").write_text('{"a.py": 3}')
    assert specs.read_registry(spark, str(tmp_path / "files.json"), "path", "n_lines").first() == ("a.py", 3)
    (tmp_path / "expected.json").write_text('{"items": [{"id": 1}], "fence_anchor": "#"}')
    assert specs.read_rubric(spark, str(tmp_path / "expected.json"))["window"] == 200
    assert specs.holdout_path({"holdout": "p"}, "d") == "p" and specs.holdout_path(None, "d") == "d"
    spark.createDataFrame([("x", 1)], "text string, label int").write.parquet(str(tmp_path / "h"))
    assert specs.read_holdout(spark, str(tmp_path / "h")).first() == ("x", 1)
    with pytest.raises(FileNotFoundError):
        specs.read_holdout(spark, str(tmp_path / "none"))


def test_outputs_and_artifacts(spark, tmp_path):
    table = spark.createDataFrame([("r1", "out"), ("r2", None)], "run_id string, output string")
    assert outputs.read_outputs(spark, str(tmp_path / "none")).count() == 0
    outputs.write_outputs(table, str(tmp_path / "o"))
    assert {r.run_id: r.output for r in outputs.with_outputs(spark.createDataFrame([("r1",), ("r3",)], "run_id string"), outputs.read_outputs(spark, str(tmp_path / "o"))).collect()} == {"r1": "out", "r3": None}
    for name, text in (("w/a/plan.md", "old"), ("w/b/plan.md", "new"), ("outputs/r1.txt", "first")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    wanted = spark.createDataFrame([("r1", "a/plan.md", datetime.datetime(2000, 1, 1)), ("r2", "c/plan.md", datetime.datetime(2000, 1, 1)), ("r3", "no.md", datetime.datetime(2000, 1, 1)), ("r4", "plan.md", datetime.datetime(2100, 1, 1))], "run_id string, artifact string, since timestamp")
    got = {r.run_id: (r.content, r.missing) for r in outputs.captured(wanted, outputs.artifacts(spark, str(tmp_path / "w"))).collect()}
    assert got["r1"] == ("old", False) and got["r2"][0] in ("old", "new") and got["r3"] == got["r4"] == ("", True)
    named = outputs.read_files(spark, spark.createDataFrame([("r1.txt",), ("gone.txt",)], "output_path string"), str(tmp_path / "outputs"))
    assert {r.output_path: r.output for r in named.collect()} == {"r1.txt": "first", "gone.txt": None}


def test_ledger_lines_and_json_columns(spark, tmp_path):
    one = tmp_path / "l.jsonl"
    one.write_text('{"task_id": "a", "subscores": {"x": 0.5}, "tool_calls": {}}\n\n{"task_id": "b"}\n{"task_id": "c')
    with pytest.warns(UserWarning, match="cut short"):
        read = ledger.read_ledger_checked(spark, str(one))
    got = {r.task_id: r for r in ledger.decoded(read).collect()}
    assert got["a"].subscores == {"x": 0.5} and got["a"].tool_calls == {} and got["b"].tool_calls is None
    one.write_text('{"task_id": "a"}\n\n{"bad\n{"task_id": "c"}\n')
    with pytest.raises(ValueError, match="line 3"):
        ledger.read_ledger_checked(spark, str(one))
    maps = spark.range(1).select(F.create_map(F.lit("b"), F.lit(1.0), F.lit("a"), F.lit(2.0)).alias("subscores"), F.lit(None).cast("map<string,bigint>").alias("tool_calls"), F.lit(1.5).alias("details"))
    assert tuple(ledger.encoded(maps).first()) == ('{"a":2.0,"b":1.0}', None, "1.5")


def test_sampled_sign_flip_equals_plain_draws(spark):
    from gaugeloom.functions.stats import sign_flip_p

    n = 150
    d = [0.1 * (1 + i % 4) * (1 if i % 5 else -1) * (1 if i % 3 else -1) for i in range(n)]
    got = spark.createDataFrame([(d,)], "d array<double>").select(sign_flip_p("d", 300)).first()[0]
    bits = lambda m: "".join(f"{int(hashlib.md5(f'42:{m}:{k}'.encode()).hexdigest(), 16):0128b}" for k in range(2))
    sums = [abs(sum(x if b == "1" else -x for x, b in zip(d, bits(m)))) for m in range(1, 301)]
    assert 0 < got < 1 and got == sum(s >= abs(sum(d)) - n * 1e-12 for s in sums) / 300


def test_sign_flips_of_many_differences_are_exact(spark):
    import itertools
    import time

    from gaugeloom.functions.stats import sign_flip_p

    lists = [[0.3], [0.0, 0.0], [], [1.0, -1.0], [0.1, 0.2, 0.3], [0.5, 0.0, -0.25, None], [0.1 * (i % 7 - 2) for i in range(17)], [((i * 37) % 19 - 7) / 16 for i in range(18)], None]

    def plain(d):
        d = [x for x in d or [] if x]
        reach = abs(sum(d)) - len(d) * 1e-12
        return sum(abs(sum(x * s for x, s in zip(d, signs))) >= reach for signs in itertools.product((1, -1), repeat=len(d))) / 2 ** len(d) if d else None

    got = [r.p for r in spark.createDataFrame([(i, d) for i, d in enumerate(lists)], "i int, d array<double>").select("i", sign_flip_p("d").alias("p")).orderBy("i").collect()]
    assert got == [plain(d) for d in lists]
    began = time.time()
    d = [1.0] * 30 + [-1.0] * 8  # 38 equal steps: a binomial law
    p = spark.createDataFrame([(d,)], "d array<double>").select(sign_flip_p("d")).first()[0]
    assert p == pytest.approx(2 * sum(math.comb(38, k) for k in range(30, 39)) / 2**38) and time.time() - began < 60


def test_specs_have_one_form(spark):
    gold = ['{"a": 1, "b": [2]}', '{"b":[2],"a":1}', '{"a": 1}', None]
    made = [spark.range(1).select(TX.spec_fingerprint(F.lit('say "hi"'), F.lit(None).cast("string"), F.lit(g).cast("string"), F.array(*map(F.lit, t)))).first()[0] for g in gold for t in (("x", "y"), ("y", "x"))]
    assert made[0] == made[1] == made[2] == made[3] and len(set(made)) == 3 and len(made[0]) == 16


def test_duplicate_keys_and_effort_order(spark):
    from gaugeloom.operators.dedupe import duplicates

    r = rows(spark, {"task_id": "a"}, {"task_id": "a"}, {"task_id": "b"})
    assert [tuple(x) for x in duplicates(r, ("task_id",)).collect()] == [("a", 2)]
    named = spark.createDataFrame([(x,) for x in ("zeal", "high", "low", "apt")], "e string")
    assert [x.e for x in named.orderBy(frontier.effort_order(F.col("e"), ("low", "high"))).collect()] == ["low", "high", "apt", "zeal"]
    assert [x.task_id for x in cells.ordered(cells.aggregate(rows(spark, {"task_id": "b"}, {"task_id": "a", "model": "x", "value": 0.1}, {"task_id": "a"}))).collect()] == ["a", "a", "b"]
    assert [x.task_id for x in paired.ordered(paired.compare(rows(spark, *({"task_id": t, "variant": v} for t in "ba" for v in "xy")), "x", "y")).collect()] == ["a", "b"]
