"""The order of rows over several files, and appends that are done again."""

import json

import pytest

from gaugeloom.operators.dedupe import latest_ok
from gaugeloom.schema import LEDGER
from gaugeloom.sources import ledger


def _line(i, run="r", **more):
    return json.dumps({"task_id": "t", "run_id": run, "run_status": "ok", "epoch": i, "details": {"pad": "x" * (i % 50)}} | more)


@pytest.mark.parametrize("sizes", [(2, 400, 30), (400, 2, 90), (1, 1, 900)])
@pytest.mark.parametrize("most", ["1k", "7k", "128m"])
def test_the_last_row_in_file_order_counts_in_any_plan(spark, tmp_path, sizes, most):
    i = 0
    for part, n in enumerate(sizes):
        with open(tmp_path / f"part-{part}.json", "w") as f:
            for _ in range(n):
                f.write(_line(i, f"r{i % 7}") + "\n")
                i += 1
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", most)
        spark.conf.set("spark.sql.files.openCostInBytes", "64")
        rows = ledger.read_sequenced(spark, str(tmp_path))
        assert [r.epoch for r in rows.orderBy("seq").collect()] == list(range(i))
        assert {r.run_id: r.epoch for r in latest_ok(rows, ("run_id",)).collect()} == {f"r{k}": max(x for x in range(i) if x % 7 == k) for k in range(min(7, i))}
        (tmp_path / "part-1.json").write_text("\n".join([_line(x) for x in range(sizes[1])] + ["{broken", _line(1)]) + "\n")
        with pytest.raises(ValueError, match=f"line {sizes[1] + 1} of .*part-1"):
            ledger.read_ledger_checked(spark, str(tmp_path))
        (tmp_path / "part-1.json").write_text("\n".join([_line(x) for x in range(sizes[1])] + ["{broken"]))
        with pytest.warns(UserWarning, match="part-1"):
            assert ledger.read_ledger_checked(spark, str(tmp_path)).count() == sum(sizes)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_appends_by_time(spark, tmp_path):
    import os

    for name, when in (("b.json", 1_000_000), ("a.json", 2_000_000)):
        (tmp_path / name).write_text(_line(when) + "\n")
        os.utime(tmp_path / name, (when, when))
    rows = ledger.read_sequenced(spark, str(tmp_path), by_time=True)
    assert latest_ok(rows, ("run_id",)).first().epoch == 2_000_000 and latest_ok(ledger.read_sequenced(spark, str(tmp_path)), ("run_id",)).first().epoch == 1_000_000


def test_an_append_done_again_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "ledger")
    make = lambda keys: spark.createDataFrame([tuple({"run_id": r, "grader_version": v, "ts": t, "epoch": 1}.get(c) for c in LEDGER.names) for r, v, t in keys], LEDGER)
    first = [("a", "v", "1"), ("b", None, "1"), ("c", "v", None)]
    for keys in (first[:2], first, first, [], [*first, ("a", "w", "1"), ("a", "w", "1")]):
        ledger.append_new(make(keys), path)
    got = sorted(((r.run_id, r.grader_version, r.ts) for r in ledger.read_ledger(spark, path).collect()), key=str)
    assert got == sorted([*first, ("a", "w", "1")], key=str)
    assert ledger.read_sequenced(spark, str(tmp_path / "none")).count() == 0
