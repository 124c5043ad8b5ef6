"""The ledger's own data source against the checked reader, with damage at the edges of ranges."""

import io
import json
import re

import pytest

from gaugeloom.schema import LEDGER
from gaugeloom.sources import datasource, ledger


@pytest.fixture(scope="module")
def load(spark):
    name = datasource.register(spark)
    return lambda path, split=1 << 20: spark.read.format(name).option("splitBytes", split).load(str(path))


LINES = [
    {"task_id": "a", "run_id": "1", "run_status": "ok", "value": 1, "epoch": 3, "subscores": {"x": 1.5, "y": [1, None]}, "mcp_servers": ["m", 2]}, {"task_id": "b", "run_status": "timeout", "value": 0.25, "cost_usd": "NaN", "latency_s": "-Infinity"},
    {"run_status": None, "task_id": "é ü", "details": "text", "unknown": {"z": 1}}, {"task_id": "a", "run_status": "ok", "tool_calls": {"Read": 2}, "output_preview": "x" * 300}, {},
]


def rows(frame):
    return sorted(map(str, frame.collect()))


@pytest.mark.parametrize("split", [1, 7, 64, 1000, 1 << 20])
def test_ranges_give_each_line_once(spark, load, tmp_path, split):
    folder = tmp_path / "l"
    folder.mkdir()
    (folder / "a.json").write_text("\n\n".join(json.dumps(x, ensure_ascii=False) for x in LINES), "utf-8")
    (folder / "b.json").write_text("".join(json.dumps(x) + "\r\n" for x in LINES[:2]) + '  \n{"task_id": "cut', "utf-8")
    (folder / "empty.json").write_text("")
    (folder / "_SUCCESS").write_text("no ledger")
    got = load(folder, split)
    assert got.schema == LEDGER and rows(got) == rows(ledger.read_ledger_checked(spark, str(folder)))
    assert got.count() == 7


@pytest.mark.parametrize("bad", ["{", "[1]", "7", '{"value": "x"}', '{"epoch": 1.5}', '{"mcp_servers": 3}'])
@pytest.mark.parametrize("split", [5, 1 << 20])
def test_damage_within_a_file_is_an_error(spark, load, tmp_path, bad, split):
    path = tmp_path / "l.json"
    path.write_text('{"task_id": "a"}\n\n' + bad + '\n{"task_id": "b"}\n')
    with pytest.raises(Exception, match="line 3 of .*l.json is no JSON object"):
        load(path, split).collect()
    path.write_text('{"task_id": "a"}\n\n' + bad + "\n \n\n")
    assert [r.task_id for r in load(path, split).collect()] == ["a"]


def test_filters_are_tested_by_the_reader(spark, load, tmp_path):
    path = tmp_path / "l.json"
    path.write_text("".join(json.dumps({"run_status": s, "task_id": t, "epoch": e}) + "\n" for e, (s, t) in enumerate([("ok", "a"), ("ok", "b"), ("timeout", "a"), (None, "a"), ("ok", "c"), ("ok", None)])))
    found = load(path).filter("run_status = 'ok' and task_id in ('a', 'b') and epoch >= 1")
    assert [(r.task_id, r.epoch) for r in found.collect()] == [("b", 1)]
    reader = datasource.LedgerReader(LEDGER, {"path": str(path)})
    left = list(reader.pushFilters([datasource.EqualTo(("run_status",), "ok"), datasource.In(("task_id",), ("a", "b")), datasource.EqualTo(("epoch",), 1), datasource.EqualTo(("task_id",), "b")]))
    assert left == [datasource.EqualTo(("epoch",), 1)] and reader.wanted == {"run_status": {"ok"}, "task_id": {"b"}}
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 1
    condition = re.search(r"Filter (.*)", found._jdf.queryExecution().executedPlan().toString())[1]
    assert "epoch" in condition and "run_status" not in condition and "task_id" not in condition


def test_no_ledger_is_an_empty_one(spark, load, tmp_path):
    assert load(tmp_path / "none").count() == 0
    (tmp_path / "e").mkdir()
    assert load(tmp_path / "e").count() == 0


def test_lines_over_blocks(monkeypatch):
    data = b"ab\n\ncdefgh\nij"
    for block in (1, 2, 3, 100):
        monkeypatch.setattr(datasource, "_BLOCK", block)
        assert list(datasource.lines_from(io.BytesIO(data), 0)) == [(0, b"ab"), (3, b""), (4, b"cdefgh"), (11, b"ij")]
        assert list(datasource.lines_from(io.BytesIO(data), 2)) == [(2, b""), (3, b""), (4, b"cdefgh"), (11, b"ij")]
