"""The stream of a ledger keeps the state that the batch form has."""

import shutil
from pathlib import Path

from gaugeloom.operators.dedupe import latest_grade
from gaugeloom.sources import ledger
from gaugeloom.streaming.ledger import compact, latest_state, newest_rows, stream_latest
from tests.test_semantics import rows


def replay(spark, source, table, check, **more):
    query = stream_latest(spark, source, table, check, **more).trigger(availableNow=True).start()
    query.awaitTermination(90)
    query.stop()


def values(found):
    return {r.run_id: r.value for r in found.collect()}


def folders(table):
    return sorted(p.name for p in Path(table).iterdir() if "=" in p.name)


def test_stream_agrees_with_batch(spark, tmp_path):
    source, table, check = (str(tmp_path / x) for x in ("in", "state", "check"))
    assert latest_state(spark, table).count() == 0
    first = rows(spark, {"run_id": "a", "value": 0.1}, {"run_id": "b"}, {"run_id": "c", "run_status": "timeout"}, {"run_id": "e", "ts": None})
    second = rows(spark, {"run_id": "a", "value": 0.9, "ts": "2026-01-02"}, {"run_id": "b", "grade_status": "grader_error", "ts": "2026-01-03"}, {"run_id": "d"}, {"run_id": "e", "value": 0.3})
    for part in (first, second):
        ledger.append_ledger(part.coalesce(1), source)
        replay(spark, source, table, check)
    expected = values(latest_grade(first.unionByName(second)))
    assert values(latest_state(spark, table)) == expected == {"a": 0.9, "d": 0.8, "e": 0.3}
    # a batch writes what it changes
    changed = [spark.read.parquet(f"{table}/{name}").count() for name in folders(table)]
    assert changed == [3, 4] and newest_rows(spark, table).count() == 4

    # a batch lost midway is not seen, and one whose commit is lost is done again and gives the same
    last = folders(table)[-1]
    (Path(table) / last / "_SUCCESS").unlink()
    assert values(latest_state(spark, table)) == values(latest_grade(first))
    for commit in (Path(check) / "commits").glob("*" + last.split("=")[1] + "*"):
        commit.unlink()
    replay(spark, source, table, check)
    assert values(latest_state(spark, table)) == expected and folders(table)[-1] == last

    # compaction changes nothing, and deletes what a base stands for only when it runs again
    compact(spark, table)
    assert values(latest_state(spark, table)) == expected and len(folders(table)) == 3
    compact(spark, table)
    assert values(latest_state(spark, table)) == expected and [f.split("=")[0] for f in folders(table)] == ["base"]
    ledger.append_ledger(rows(spark, {"run_id": "a", "value": 0.2, "ts": "2026-01-09"}).coalesce(1), source)
    replay(spark, source, table, check)
    assert values(latest_state(spark, table)) == expected | {"a": 0.2}


def test_a_late_older_grade_and_a_lost_base(spark, tmp_path):
    source, table, check = (str(tmp_path / x) for x in ("in", "state", "check"))
    for part in ({"run_id": "a", "ts": "2026-01-05", "value": 0.5}, {"run_id": "a", "ts": "2026-01-01", "value": 0.1}, {"run_id": "b", "value": 0.7}):
        ledger.append_ledger(rows(spark, part).coalesce(1), source)
    replay(spark, source, table, check, files_per_batch=1)
    assert len(folders(table)) == 3 and values(latest_state(spark, table)) == {"a": 0.5, "b": 0.7}
    base = Path(table) / "base=2"
    shutil.copytree(Path(table) / "batch=0", base)  # a base that broke off
    (base / "_SUCCESS").unlink()
    compact(spark, table)
    compact(spark, table)
    assert folders(table) == ["base=2"] and values(latest_state(spark, table)) == {"a": 0.5, "b": 0.7}
