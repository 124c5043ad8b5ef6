"""Intervals of few grades are by every resample, not by some."""

from __future__ import annotations

import hashlib
import itertools
import math

from gaugeloom import catalog


def test_interval_of_a_user_is_by_all_resamples(spark, tmp_path):
    values = {1: [0.5, 2.0, 7.25], 2: [1.0, 1.5, 4.0, 9.75], 3: [0.125, 3.0, 3.5, 8.0, 20.0], 4: [1.0, 2.0], 5: [0.5, 1.0, 1.5, 4.0, 6.0, 7.0, 9.5]}
    ids = (e for e in itertools.count(1) if e % 3 and e % 7)  # others stand for runs that failed
    rows = [(next(ids), u, f"type{i}", v) for u, vs in values.items() for i, v in enumerate(vs)]
    table = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").selectExpr("*", "timestamp'2024-01-01' as ts", "'{\"k\": 50}' as props")
    table.write.parquet(str(tmp_path / "events.parquet"))

    def ends(v):
        pick = lambda m, i: int(int(hashlib.md5(f"42:{m}:{i}".encode()).hexdigest()[:8], 16) / 4294967296 * len(v))
        resamples = itertools.product(v, repeat=len(v)) if len(v) <= 5 else ([v[pick(m, i)] for i in range(len(v))] for m in range(1, 2001))
        means = sorted(sum(x) / len(v) for x in resamples)
        return tuple(math.floor((means[max(1, math.ceil(len(means) * q - 1e-9)) - 1] + 1e-9) * 1e4 + 0.5) / 1e4 for q in (0.025, 0.975)) if len(v) > 2 else (None, None)

    assert {r.user_id: (r.low, r.high) for r in catalog.epoch_interval(spark, str(tmp_path)).collect()} == {u: ends(v) for u, v in values.items()}
