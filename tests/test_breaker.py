"""The breaker's summaries of pieces, folded, against a walk over each sequence."""

import random

import pytest

from gaugeloom.operators import runs

SCHEMA = "user long, at long, run_status string, n_runs string"
STATUSES = ["ok", "timeout", "infra_error", "parse_fail", None]


def walked(rows, limit):
    out = {}
    for user, at, status, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1])):
        n, streak, longest, halt = out.get(user, (0, 0, 0, None))
        streak = 0 if status == "ok" else streak + (status in runs.FAILURES)
        n += 1
        out[user] = (n, streak, max(longest, streak), n if halt is None and streak >= limit else halt)
    return {user: (n, longest, halt) for user, (n, _, longest, halt) in out.items()}


@pytest.mark.parametrize("pieces", [None, 1, 3, 16])
def test_pieces_fold_to_the_walk(spark, pieces):
    rng = random.Random(pieces)
    rows = []
    for user in [None, *range(12)]:
        weights = [rng.choice((0.02, 0.1, 0.5)), 1, 1, 1, 0.3]
        rows += [(user, i, rng.choices(STATUSES, weights)[0], "x") for i in range(400 if user == 3 else rng.randrange(1, 30))]
    rows += [(99, i, "timeout", "x") for i in range(300)]  # one streak over many pieces
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, SCHEMA)
    for limit in (1, 5, 40):
        got = {r.user: (r.n_runs, r.longest, r.halt_at) for r in runs.breaker(frame, ("user",), ("at",), limit, pieces).collect()}
        assert got == walked(rows, limit)


def test_one_sequence_is_many_pieces(spark):
    rows = spark.range(5000).selectExpr("7L AS user", "id AS at", "if(id % 50 = 49, 'ok', 'timeout') AS run_status")
    assert runs.piece_summaries(rows, ("user",), ("at",), 60, 8).count() == 8
    assert tuple(runs.breaker(rows, ("user",), ("at",), 60, 8).first()) == (7, 5000, 49, None)
    assert runs.breaker(rows.limit(0), ("user",), ("at",)).count() == 0
    with pytest.raises(ValueError):
        runs.breaker(rows, ("user",), ("at",), 0)
