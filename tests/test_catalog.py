"""Every query of the catalog against its SQL in DuckDB."""

import hashlib
import itertools
import math

import duckdb
import pytest

from gaugeloom import catalog
from gaugeloom.functions.stats import bootstrap_means, percentile_interval

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages labels conversations".split()


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "null"
    return f"{value:.4f}" if isinstance(value, float) else str(value)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_its_sql(spark, duck, name):
    got = catalog.queries()[name](spark, SF)
    found = duck.execute(catalog.oracle_sql()[name])
    columns = sorted(d[0] for d in found.description)
    assert sorted(got.columns) == columns
    names = [d[0] for d in found.description]
    expected = sorted(tuple(plain(dict(zip(names, row))[c]) for c in columns) for row in found.fetchall())
    assert sorted(tuple(plain(row[c]) for c in columns) for row in got.collect()) == expected
    assert expected


def test_intervals_of_any_number_of_grades(spark):
    grades = {0: [], 1: [0.5], 2: [0.25, 0.5], 3: [0.1, 0.2, 0.9], 6: [0.1, 0.2, 0.3, 0.5, 0.8, 0.9], 9: [x / 8 for x in range(9)]}

    def interval(v):
        n = len(v)
        if n < 3:
            return None, None
        if n <= 5:
            means = sorted(sum(r) / n for r in itertools.product(v, repeat=n))
        else:
            pick = lambda m, i: math.floor(int(hashlib.md5(f"42:{m}:{i}".encode()).hexdigest()[:8], 16) / 4294967296 * n)
            means = sorted(sum(v[pick(m, i)] for i in range(n)) / n for m in range(1, 2001))
        return tuple(means[max(1, math.ceil(len(means) * q - 1e-9)) - 1] for q in (0.025, 0.975))

    low, high = percentile_interval(bootstrap_means("v"))
    frame = spark.createDataFrame(list(grades.items()), "n long, v array<double>").select("n", low.alias("low"), high.alias("high"))
    assert {r.n: (r.low, r.high) for r in frame.collect()} == {k: tuple(x if x is None else pytest.approx(x) for x in interval(v)) for k, v in grades.items()}


def test_interval_query_has_a_row_for_every_graded_user(spark):
    sf = SF.replace("0.001", "0.01")
    got = catalog.epoch_interval(spark, sf)
    assert got.count() == 150 and got.filter("low is null and high is null").count() == 3
