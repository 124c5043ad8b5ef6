"""Bootstrap intervals of means of any number of rows, from sums that add up.

Rows are dealt to buckets by a hash of what is resampled (a run), and a resample gives each bucket a Poisson weight, so it
is a sum over buckets: partial sums of a group's buckets are all that is kept of its rows, and no list of rows is gathered.
A group has one estimator at every size. Where it has fewer rows than buckets, nearly each row is a bucket of its own, which is the
plain bootstrap; where it has more, rows are resampled in bundles, whose spread between them is that of their rows.

Weights come from hashes of the bucket and the number of the resample, so every engine draws the same ones. All resamples of a group
are one product of two matrices, weights by bucket and sums by bucket, which numpy forms in the task that holds the group's sums;
as rows they would be 127 for each bucket.
"""

from __future__ import annotations

import functools
import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS, RESAMPLES, LEAST = 1024, 200, 3
#: Distribution function of the Poisson law of mean 1, in 65536ths.
POISSON = (24109, 48219, 60273, 64291, 65296, 65497, 65530, 65535)
ENDS = {"low": 0.025, "high": 0.975}


def bucket_of(unit: Column, buckets: int = BUCKETS) -> Column:
    """The bucket of a unit that is resampled; null is a unit like others."""
    return (F.conv(F.substring(F.md5(F.coalesce(unit.cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long") % buckets).cast("int")


@functools.lru_cache(2)
def weights(buckets: int, resamples: int) -> np.ndarray:
    """The weights of each bucket (a row) in each resample; eight are read off each hash."""
    digests = b"".join(hashlib.md5(f"42:{bucket}:{k}".encode()).digest() for bucket in range(buckets) for k in range((resamples + 7) // 8))
    drawn = np.searchsorted(POISSON, np.frombuffer(digests, ">u2"), side="right").reshape(buckets, -1)
    return drawn[:, :resamples].astype(np.uint8)


def interval_of(parts: str, names: tuple[str, ...], buckets: int = BUCKETS, resamples: int = RESAMPLES, least: int = LEAST) -> Column:
    """A struct of ``{name}_low`` and ``{name}_high`` from a group's sums by bucket, an array of structs of bucket, sum and count of each name (``s_``, ``k_``).

    Bounds are by the inverse of the distribution function, and null where a name has fewer than ``least`` values. An array has at most ``buckets`` entries.
    """
    ends = [f"{name}_{end}" for name in names for end in ENDS]
    table, quantiles = weights(buckets, resamples), tuple(ENDS.values())  # go along with the function: 200 kB

    def of_groups(groups: pa.Array) -> pa.Array:
        begin, flat = groups.offsets.to_numpy(), groups.values
        column = lambda c: flat.field(c).fill_null(0).to_numpy(zero_copy_only=False)
        bucket, sums, counts = column("bucket"), np.stack([column(f"s_{n}") for n in names], 1).astype(float), np.stack([column(f"k_{n}") for n in names], 1).astype(float)
        found = np.full((len(groups), len(names), len(quantiles)), np.nan)
        for g in range(len(groups)):
            rows = slice(begin[g], begin[g + 1])
            w = table[bucket[rows]].T.astype(float)
            with np.errstate(invalid="ignore", divide="ignore"):
                means = np.sort((w @ sums[rows]) / (w @ counts[rows]), axis=0)  # without a value: not a number, at the end
            n = (~np.isnan(means)).sum(axis=0)
            for e, at in enumerate(quantiles):
                place = np.maximum(1, np.ceil(n * at - 1e-9)).astype(int) - 1
                found[g, :, e] = means[place, np.arange(len(names))]
            found[g, counts[rows].sum(axis=0) < least] = np.nan
        return pa.StructArray.from_arrays([pa.array(found[:, i, e], from_pandas=True) for i in range(len(names)) for e in range(len(quantiles))], ends)

    return F.arrow_udf(of_groups, ", ".join(f"{name} double" for name in ends))(parts)


@functools.lru_cache(4096)
def _drawn(place: int, draws: int) -> np.ndarray:
    """Numbers in [0, 1) of each draw for a place of a list."""
    return np.array([int(hashlib.md5(f"42:{m}:{place}".encode()).hexdigest()[:8], 16) for m in range(1, draws + 1)]) / 4294967296


def _all_resamples(lists: np.ndarray) -> np.ndarray:
    """The means of all n^n resamples of each row."""
    n = lists.shape[1]
    every = np.arange(n**n)
    return sum(lists[:, every // n**i % n] for i in range(n)) / n


def list_interval(values: str, draws: int = 2000, least: int = LEAST) -> Column:
    """A struct of low and high: bounds of the mean of a sorted array column by all n^n resamples (n up to 5), else by ``draws`` hashed ones; null under ``least`` values."""

    def of_lists(lists: pa.Array) -> pa.Array:
        begin, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
        size, found = np.diff(begin), np.full((len(lists), len(ENDS)), np.nan)

        def put(rows, means: np.ndarray) -> None:
            at = [max(1, math.ceil(means.shape[1] * q - 1e-9)) - 1 for q in ENDS.values()]
            found[rows] = np.partition(means, at, axis=1)[:, at]

        for n in np.unique(size[size >= least]).tolist():
            rows = np.flatnonzero(size == n)
            step = 256 if n <= 5 else 1
            for i in range(0, len(rows), step):
                some = rows[i : i + step]
                held = flat[begin[some][:, None] + np.arange(n)]
                put(some, _all_resamples(held) if n <= 5 else sum(held[:, (_drawn(k, draws) * n).astype(np.int64)] for k in range(n)) / n)
        return pa.StructArray.from_arrays([pa.array(found[:, e], from_pandas=True) for e in range(len(ENDS))], list(ENDS))

    return F.arrow_udf(of_lists, ", ".join(f"{name} double" for name in ENDS))(values)


def bootstrap_intervals(rows: DataFrame, by: tuple[str, ...], unit: str, measures: dict[str, str], buckets: int = BUCKETS, resamples: int = RESAMPLES, least: int = LEAST) -> DataFrame:
    """``by`` with ``{name}_low`` and ``{name}_high`` of the mean of each measure (name to column): a row for every group, null where a measure has fewer than ``least`` values."""
    dealt = rows.withColumn("bucket", bucket_of(F.col(unit), buckets))
    kept = [a for name, c in measures.items() for a in (F.sum(F.col(c).cast("double")).alias(f"s_{name}"), F.count(c).alias(f"k_{name}"))]
    groups = dealt.groupBy(*by, "bucket").agg(*kept).groupBy(*by).agg(F.collect_list(F.struct("bucket", *(f"{kind}_{name}" for name in measures for kind in "sk"))).alias("parts"))
    return groups.select(*by, interval_of("parts", tuple(measures), buckets, resamples, least).alias("i")).select(*by, "i.*")
