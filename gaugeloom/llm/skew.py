"""Joins whose keys may be very uneven."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than this part of the rows counts as hot, so there are at most HOT_KEYS hot keys.
HOT_KEYS = 500


def lookup_join(rows: DataFrame, table: DataFrame, key: str, count: str, values: list[str], stored: bool = False) -> DataFrame:
    """Left join of many ``rows`` to a ``table`` with one row a ``key``; null where there is none.

    ``table[count]`` is how many rows have the key. Keys with more than 1/HOT_KEYS of all counted rows
    are fewer than HOT_KEYS, whatever the data, so those are broadcast, and their rows go through the
    other, hashed join under a random key that finds nothing: no task gets a key's worth of rows.
    The table is written to shared storage, since it is read three times, unless it is ``stored`` there already.
    """
    from .shared import written

    table = table.select(key, count, *values)
    table = table if stored else written(table, "lookup")
    total = table.agg(F.sum(count).alias("t")).first()["t"] or 0
    name = {v: f"_hot_{v}" for v in values}
    hot = table.filter(F.col(count) > total / HOT_KEYS).select(F.col(key).alias("_hot_key"), F.lit(True).alias("_hot"), *(F.col(v).alias(name[v]) for v in values))
    rows = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left")
    salted = F.when(F.col("_hot"), F.concat(F.lit("\x00hot"), F.xxhash64(*[c for c in rows.columns if not c.startswith("_hot") and rows.schema[c].dataType.typeName() in ("long", "string", "integer")]).cast("string"))).otherwise(F.col(key).cast("string"))
    rest = table.select(F.col(key).cast("string").alias("_cold_key"), *(F.col(v).alias(f"_cold_{v}") for v in values))
    joined = rows.withColumn("_salted", salted).join(rest, F.col("_salted") == F.col("_cold_key"), "left")
    drop = ["_hot_key", "_hot", "_salted", "_cold_key"]
    for v in values:
        joined = joined.withColumn(v, F.coalesce(name[v], f"_cold_{v}"))
        drop += [name[v], f"_cold_{v}"]
    return joined.drop(*drop)
