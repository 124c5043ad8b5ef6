"""Event streams of runs: the last result and the tools that were called, in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def called_tools(event: Column) -> Column:
    """Names of the tool_use blocks of an assistant event (a variant); blocks of any other form are passed over."""
    blocks = F.try_variant_get(event, "$.message.content", "array<variant>")
    named = F.filter(blocks, lambda b: (F.try_variant_get(b, "$.type", "string") == "tool_use") & (F.schema_of_variant(F.try_variant_get(b, "$.name", "variant")) == "STRING"))
    return F.transform(named, lambda b: F.try_variant_get(b, "$.name", "string"))


def parse_streams(lines: DataFrame, key: str, order: str, line: str) -> DataFrame:
    """(key, payload, tools) of every stream of JSON ``line``s: the last result event, null if there is none, and all called tools.

    Lines that are no JSON objects are passed over; a stream of such lines has a null payload and no tools.
    """
    event = lines.select(key, F.col(order).alias("at"), F.col(line).alias("line"), F.try_parse_json(F.trim(line)).alias("event"))
    kind = F.try_variant_get("event", "$.type", "string")
    typed = event.select(key, "at", F.when(kind == "result", F.trim("line")).alias("result"), F.when(kind == "assistant", called_tools(F.col("event"))).alias("called"))
    called = F.array_sort(F.collect_list(F.when(F.size("called") > 0, F.struct("at", "called"))))
    return typed.groupBy(key).agg(F.max_by("result", F.when(F.col("result").isNotNull(), F.col("at"))).alias("payload"), F.flatten(F.transform(called, lambda x: x["called"])).alias("tools"))
