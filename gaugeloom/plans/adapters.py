"""Views of the driver's tables as ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns that part rows of one run and time.
TIES = ("tie_part", "tie_supplier", "tie_price")


def orders_ledger(spark: SparkSession, sf_dir: str, measured: bool = False) -> DataFrame:
    """``lineitem`` joined to ``orders`` as a ledger; statuses and missing tokens derive from keys. ``measured``: no tokens are missing."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    rows = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    part, supplier = F.col("l_partkey"), F.col("l_suppkey")
    grade = F.when(part % 13 == 0, "unparseable").when(part % 13 == 1, "grader_error").otherwise("ok")
    return rows.select(
        F.col("o_orderpriority").alias("task_id"), F.col("l_returnflag").alias("model"), F.col("l_linestatus").alias("effort"), F.col("o_orderstatus").alias("variant"),
        F.concat_ws(":", "l_orderkey", "l_linenumber").alias("run_id"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("ts"), F.concat(F.lit("v"), (supplier % 3).cast("string")).alias("grader_version"),
        F.when(part % 11 == 0, "infra_error").when(part % 11 == 1, "timeout").otherwise("ok").alias("run_status"), grade.alias("grade_status"),
        F.when(grade == "ok", F.col("l_discount") * 10).otherwise(0.0).alias("value"), F.col("l_extendedprice").alias("cost_usd"), F.col("l_quantity").alias("latency_s"),
        F.when(F.lit(measured) | (supplier % 17 != 0), F.col("l_quantity").cast("long") * 10).alias("input_tokens"), F.floor(F.col("l_extendedprice") / 100).cast("long").alias("output_tokens"),
        F.when(F.lit(measured) | (supplier % 19 != 0), part % 100).alias("cache_read_tokens"), supplier.alias("cache_creation_tokens"), F.concat(F.lit("s"), (supplier % 2).cast("string")).alias("spec_sha"),
        F.to_json(F.struct((F.lit(0.5) + (part % 7).cast("double") / 100).alias("shuffled_auroc"))).alias("subscores"),
        part.alias("tie_part"), supplier.alias("tie_supplier"), F.col("l_extendedprice").alias("tie_price"),
    )


#: The same in DuckDB's SQL, with the latest grades, cells and dropped runs on top.
LEDGER_SQL = """
WITH ledger AS (
  SELECT o_orderpriority AS task_id, l_returnflag AS model, l_linestatus AS effort, o_orderstatus AS variant, l_orderkey || ':' || l_linenumber AS run_id,
    strftime(l_shipdate, '%Y-%m-%d') AS ts, 'v' || (l_suppkey % 3) AS grader_version,
    CASE WHEN l_partkey % 11 = 0 THEN 'infra_error' WHEN l_partkey % 11 = 1 THEN 'timeout' ELSE 'ok' END AS run_status,
    CASE WHEN l_partkey % 13 = 0 THEN 'unparseable' WHEN l_partkey % 13 = 1 THEN 'grader_error' ELSE 'ok' END AS grade_status,
    CASE WHEN l_partkey % 13 > 1 THEN l_discount * 10 ELSE 0.0 END::DOUBLE AS value, l_extendedprice AS cost_usd, l_quantity AS latency_s,
    CASE WHEN l_suppkey % 17 <> 0 THEN l_quantity::BIGINT * 10 END AS input_tokens, floor(l_extendedprice / 100)::BIGINT AS output_tokens,
    CASE WHEN l_suppkey % 19 <> 0 THEN l_partkey % 100 END AS cache_read_tokens, l_suppkey AS cache_creation_tokens, 's' || (l_suppkey % 2) AS spec_sha,
    0.5 + (l_partkey % 7)::DOUBLE / 100 AS shuffled, l_partkey AS tie_part, l_suppkey AS tie_supplier, l_extendedprice AS tie_price
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
), grades AS (
  SELECT * FROM (SELECT * FROM ledger WHERE run_status = 'ok'
    QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY ts DESC NULLS LAST, grader_version DESC NULLS LAST, tie_part DESC, tie_supplier DESC, tie_price DESC) = 1)
  WHERE grade_status IN ('ok', 'unparseable')
), cells AS (
  SELECT task_id, model, effort, variant, count(*) AS n_epochs, avg(value) AS mean_value, stddev_samp(value) AS std_value, avg(cost_usd) AS mean_cost, avg(latency_s) AS mean_latency,
    count(DISTINCT spec_sha) AS n_spec, count(DISTINCT grader_version) AS n_grader_versions, count(*) FILTER (grade_status = 'unparseable') AS n_unparseable,
    avg(output_tokens) AS mean_output_tokens, count(output_tokens) AS n_token_epochs,
    avg(input_tokens + output_tokens + cache_read_tokens + cache_creation_tokens) AS mean_total_tokens, count(input_tokens + output_tokens + cache_read_tokens + cache_creation_tokens) AS n_total_token_epochs,
    avg(shuffled) AS mean_shuffled_auroc, max(abs(shuffled - 0.5)) > 0.05 AS leakage
  FROM grades GROUP BY ALL
), dropped AS (
  SELECT task_id, model, effort, variant, count(DISTINCT run_id) AS n_dropped FROM ledger WHERE run_status <> 'ok' GROUP BY ALL
)
"""

#: The same, with no tokens missing.
MEASURED_SQL = LEDGER_SQL.replace("CASE WHEN l_suppkey % 17 <> 0 THEN l_quantity::BIGINT * 10 END", "l_quantity::BIGINT * 10").replace("CASE WHEN l_suppkey % 19 <> 0 THEN l_partkey % 100 END", "l_partkey % 100")


def event_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as runs of (user, type): errors by id, a grade by the key in ``props``."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.get_json_object("props", "$.k").cast("long")
    return events.select(
        F.concat_ws(":", "user_id", "event_type").alias("run_id"), "user_id", "event_type", "event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"),
        F.when(F.col("event_id") % 3 == 0, "infra_error").when(F.col("event_id") % 7 == 0, "timeout").otherwise("ok").alias("run_status"),
        F.when(k < 10, "grader_error").when(k < 20, "unparseable").otherwise("ok").alias("grade_status"), F.lit("v1").alias("grader_version"), k.alias("k"), F.col("value"),
    )


EVENT_SQL = """
WITH runs AS (
  SELECT user_id || ':' || event_type AS run_id, user_id, event_type, event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts,
    CASE WHEN event_id % 3 = 0 THEN 'infra_error' WHEN event_id % 7 = 0 THEN 'timeout' ELSE 'ok' END AS run_status,
    CASE WHEN k < 10 THEN 'grader_error' WHEN k < 20 THEN 'unparseable' ELSE 'ok' END AS grade_status, k, value
  FROM (SELECT *, json_extract_string(props, '$.k')::BIGINT AS k FROM events)
)
"""
