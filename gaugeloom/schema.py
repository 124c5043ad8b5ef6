"""The ledger: one row for each graded run. Null means not measured, never zero."""

from __future__ import annotations

from pyspark.sql import types as T

# Names and types of the ledger's columns, its statuses and efforts.
LEDGER = (
    T.StructType()
    .add("task_id", "string").add("model", "string").add("effort", "string").add("variant", "string").add("epoch", "long")
    .add("grader_version", "string").add("run_id", "string").add("run_status", "string").add("cost_usd", "double").add("latency_s", "double")
    .add("returncode", "long").add("model_resolved", "string").add("num_turns", "long")
    .add("grade_status", "string").add("value", "double").add("session_id", "string").add("spec_sha", "string").add("subscores", "string").add("details", "string")
    .add("output_path", "string").add("output_preview", "string").add("transcript_path", "string").add("ts", "string")
    .add("claude_version", "string").add("harness_sha", "string").add("infra_repo", "string").add("infra_sha", "string").add("global_layer", "string")
    .add("mcp_servers", T.ArrayType(T.StringType())).add("tool_calls", "string")
    .add("input_tokens", "long").add("output_tokens", "long").add("cache_read_tokens", "long").add("cache_creation_tokens", "long")
)
RUN_STATUSES = ("ok", "rate_limited", "infra_error", "timeout", "parse_fail")
GRADE_STATUSES = ("ok", "unparseable", "grader_error")
DEFINITIVE = ("ok", "unparseable")
EFFORTS = ("low", "medium", "high", "xhigh", "max")

RUN_KEY = ("task_id", "model", "effort", "variant", "epoch")
LEDGER_KEY = (*RUN_KEY, "grader_version")
CELL = ("task_id", "model", "effort", "variant")
CONFIG = ("task_id", "model", "effort")
GROUP = ("task_id", "variant")
TOKENS = ("input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens")
