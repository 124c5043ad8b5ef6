"""What run records hold: usage, models, statuses and limits, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keys of a usage object and the columns they fill, and words of limits.
USAGE = {"input_tokens": "input_tokens", "output_tokens": "output_tokens", "cache_read_input_tokens": "cache_read_tokens", "cache_creation_input_tokens": "cache_creation_tokens"}
LIMIT_STATUSES, LIMIT_WORDS, HARD_LIMIT = (400, 429), ("usage limit", "rate limit"), "usage limit"
#: Seconds that a pause takes at most.
LONGEST_PAUSE = 60.0


def run_status(is_error: Column, api_status: Column, message: Column, returncode: Column) -> Column:
    """Status of a run: errors that tell of a limit are rate_limited, other errors and failed processes infra_error."""
    low = F.lower(F.coalesce(message, F.lit("")))
    limit = low.contains(LIMIT_WORDS[0]) | low.contains(LIMIT_WORDS[1])
    failed = F.coalesce(is_error, F.lit(False))
    return F.when(failed & F.coalesce(api_status.isin(*LIMIT_STATUSES), F.lit(False)) & limit, "rate_limited").when(failed | (F.coalesce(returncode, F.lit(0)) != 0), "infra_error").otherwise("ok")


def is_hard_limit(output: Column) -> Column:
    """Whether an output tells of a limit that waiting doesn't lift."""
    return F.coalesce(F.lower(output).contains(HARD_LIMIT), F.lit(False))


def finite(value: Column) -> Column:
    """A number of a text; 0 for what is none, or not finite."""
    x = value.try_cast("double")
    return F.when(F.abs(x) < float("inf"), x).otherwise(0.0)


def finite_count(value: Column) -> Column:
    """The whole part of a finite number of at least 0; else 0."""
    return F.greatest(F.lit(0), F.floor(finite(value)).cast("long")).cast("long")


def measured_tokens(usage: Column, key: str) -> Column:
    """A token count of a usage object (variant): whole numbers from 0 on; null for anything else, which is not measured."""
    value = F.try_variant_get(usage, f"$.{key}", "variant")
    kind = F.schema_of_variant(value)
    x = F.try_variant_get(value, "$", "double")
    return F.when((kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")) & (x >= 0) & (x < 2.0**63) & (x == F.floor(x)), x.cast("long"))


def usage_drifted(usage: Column) -> Column:
    """Whether a usage object has keys, but none that is known."""
    kind = F.schema_of_variant(usage)
    known = [F.try_variant_get(usage, f"$.{k}", "variant").isNotNull() for k in USAGE]
    any_known = known[0]
    for k in known[1:]:
        any_known = any_known | k
    return F.coalesce(kind.startswith("OBJECT") & (kind != "OBJECT<>") & ~any_known, F.lit(False))


def first_model(by_model: Column) -> Column:
    """The first key of a JSON object of models; null if it has none."""
    return F.get(F.json_object_keys(by_model), F.lit(0))


def pause(attempt: Column, base: float = 1.0) -> Column:
    """Seconds before attempt ``attempt`` (from 0): they double up to LONGEST_PAUSE."""
    return F.least(F.lit(LONGEST_PAUSE), F.lit(base) * F.pow(F.lit(2.0), attempt))


def server_name(line: Column) -> Column:
    """The name before the first ``: `` of a line of a server list; null if there is none, or it has spaces."""
    return F.nullif(F.regexp_extract(line, r"^([^\s:]+(?::[^\s:]+)*): ", 1), F.lit(""))


def digest_of(parts: Column, digits: int = 12) -> Column:
    """First hex digits of a SHA-256 over an array of texts in its order, each with its length, so no two arrays have one form; nulls count as empty."""
    sized = F.transform(parts, lambda x: F.concat(F.length(F.coalesce(x, F.lit(""))).cast("string"), F.lit(":"), F.coalesce(x, F.lit(""))))
    return F.substring(F.sha2(F.encode(F.array_join(sized, ""), "UTF-8"), 256), 1, digits)


def slug(text: Column) -> Column:
    """A text as part of a file name."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9._-]+", "-"), "^-+|-+$", "")


def cell_label(task: Column, model: Column, effort: Column, variant: Column, epoch: Column) -> Column:
    """How a cell is named in messages."""
    return F.format_string("%s [%s/%s %s #%d]", task, model, effort, variant, epoch)
