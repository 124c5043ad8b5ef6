"""Graders: a reply and what is expected of it to a score (value, status, subscores, details), as column expressions.

The status is ok, unparseable (the reply can't be read; the value is 0 and counts) or grader_error (the
expectation is at fault; the grade doesn't count). What is read from a reply by ``functions.json_text``
(``answer_of``, ``answers_of``, ``claims``) is handed over as a column of its own, so it is read once a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import json_text as JT
from ..functions import text as TX
from .grading import confusion_of

#: Least words of a quote that counts, claims expected by default, and errors that leave no credit.
QUOTE_WORDS, CLAIMS, ERROR_CAP = 3, 5, 5
LONGEST_CHAPTER = 1_000_000
# Formats of what checkers print.
FAILURE_COUNT = r"VALIDATION FAILED:\s*(\d+)\s+error"
FAILURE_LINE = r"(?m)^\s*-\s+(.*)$"
PASSED = r"^CHECK PASSED: (\d+)/(\d+) points\s*$"
FAILED = r"^CHECK FAILED: ([\d.]+)/(\d+) points, (\d+) items below full\s*$"


def score(value: Column | float, status: str = "ok", subscores: dict[str, Column] | None = None, details: dict[str, Column] | None = None) -> Column:
    """A score; subscores and details that are null are left out."""
    def mapped(items, kind):
        if not items:
            return F.map_from_arrays(F.array().cast("array<string>"), F.array().cast(f"array<{kind}>"))
        pairs = F.array(*(F.struct(F.lit(k).alias("key"), v.cast(kind).alias("value")) for k, v in items.items()))
        return F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull()))

    value = value if isinstance(value, Column) else F.lit(float(value))
    return F.struct(value.cast("double").alias("value"), F.lit(status).alias("status"), mapped(subscores, "double").alias("subscores"), mapped(details, "string").alias("details"))


def _error(reason: str) -> Column:
    return score(0.0, "grader_error", details={"reason": F.lit(reason)})


def _unreadable(output: Column) -> Column:
    return score(0.0, "unparseable", details={"raw": F.substring(output, 1, 500)})


def exact_match(output: Column, answer: Column, expected: Column, numeric: Column, relative: float = 1e-9, absolute: float = 0.0) -> Column:
    """1 if the ``answer`` of an output (see ``answer_of``) is one of ``expected`` (an array), by form without white space or, if ``numeric``, by its first number."""
    number = TX.first_number(answer)
    close = F.exists(expected, lambda e: F.coalesce(TX.is_close(number, TX.first_number(e), relative, absolute), F.lit(False)))
    same = F.exists(expected, lambda e: TX.squashed(e) == TX.squashed(answer))
    hit = F.when(F.coalesce(numeric, F.lit(False)), close).otherwise(same)
    graded = score(hit.cast("double"), details={"answer": F.substring(answer, 1, 200), "matched": hit})
    return F.when(F.coalesce(F.size(expected), F.lit(0)) < 1, _error("gold.expected missing or empty")).when(answer.isNull(), _unreadable(output)).otherwise(graded)


def exact_match_set(output: Column, got: Column, expected: Column, numeric: Column) -> Column:
    """By the answers ``got`` (map of position to answer, see ``answers_of``), the share of the ordered ``expected`` whose position has that answer; in numeric mode any other answer than a bare integer makes the reply unparseable."""
    n = F.size(expected)
    numbers = F.coalesce(numeric, F.lit(False))
    whole = F.transform(expected, TX.bare_integer)
    odd = F.map_filter(got, lambda k, v: (k >= 1) & (k <= n) & TX.bare_integer(v).isNull())
    answered = lambda i: F.try_element_at(got, (i + 1).cast("bigint"))
    right = lambda e, i: F.when(numbers, TX.bare_integer(answered(i)) == TX.bare_integer(e)).otherwise(TX.squashed(answered(i)) == TX.squashed(e))
    hits = F.size(F.filter(F.transform(expected, right), lambda x: x))
    graded = score(hits / n, subscores={"n": n, "found": hits}, details={"answered": F.size(got)})
    return (
        F.when(F.coalesce(n, F.lit(0)) < 1, _error("gold.expected missing or empty")).when(F.size(got) == 0, _unreadable(output))
        .when(numbers & F.exists(whole, lambda x: x.isNull()), _error("numeric gold must be bare integers"))
        .when(numbers & (F.size(odd) > 0), score(0.0, "unparseable", details={"reason": F.concat(F.lit("position "), F.array_min(F.map_keys(odd)).cast("string"), F.lit(" is not a bare integer"))}))
        .otherwise(graded)
    )


def anchor(output: Column, quotes: Column, source: Column, expected: Column | None = None, strict: bool = False) -> Column:
    """Distinct ``quotes`` (see ``claims``) of at least QUOTE_WORDS words that stand in the source, by the claims expected or made, whichever are more; ``strict``: character by character."""
    prepared = (lambda x: x) if strict else TX.normalized
    text = prepared(F.coalesce(source, F.lit("")))
    expected = F.lit(CLAIMS) if expected is None else F.coalesce(expected, F.lit(CLAIMS))
    stands = F.filter(quotes, lambda q: (F.size(F.split(TX.normalized(q), " ")) >= QUOTE_WORDS) & text.contains(prepared(q)))
    distinct = F.array_distinct(F.transform(stands, prepared))
    made = F.size(quotes)
    most = F.greatest(expected, made)
    graded = score(
        F.when(most > 0, F.size(distinct) / most).otherwise(0.0), subscores={"n_claims": made, "n_verbatim": F.size(distinct), "expected": expected},
        details={"shortfall": F.greatest(F.lit(0), expected - made), "duplicate_quotes": F.nullif(F.size(stands) - F.size(distinct), F.lit(0)), "misses": F.to_json(F.filter(quotes, lambda q: ~F.array_contains(stands, q)))},
    )
    return F.when(text == "", _error("empty source_text")).when(quotes.isNull(), _unreadable(output)).otherwise(graded)


def validator(exit_code: Column, stderr: Column) -> Column:
    """The score of a validator's run: 1 for exit 0, partial credit for exit 1 with its summary of errors, else a grader error."""
    stderr = F.coalesce(stderr, F.lit(""))
    errors = F.nullif(F.regexp_extract(stderr, FAILURE_COUNT, 1), F.lit("")).try_cast("long")
    credit = F.greatest(F.lit(0.0), 1 - errors / ERROR_CAP)
    partial = score(credit, subscores={"errors": errors}, details={"returncode": F.lit(1), "errors": F.to_json(F.regexp_extract_all(stderr, F.lit(FAILURE_LINE), F.lit(1)))})
    broken = score(0.0, "grader_error", details={"returncode": exit_code, "stderr": F.substring(stderr, 1, 1000)})
    return F.when(exit_code == 0, score(1.0, subscores={"errors": F.lit(0.0)}, details={"returncode": F.lit(0)})).when((exit_code == 1) & errors.isNotNull(), partial).otherwise(broken)


def checker_summary(exit_code: Column, stdout: Column) -> Column:
    """The score that the last line of a checker's output tells, where its counts agree with the exit code."""
    lines = F.filter(F.split(F.coalesce(stdout, F.lit("")), r"\r\n|\n|\r"), lambda x: F.trim(x) != "")
    last = F.try_element_at(lines, F.lit(-1))
    of = lambda pattern, group: F.nullif(F.regexp_extract(last, pattern, group), F.lit(""))
    got, out_of = of(PASSED, 1).try_cast("long"), of(PASSED, 2).try_cast("long")
    points, total, below = of(FAILED, 1).try_cast("double"), of(FAILED, 2).try_cast("long"), of(FAILED, 3).try_cast("long")
    passed = score(1.0, subscores={"points": out_of, "n": out_of}, details={"summary": last})
    share = F.when(total > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), points / total))).otherwise(0.0)
    failed = score(share, subscores={"points": points, "n": total, "below": below}, details={"summary": last})
    return (
        F.when(F.size(lines) == 0, _error("no checker output"))
        .when(got.isNotNull(), F.when((exit_code == 0) & (got == out_of), passed).otherwise(_error("PASS/exit disagree")))
        .when(total.isNotNull() & points.isNotNull(), F.when(exit_code == below, failed).otherwise(_error("count/exit disagree")))
        .otherwise(_error("unparseable summary"))
    )


def chapter_guard(output: Column, graded: Column) -> Column:
    """``graded``, but 0 for replies that are longer than any chapter or hold a NUL: a fault of the reply, not of the grader."""
    return F.when(F.length(output) > LONGEST_CHAPTER, score(0.0, details={"reason": F.lit("oversize"), "len": F.length(output)})).when(output.contains("\x00"), score(0.0, details={"reason": F.lit("binary/NUL in output")})).otherwise(graded)


def dispatch(run_status: Column, grader: Column, by_name: dict[str, Column]) -> Column:
    """The score of the grader that a row names; runs that failed and names that no grader has are grader errors."""
    chosen = F.when(F.coalesce(run_status, F.lit("")) != "ok", score(0.0, "grader_error", details={"reason": F.concat(F.lit("run_status="), F.coalesce(run_status, F.lit("null")))}))
    for name, graded in by_name.items():
        chosen = chosen.when(grader == name, graded)
    return chosen.otherwise(score(0.0, "grader_error", details={"reason": F.concat(F.lit("unknown grader "), F.coalesce(grader, F.lit("null")))}))


def classification(replies: DataFrame, gold: DataFrame, key: str) -> DataFrame:
    """Scores of ``replies`` (key, output) against ``gold`` (key, idx, label): counts, value, status, subscores, missing and extra idx.

    The value is the AUROC of the hard labels, or the accuracy where gold has one class. An item without a prediction
    is predicted wrong. No gold is a grader error, a reply without a verdict list is unparseable, one with an empty list is 0.
    Of repeated idx the last counts; gold repeats nothing.
    """
    parsed = replies.select(key, JT.classifications(F.col("output")).alias("list"))
    said = parsed.select(key, F.posexplode("list").alias("at", "p")).groupBy(key, F.col("p.idx").alias("idx")).agg(F.max_by(F.col("p.label"), F.col("at")).alias("predicted"))
    met = gold.select(key, "idx", "label").join(said, [key, "idx"], "full")
    counts = met.groupBy(key).agg(
        *confusion_of(F.col("label"), F.col("predicted"), F.col("label").isNotNull()),
        F.array_sort(F.collect_list(F.when(F.col("predicted").isNull(), F.col("idx")))).alias("missing_idx"), F.array_sort(F.collect_list(F.when(F.col("label").isNull(), F.col("idx")))).alias("extra_idx"),
    )
    rows = parsed.select(key, F.col("list").isNotNull().alias("readable")).join(counts, key, "left")
    n = F.coalesce(F.col("n"), F.lit(0))
    status = F.when(n == 0, "grader_error").when(~F.col("readable"), "unparseable").otherwise("ok")
    ok = status == "ok"
    value = F.when(ok, F.coalesce("auroc", "accuracy")).otherwise(0.0)
    return rows.select(key, value.alias("value"), status.alias("status"), *(F.when(ok, F.col(c)).alias(c) for c in ("n", "tp", "fp", "tn", "fn", "accuracy", "precision", "recall", "f1", "auroc", "missing_idx", "extra_idx")))


def label_prompt(messages: DataFrame, key: str, idx: str, text: str) -> DataFrame:
    """(key, prompt, gold idx list): the messages of each key as numbered elements, in the order of ``idx``."""
    line = F.concat(F.lit("<msg idx="), F.col(idx).cast("string"), F.lit(">"), F.coalesce(F.col(text), F.lit("")), F.lit("</msg>"))
    return messages.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(idx).alias("i"), line.alias("l")))), lambda x: x["l"]), "\n").alias("prompt"))


def gold_labels(messages: DataFrame, key: str, order: str, label: str) -> DataFrame:
    """(key, idx, label): labels by their place, from 0, in the order of ``order``."""
    return messages.select(key, (F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1).cast("long").alias("idx"), F.col(label).cast("int").alias("label"))
