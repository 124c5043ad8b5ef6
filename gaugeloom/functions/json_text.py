"""JSON inside the text of replies. Built-in parsing comes first; what it can't do (a value amid chatter) runs as an Arrow-batched function on the rest."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

# Keys under which replies hold lists, answers and verdicts, and formats of answer lines.
ANSWER_KEYS = ("answer", "result", "value", "line", "label", "final")
VERDICT_LISTS = ("classifications", "verdicts", "results")
CLAIM_LISTS = ("claims", "anchors", "extractions")
ANSWER_LINE = r"(?im)^[ \t>*\-]*answer[ \t]*[:=][ \t]*(.+?)[ \t]*$"
FENCE_BODY = r"(?s)```(?:[a-zA-Z0-9_+-]+)?\n(.*?)```"

LINE_ENDS = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"

_OPEN = re.compile(r"[\[{]")
#: White space, then an opening bracket, a closing one, a comma or colon, a string, or another scalar.
_TOKEN = re.compile(
    r"[ \t\n\r]*(?:([\[{])|([\]}])|([,:])|(\"[^\"\\\x00-\x1f]*(?:\\(?:[\"\\/bfnrt]|u[0-9a-fA-F]{4})[^\"\\\x00-\x1f]*)*\")"
    r"|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?|true|false|null|NaN|-?Infinity))"
)
#: What may come next in a container.
_FIRST, _ITEM, _COLON, _VALUE, _NEXT = range(5)


def _settle(text: str, start: int, ends: dict[int, int | None]) -> None:
    """Find the end of the JSON container at ``start``, and of those that are met in it; None where a container can't be read.

    Containers that are open when an error is met can't be read either, and one that is known is not read again, so each is read once.
    """
    open_, at = [], start
    while True:
        m = _TOKEN.match(text, at)
        kind = m.lastindex if m else 0
        state = open_[-1][2] if open_ else _VALUE
        is_object = bool(open_) and open_[-1][1] == "{"
        takes_value = state == _VALUE or (state in (_FIRST, _ITEM) and not is_object)
        if kind == 1 and takes_value:
            q = m.start(1)
            if q in ends:
                if ends[q] is None:
                    break
                at = ends[q]
                open_[-1][2] = _NEXT
            else:
                open_.append([q, m[1], _FIRST])
                at = m.end()
            continue
        if kind == 2 and state in (_FIRST, _NEXT) and (m[2] == "}") == is_object:
            q = open_.pop()[0]
            at = ends[q] = m.end()
            if not open_:
                return
            open_[-1][2] = _NEXT
            continue
        if kind in (4, 5) and takes_value:
            open_[-1][2] = _NEXT
        elif kind == 4 and is_object and state in (_FIRST, _ITEM):
            open_[-1][2] = _COLON
        elif kind == 3 and state == _COLON and m[3] == ":":
            open_[-1][2] = _VALUE
        elif kind == 3 and state == _NEXT and m[3] == ",":
            open_[-1][2] = _ITEM
        else:
            break
        at = m.end()
    for q, _, _ in open_:
        ends[q] = None


def json_spans(text: str) -> list[tuple[int, int]]:
    """Where JSON objects and arrays stand in a text, those within others left out; in time linear in the text, however many brackets lead to nothing."""
    ends: dict[int, int | None] = {}
    out, behind = [], 0
    for m in _OPEN.finditer(text):
        p = m.start()
        if p < behind:
            continue
        if p not in ends:
            _settle(text, p, ends)
        if ends[p] is not None:
            out.append((p, ends[p]))
            behind = ends[p]
    return out


def _read(text: str):
    """[value] of a JSON text, [] of any other, or of one that is nested too deeply."""
    try:
        return [json.loads(text)]
    except (ValueError, RecursionError):
        return []


def _objects(value) -> Iterator[dict]:
    """The objects of a value, outer ones before those they hold, in the order of the text."""
    left = [value]
    while left:
        x = left.pop()
        if isinstance(x, dict):
            yield x
            left.extend(reversed(x.values()))
        elif isinstance(x, list):
            left.extend(reversed(x))


def _said(text: str) -> Iterator[dict]:
    """All objects that stand in a text."""
    for a, b in json_spans(text):
        for value in _read(text[a:b]):
            yield from _objects(value)


def _mapped(series: pd.Series, fn) -> pd.Series:
    return series.map(lambda x: None if x is None else fn(x)).astype(object)


@pandas_udf(T.StringType())
def _first_value(texts: pd.Series) -> pd.Series:
    def find(text):
        found = _read(text) or next(filter(None, (_read(text[a:b]) for a, b in json_spans(text))), [])
        return json.dumps(found[0]) if found and found[0] is not None else None

    return _mapped(texts, find)


@pandas_udf(T.StructType([T.StructField("whole", T.StringType()), T.StructField("keyed", T.StringType())]))
def _answers(texts: pd.Series) -> pd.DataFrame:
    def find(text):
        for scalar in _read(text.strip()):
            if isinstance(scalar, (str, int, float)):
                return str(scalar), None
        named = [[str(x[k]) for k in ANSWER_KEYS if x.get(k) is not None] for x in _said(text)]
        return None, next((names[0] for names in reversed(named) if names), None)

    return pd.DataFrame([(None, None) if x is None else find(x) for x in texts], columns=["whole", "keyed"])


@pandas_udf(T.MapType(T.LongType(), T.StringType()))
def _answer_object(texts: pd.Series) -> pd.Series:
    def numbered(answers: dict) -> dict:
        return {int(k): str(v) for k, v in answers.items() if re.fullmatch(r"\s*[-+]?[0-9]+(?:_[0-9]+)*\s*", k)}

    def find(text):
        found = [x["answers"] for x in _said(text) if isinstance(x.get("answers"), dict)]
        return numbered(found[-1]) if found else {}

    return _mapped(texts, find)


def stripped(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


def _needs(text: Column, condition: Column) -> Column:
    """The text where a function has work to do, else null, which it passes over."""
    return F.when(condition, text)


def _parsed(text: Column) -> Column:
    """The variant of a text that is one JSON value and nothing else; the parser itself doesn't mind what follows a value."""
    value = F.try_parse_json(text)
    bare = lambda x: F.regexp_replace(x, r"\s+", "")
    return F.when(bare(F.to_json(value)) == bare(text), value)


def lenient_json(text: Column) -> Column:
    """The JSON value of a text, as JSON: the whole text, else the first that can be read from an opening bracket on; null if there is none."""
    whole = _parsed(text)
    return F.coalesce(F.to_json(whole), _first_value(_needs(text, whole.isNull())))


def payload_object(text: Column) -> Column:
    """The JSON object of a process's output, as JSON: the whole, else the last line that is one, else what stands from the first brace to the last."""
    as_object = lambda x: F.when(_is_object(_parsed(x)), F.to_json(_parsed(x)))
    lines = F.filter(F.split(text, LINE_ENDS), lambda x: F.ltrim(x).startswith("{") & _is_object(_parsed(x)))
    first, size = F.instr(text, "{"), F.length(text)
    last = size - F.instr(F.reverse(text), "}") + 1
    braced = F.when((first > 0) & F.contains(text, F.lit("}")) & (last > first), F.substring(text, first, last - first + 1))
    return F.coalesce(as_object(text), F.to_json(_parsed(F.get(lines, F.size(lines) - 1))), as_object(braced))


def answer_of(text: Column) -> Column:
    """The single answer of a reply; null only where it is blank.

    In this order: the reply is a JSON scalar; its last ``ANSWER:`` line; the last JSON object with one of
    ANSWER_KEYS; its only fenced block; the whole reply.
    """
    body = stripped(text)
    lines, fences = (F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in (ANSWER_LINE, FENCE_BODY))
    line = F.when(F.size(lines) > 0, stripped(F.element_at(lines, -1)))
    found = _answers(_needs(text, (F.size(lines) == 0) | F.try_parse_json(body).isNotNull()))
    fence = F.when(F.size(fences) == 1, stripped(F.get(fences, F.lit(0))))
    return F.when(body != "", F.coalesce(found["whole"], F.nullif(line, F.lit("")), found["keyed"], fence, body))


def answer_object(text: Column) -> Column:
    """Map of position to answer from the last JSON object with an object ``answers``; keys that are no integers are left out."""
    return _answer_object(_needs(text, text.contains("answers")))


def answers_of(text: Column) -> Column:
    """Map of position to answer: from numbered answer lines or, if there are none, from the object of answers; empty if there is neither."""
    from .answers import numbered_answers

    lines = numbered_answers(text)
    return F.when(F.size(lines) > 0, lines).otherwise(F.coalesce(answer_object(text), lines))


def _list_under(value: Column, keys: tuple[str, ...]) -> Column:
    """Items of a variant that is a list, or has one under the first of ``keys`` that holds one."""
    return F.coalesce(*(F.try_variant_get(value, f"$.{k}", "array<variant>") for k in keys), F.when(F.schema_of_variant(value).startswith("ARRAY"), F.try_variant_get(value, "$", "array<variant>")))


def _is_object(item: Column) -> Column:
    return F.coalesce(F.schema_of_variant(item).startswith("OBJECT"), F.lit(False))


def claims(text: Column) -> Column:
    """Quotes of the claim objects of a reply, trimmed ("" for none); null if it has no list of claims."""
    items = _list_under(F.parse_json(lenient_json(text)), CLAIM_LISTS)
    return F.transform(F.filter(items, _is_object), lambda c: stripped(F.coalesce(F.try_variant_get(c, "$.quote", "string"), F.lit(""))))


def binary(value: Column) -> Column:
    """0 or 1 of a label (variant): booleans, numbers by 0.5, words by their verdict; null if it is neither."""
    from .text import verdict

    kind = F.schema_of_variant(value)
    number = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
    return F.when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean").cast("int")).when(number, (F.try_variant_get(value, "$", "double") >= 0.5).cast("int")).when(kind == "STRING", verdict(F.try_variant_get(value, "$", "string")))


def classifications(text: Column) -> Column:
    """Array of (idx, label 0/1) of the verdict list of a reply, in its order; items without an integer idx or a clear label are left out; null if there is no list."""
    items = F.filter(_list_under(F.parse_json(lenient_json(text)), VERDICT_LISTS), _is_object)
    named = F.transform(items, lambda x: F.struct(
        F.try_variant_get(x, "$.idx", "bigint").alias("idx"), F.coalesce(binary(F.try_variant_get(x, "$.label", "variant")), F.when(F.try_variant_get(x, "$.label", "variant").isNull(), binary(F.try_variant_get(x, "$.verdict", "variant")))).alias("label")
    ))
    return F.filter(named, lambda x: x["idx"].isNotNull() & x["label"].isNotNull())


def label_map(labels: Column) -> Column:
    """A map of strings (idx to label) as a map of integers to 0 or 1; entries without an integer key or a clear label are left out."""
    from .text import verdict

    number = lambda v: v.try_cast("double")
    as_label = lambda v: F.when(number(v).isNotNull(), (number(v) >= 0.5).cast("int")).otherwise(verdict(v))
    entries = F.transform(F.map_entries(labels), lambda e: F.struct(e["key"].try_cast("bigint").alias("key"), as_label(e["value"]).alias("value")))
    return F.map_from_entries(F.filter(entries, lambda e: e["key"].isNotNull() & e["value"].isNotNull()))
