"""Allow-lists and leak checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.ledger import scratch_folder


def leaks(value: Column, fragments: tuple[str, ...], longest: int = 200) -> Column:
    """Whether a string is too long or holds one of the fragments; null doesn't leak."""
    hit = F.length(value) > longest
    for f in fragments:
        hit = hit | value.contains(f)
    return F.coalesce(hit, F.lit(False))


#: A string within JSON text, with its escapes.
_JSON_STRING = r'"((?:[^"\\]|\\.)*)"'


def strings_of(value: Column, kind: T.DataType) -> Column:
    """Array of all strings in a value of any type, nested ones and keys of maps too.

    Of a string that is a JSON object or array, the strings in it stand for it, keys included; numbers and booleans hold none.
    """
    none = F.array().cast("array<string>")
    if isinstance(kind, T.StringType):
        parsed = F.try_parse_json(value)
        nested = F.schema_of_variant(parsed).startswith("OBJECT") | F.schema_of_variant(parsed).startswith("ARRAY")
        inner = F.transform(F.regexp_extract_all(value, F.lit(_JSON_STRING), F.lit(1)), lambda x: F.coalesce(F.get_json_object(F.concat(F.lit('["'), x, F.lit('"]')), "$[0]"), x))
        return F.when(F.coalesce(nested, F.lit(False)), inner).when(value.isNotNull(), F.array(value)).otherwise(none)
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.flatten(F.transform(value, lambda x: strings_of(x, kind.elementType))), none)
    if isinstance(kind, T.MapType):
        return F.concat(strings_of(F.map_keys(value), T.ArrayType(kind.keyType)), strings_of(F.map_values(value), T.ArrayType(kind.valueType)))
    if isinstance(kind, T.StructType):
        return F.concat(none, *(strings_of(value[f.name], f.dataType) for f in kind.fields))
    return none


def violations(rows: DataFrame, fragments: tuple[str, ...], longest: int = 200) -> DataFrame:
    """(field, value) of every leaking string: in columns, arrays, maps, structs and JSON text alike."""
    def found_in(field: T.StructField) -> Column:
        return F.transform(strings_of(F.col(field.name), field.dataType), lambda x: F.struct(F.lit(field.name).alias("field"), x.alias("value")))

    cells = [found_in(field) for field in rows.schema.fields]
    found = rows.select(F.explode(F.concat(*cells)).alias("c")).select("c.*")
    return found.filter(leaks(F.col("value"), fragments, longest))


def foreign_tasks(rows: DataFrame, allowed: tuple[str, ...]) -> DataFrame:
    """Task ids outside the allow-list."""
    return rows.filter(~F.col("task_id").isin(*allowed)).select("task_id").distinct()


def require_tasks(rows: DataFrame, allowed: tuple[str, ...]) -> DataFrame:
    """``rows``, if all their tasks are allowed; a foreign task is an error, not a filter."""
    found = [r["task_id"] for r in foreign_tasks(rows, allowed).limit(5).collect()]
    if found:
        raise ValueError(f"tasks outside the allow-list: {found}")
    return rows


def only_tasks(rows: DataFrame, tasks: tuple[str, ...]) -> DataFrame:
    """Rows of some tasks, chosen after marks were made; none at all is an error.

    They are written to shared storage once and read from there by the test and by all that follows, so the marks are made once.
    """
    kept = rows.filter(F.col("task_id").isin(*tasks)) if tasks else rows
    path = scratch_folder(rows.sparkSession, "kept")
    kept.write.parquet(path)
    kept = rows.sparkSession.read.schema(kept.schema).parquet(path)
    if kept.isEmpty():
        raise ValueError(f"no rows of the tasks {sorted(tasks)}")
    return kept


def unknown_tools(declared: Column, known: tuple[str, ...]) -> Column:
    """Tools that a task declares and no catalog has; empty is well."""
    return F.array_except(F.coalesce(declared, F.array().cast("array<string>")), F.array(*(F.lit(k) for k in known)))


def disallowed_tools(declared: Column, known: tuple[str, ...]) -> Column:
    """The tools of the catalog that a task doesn't declare, in the catalog's order; null (none declared) disallows nothing."""
    return F.when(declared.isNotNull(), F.array_except(F.array(*(F.lit(k) for k in known)), declared))
