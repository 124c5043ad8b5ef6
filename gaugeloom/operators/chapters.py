"""Scoring of chapters by a rubric of located tags and censuses, and a structural check that needs no rubric."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.answers import rendered_only, tag_near, tags
from ..functions.stats import let

# The tag of each kind of item.
TAG = {"xref": "XRef", "cite": "Cite", "coderef": "CodeRef", "booklink": "BookLink"}


def whole_number(value: Column) -> Column:
    """The integer of an attribute; -1 if it is there but no integer, null if it is missing."""
    return F.when(value.isNotNull(), F.coalesce(F.trim(value).try_cast("long"), F.lit(-1).cast("long")))


def lines_fit(first: Column, last: Column, n_lines: Column) -> Column:
    """Whether a reference's lines lie in a file of ``n_lines``: the first is needed, the last may be missing."""
    lo, hi = whole_number(first), whole_number(last)
    return F.coalesce(lo.between(F.lit(1), n_lines) & (hi.isNull() | (hi.between(F.lit(1), n_lines) & (lo <= hi))), F.lit(False))


def item_points(text: Column, item: dict, labels: Column, references: Column, files: Column, window: int = 200) -> Column:
    """Points of one rubric item in a chapter: 1, 0, or a half for a cross reference to a wrong member of its family.

    ``labels`` and ``references`` are arrays of known names, ``files`` a map of paths to line counts. A located item
    reads the first tag of its kind behind its anchor, which must stand in the text once.
    """
    return let(rendered_only(text), lambda shown: _points(shown, item, labels, references, files, window))


def _points(shown: Column, item: dict, labels: Column, references: Column, files: Column, window: int) -> Column:
    """``item_points`` of what a chapter shows."""
    kind = item["kind"]
    if kind == "census":
        count = F.size(tags(shown, TAG[item["tag"]]))
        return count.between(item.get("min", 1), item["max"]).cast("double")
    if kind not in TAG:
        return F.lit(0.0)
    return let(tag_near(shown, item["anchor"], TAG[kind], window), lambda found: _points_of(found, item, labels, references, files))


def _points_of(found: Column, item: dict, labels: Column, references: Column, files: Column) -> Column:
    """Points of a located item by the attributes ``found`` there; null if there is no tag."""
    kind = item["kind"]
    attribute = lambda name: F.try_element_at(found, F.lit(name))
    known = lambda names, name: F.array_contains(names, name)
    if kind == "xref":
        got = attribute("id")
        points = F.when(got == item["expected_id"], 1.0).when(got.isin(list(item.get("family", []))) & known(labels, got), 0.5)
    elif kind == "cite":
        points = F.when((attribute("key") == item["expected_key"]) & known(references, attribute("key")), 1.0)
    elif kind == "coderef":
        path = attribute("path")
        pinned = path == item["expected_path"] if item.get("expected_path") is not None else F.lit(True)
        points = F.when(F.map_contains_key(files, path) & pinned & lines_fit(attribute("line"), attribute("lineEnd"), F.try_element_at(files, path)), 1.0)
    else:
        points = F.when((F.coalesce(attribute("book"), F.lit("")) != "") & (F.coalesce(attribute("to"), F.lit("")) != ""), 1.0)
    return F.coalesce(points, F.lit(0.0))


def rubric_points(text: Column, items: list[dict], labels: Column, references: Column, files: Column, window: int = 200) -> Column:
    """Array of the points of all items in a chapter, of which comments and fences are taken out once."""
    return let(rendered_only(text), lambda shown: F.array(*(_points(shown, x, labels, references, files, window) for x in items)))


def score_of(each: Column, n: int) -> Column:
    """Struct of value, points, n and below (items under 1) of an array of the points of ``n`` items."""
    points = F.aggregate(each, F.lit(0.0), lambda s, x: s + x)
    return F.struct((points / n).alias("value"), points.alias("points"), F.lit(n).alias("n"), F.size(F.filter(each, lambda x: x < 1)).alias("below"))


def rubric_score(text: Column, items: list[dict], labels: Column, references: Column, files: Column, window: int = 200) -> Column:
    """Struct of value, points, n and below (items under 1) of a chapter."""
    return let(rubric_points(text, items, labels, references, files, window), lambda each: score_of(each, len(items)))


def tag_rows(chapters: DataFrame, key: str, text: str, kind: str) -> DataFrame:
    """(key, at, attributes) of every rendered tag of a kind."""
    return chapters.select(key, F.posexplode(tags(rendered_only(F.col(text)), TAG[kind])).alias("at", "attributes"))


def violations(chapters: DataFrame, key: str, text: str, labels: DataFrame, references: DataFrame, files: DataFrame) -> DataFrame:
    """(key, kind, n) of tags that point nowhere, by joins with the registries ``labels`` (id), ``references`` (key) and ``files`` (path, n_lines)."""
    named = lambda kind, attribute: tag_rows(chapters, key, text, kind).select(key, F.lit(kind).alias("kind"), F.try_element_at("attributes", F.lit(attribute)).alias("name"), "attributes")
    xref = named("xref", "id").join(labels.select(F.col("id").alias("name")).distinct(), "name", "left_anti")
    cite = named("cite", "key").join(references.select(F.col("key").alias("name")).distinct(), "name", "left_anti")
    code = named("coderef", "path").join(files.select(F.col("path").alias("name"), "n_lines"), "name", "left")
    attribute = lambda name: F.try_element_at("attributes", F.lit(name))
    code = code.filter(F.col("n_lines").isNull() | ~lines_fit(attribute("line"), attribute("lineEnd"), F.col("n_lines")))
    book = named("booklink", "book").filter((F.coalesce("name", F.lit("")) == "") | (F.coalesce(attribute("to"), F.lit("")) == ""))
    all_ = xref.select(key, "kind")
    for more in (cite, code, book):
        all_ = all_.unionByName(more.select(key, "kind"))
    return all_.groupBy(key, "kind").agg(F.count(F.lit(1)).alias("n"))
