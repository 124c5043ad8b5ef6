"""What a reply holds: numbered answers, fenced blocks, tags and their attributes, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .stats import let

# The formats of replies.
NUMBERED = r"(?im)^[ \t>*\-]*answer[ \t]*#?[ \t]*(\d+)[ \t]*[:=][ \t]*(.+?)[ \t]*$"
#: Of opening tags, after the name: attributes up to the end, which may close itself.
OPENING = r"\b([^>]*?)/?>"
ATTRIBUTE = r"""\b(\w+)\s*=\s*("[^"]*"|'[^']*'|\{[^}]*\})"""
COMMENT = r"(?s)<!--.*?-->"
FENCED = r"(?sm)^[ \t]*```.*?^[ \t]*```"
FENCE_LINE = r"^[ \t]*```"


def numbered_answers(text: Column) -> Column:
    """Map of position to answer from ``ANSWER k: x`` lines; the last of a position wins, a null text has none."""
    found = lambda group: F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(NUMBERED), F.lit(group))
    pairs = F.arrays_zip(found(1).alias("k"), found(2).alias("v"))
    known = F.map_from_arrays(F.array().cast("array<bigint>"), F.array().cast("array<string>"))

    def put(seen: Column, pair: Column) -> Column:
        k = pair["k"].try_cast("bigint")
        rest = F.map_filter(seen, lambda old, _: old != k)
        return F.when(k.isNull(), seen).otherwise(F.map_concat(rest, F.create_map(k, pair["v"])))

    return F.aggregate(pairs, known, put)


def hits(answers: Column, gold: Column) -> Column:
    """The share of the positions of the map ``gold`` whose answer equals it; null without gold."""
    right = F.map_filter(gold, lambda k, v: F.coalesce(F.try_element_at(answers, k) == v, F.lit(False)))
    return F.when(F.size(gold) > 0, F.size(right) / F.size(gold))


def fenced_blocks(text: Column) -> Column:
    """The contents of fenced blocks, in order; an open last fence is none."""
    lines = F.split(F.coalesce(text, F.lit("")), "\r\n|\n|\r")
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("blocks"), none.alias("lines"), F.lit(False).alias("open"))

    def step(s: Column, line: Column) -> Column:
        fence = line.rlike(FENCE_LINE)
        blocks = F.when(fence & s["open"], F.array_append(s["blocks"], F.array_join(s["lines"], "\n"))).otherwise(s["blocks"])
        inside = F.when(fence, none).when(s["open"], F.array_append(s["lines"], line)).otherwise(s["lines"])
        return F.struct(blocks.alias("blocks"), inside.alias("lines"), (s["open"] != fence).alias("open"))

    return F.aggregate(lines, start, step, lambda s: s["blocks"])


def chapter(text: Column, anchor: str | None) -> Column:
    """The largest fenced block that holds ``anchor``, else what a single outer fence wraps, else the text."""
    wrapped = F.regexp_extract(text, r"(?s)\A\s*?[ \t]*```[^\n]*\n(.*)\n[ \t]*```\s*\z", 1)
    whole = F.when(text.rlike(r"(?s)\A\s*?[ \t]*```[^\n]*\n.*\n[ \t]*```\s*\z"), wrapped).otherwise(text)
    if not anchor:
        return whole
    largest = F.aggregate(
        F.filter(fenced_blocks(text), lambda b: b.contains(anchor)), F.lit(None).cast("string"),
        lambda best, b: F.when(best.isNull() | (F.length(b) > F.length(best)), b).otherwise(best),
    )
    return F.coalesce(largest, whole)


def rendered_only(text: Column) -> Column:
    """A text without comments, then without fenced blocks."""
    return F.regexp_replace(F.regexp_replace(text, COMMENT, ""), FENCED, "")


def _attributes(blob: Column) -> Column:
    """The attributes of an opening tag as a map; the last of a name wins."""
    part = lambda group: F.regexp_extract_all(blob, F.lit(ATTRIBUTE), F.lit(group))
    names, values = part(1), F.transform(part(2), lambda v: F.regexp_replace(F.regexp_replace(v, r"^[\"'{]|[\"'}]$", ""), r"^[\"']+|[\"']+$", ""))
    last = F.filter(F.arrays_zip(names.alias("n"), values.alias("v"), F.sequence(F.lit(1), F.size(names)).alias("i")), lambda x: ~F.array_contains(F.slice(names, x["i"] + 1, F.size(names)), x["n"]))
    return F.when(F.size(names) == 0, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))).otherwise(
        F.map_from_arrays(F.transform(last, lambda x: x["n"]), F.transform(last, lambda x: x["v"]))
    )


def tags(text: Column, kind: str) -> Column:
    """Attributes of every opening tag of ``kind``, in order, as an array of maps."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"<{kind}{OPENING}"), F.lit(1)), _attributes)


def tag_near(text: Column, anchor: str, kind: str, window: int) -> Column:
    """Attributes of the first tag of ``kind`` that begins up to ``window`` characters behind the anchor, wherever it ends; null if the anchor is missing or not unique.

    Tags are sought in the whole text, and what stands between them gives their places. Occurrences of the anchor that overlap are two.
    """
    pattern = f"<{kind}{OPENING}"
    a = anchor.lower()

    def first_in(text: Column, at: Column) -> Column:
        behind = at + len(a)
        every = lambda group: F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
        found = let(every(0), lambda whole: F.arrays_zip(F.slice(F.split(text, pattern, -1), 1, F.size(whole)).alias("before"), whole.alias("tag"), every(1).alias("blob")))

        def step(s: Column, x: Column) -> Column:
            begins = s["at"] + F.length(x["before"])
            here = s["blob"].isNull() & begins.between(behind, behind + window)
            return F.struct((begins + F.length(x["tag"])).alias("at"), F.when(here, x["blob"]).otherwise(s["blob"]).alias("blob"))

        return F.aggregate(found, F.struct(F.lit(1).alias("at"), F.lit(None).cast("string").alias("blob")), step, lambda s: s["blob"])

    def near(text: Column) -> Column:
        place = let(F.lower(text), lambda low: let(F.instr(low, a), lambda at: F.when((at > 0) & (F.position(F.lit(a), low, at + 1) == 0), at)))
        blob = let(place, lambda at: F.when(at.isNotNull(), first_in(text, at)))
        return let(blob, lambda b: F.when(b.isNotNull(), _attributes(b)))

    return let(text, near)
