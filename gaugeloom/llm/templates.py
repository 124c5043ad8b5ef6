"""Benchmark decontamination by template canonicalisation.

A text becomes a sequence of template tokens: numbers, names (capitalised words within a sentence) and
units (after a number) become typed placeholders that keep their value as a slot; other words stay, in
lower case. Neighbouring numbers, or names, are one. A capitalised word that begins a sentence may be a name
or not, so there are two views of a text: PLAIN, where it is a word, and NAMED, where it is a name. In a
third view, EXACT, every word stays, numbers and names too, so any item can be found as it is.

Windows of WINDOW tokens (in PLAIN and NAMED those with enough plain words) are hash-joined between
documents and benchmark items. Alignments whose shifts are apart by no more than the item's length are
added up, so that words put in or left out don't part a passage. Each value of the item stands for one
value in the document, and windows in which it stands for several are no match. A document is contaminated by an
item if, in one view, the agreeing windows make up enough of the item; a gap of at most WINDOW windows
between two of them is what one changed word leaves, and counts as covered.

Documents only emit windows that pass a bitmap of fixed size with the benchmark's windows, so what is
shuffled grows with the matches. The benchmark's windows are broadcast if they are few (counted first),
else joined by shuffle.

Defined cases: null and empty texts have no windows; items shorter than a window are one window of
their own length; items with fewer than LITERALS plain words in every window are found in their own words
only; rows of one id are told apart by their text, and reported once for each (doc_id, item_id).
"""

from __future__ import annotations

import collections
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytehash import BYTE_VALUES, LOWER_ASCII, U, WHITE, _ROLES, buffer_of, mix, owner, span_hashes, spans
from .shared import map_batches, size_chunks, texts_of, written

WINDOW = 8
LITERALS = 4
COVERAGE = 0.5
#: Windows that are enough whatever part of a long item they are.
ENOUGH = 24
#: At most so many windows of the benchmark are broadcast.
BROADCAST_WINDOWS = 300_000
_BITS = 24

# Unit and number words.
UNITS = (
    "mm cm m km inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres mg g kg gram grams kilogram kilograms ton tons tonne tonnes oz ounce ounces "
    "lb lbs pound pounds ml cl l liter liters litre litres gallon gallons s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years "
    "cent cents dollar dollars euro euros usd eur gbp percent degree degrees mph kmh kph watt watts kw volt volts byte bytes kb mb gb tb hz khz mhz ghz"
).split()
NUMBERS = (
    "zero two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion"
).split()

_SEPARATOR = WHITE.copy()
_SEPARATOR[:128] |= [not chr(c).isalnum() for c in range(128)]
_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".!?\n:;"]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_LITERAL, _NUMBER, _NAME, _UNIT = range(4)
_TYPE = mix(np.arange(1, 5, dtype=U) * U(0x9E3779B97F4A7C15))
_PLAIN, _NAMED, _EXACT = range(3)
#: Windows of EXACT have hashes of their own.
_EXACT_ROLE = 1 << 32


def _known(words: list[str]) -> np.ndarray:
    buf, starts = buffer_of(words)
    a, b = spans(_SEPARATOR[buf])
    return np.sort(span_hashes(buf, a, b, BYTE_VALUES[LOWER_ASCII]))


_UNIT_HASHES, _NUMBER_HASHES = _known(UNITS), _known(NUMBERS)


@dataclass(frozen=True)
class View:
    """Tokens of some texts: text of each, hash, slot value or 0, kind, and the place of its first word in the text (in PLAIN's tokens; in EXACT: in words)."""

    text: np.ndarray
    token: np.ndarray
    value: np.ndarray
    kind: np.ndarray
    place: np.ndarray


def _views(texts: list[str]) -> list[View]:
    """PLAIN, NAMED and EXACT of some texts."""
    buf, starts = buffer_of(texts)
    two = np.zeros(len(buf), bool)  # second bytes of two-byte capitals of the Latin-1 supplement
    if len(buf) > 1:
        two[1:] = (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)
    lower = LOWER_ASCII[buf] + two.astype(np.uint8) * np.uint8(32)
    a, b = spans(_SEPARATOR[buf])
    text = owner(starts, a)
    h = span_hashes(lower, a, b, BYTE_VALUES)
    ends = np.concatenate([[0], np.cumsum(_ENDS[buf])])
    digits = np.concatenate([[0], np.cumsum(_DIGIT[buf])])
    previous = np.concatenate([[0], b[:-1]]) if len(b) else b
    begins = (ends[a] - ends[previous] > 0) | (np.diff(text, prepend=-1) != 0)
    second = np.minimum(a + 1, len(buf) - 1)
    capital = ((buf[a] >= 65) & (buf[a] <= 90)) | two[second] & (buf[a] == 0xC3)
    in_list = lambda table: table[np.minimum(np.searchsorted(table, h), len(table) - 1)] == h
    kind = np.where((digits[b] - digits[a] > 0) | in_list(_NUMBER_HASHES), _NUMBER, np.where(capital & ~begins, _NAME, _LITERAL))
    after_number = np.zeros(len(a), bool)
    if len(a) > 1:
        after_number[1:] = (kind[:-1] == _NUMBER) & ~begins[1:]
    kind = np.where(after_number & in_list(_UNIT_HASHES), _UNIT, kind)
    initial = (kind == _LITERAL) & capital & begins
    index = _places(text, np.ones(len(a), bool))
    exact = View(text, h, np.zeros(len(a), U), np.full(len(a), _LITERAL), index)
    plain_first = ~_joins(kind, begins)
    place = _places(text, plain_first)
    return [_view(text, h, kind, begins, place), _view(text, h, np.where(initial, _NAME, kind), begins, place), exact]


def _joins(kind: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Words that are one token with the word before: consecutive numbers or names of a sentence."""
    joins = np.zeros(len(kind), bool)
    if len(kind) > 1:
        joins[1:] = ((kind[1:] == _NUMBER) | (kind[1:] == _NAME)) & (kind[1:] == kind[:-1]) & ~begins[1:]
    return joins


def _places(text: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each word the place in its text of the token that it is in."""
    at = np.cumsum(first) - 1
    return at - at[np.searchsorted(text, text)] if len(text) else at


def _view(text, h, kind, begins, place) -> View:
    first = np.flatnonzero(~_joins(kind, begins))
    if not len(first):
        return View(text[:0], h[:0], h[:0], kind[:0], place[:0])
    offset = np.arange(len(h)) - np.repeat(first, np.diff(first, append=len(h)))
    value = np.add.reduceat(mix(h + offset.astype(U)), first)
    kind = kind[first]
    return View(text[first], np.where(kind == _LITERAL, h[first], _TYPE[kind]), np.where(kind == _LITERAL, U(0), value | U(1)), kind, place[first])


def _windows(view: View, width: int, exact: bool):
    """(first token, hash) of the windows of ``width`` tokens within one text that have enough plain words."""
    n = len(view.token) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U)
    plain = np.concatenate([[0], np.cumsum(view.kind == _LITERAL)])
    at = np.flatnonzero((view.text[:n] == view.text[width - 1 :]) & (plain[width:] - plain[:n] >= min(LITERALS, width)))
    h = np.full(len(at), U(width + (_EXACT_ROLE if exact else 0)))
    for j in range(width):
        h = h + view.token[at + j] * _ROLES[j]
    return at, mix(h)


def _slots(value: np.ndarray, at: np.ndarray, width: int) -> pa.Array:
    part = value[at[:, None] + np.arange(width)] if len(at) else np.zeros((0, width), U)
    filled = part != 0
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(filled.sum(1))]).astype(np.int32)), pa.array(part[filled].view(np.int64)))


def item_windows(benchmark: DataFrame) -> DataFrame:
    """The benchmark's windows: item_id, view, w, source (view that w is of), width, item_no (which of the view's n_windows it stands for), item_at (its place), item_slots, reach (length of the item)."""

    def batch(rows: pa.RecordBatch):
        ids = rows.column("item_id").to_pylist()
        for i, raw in enumerate(texts_of(rows.column("text"))):
            views = _views([raw])
            found = []
            for v, view in enumerate(views):
                width = min(WINDOW, len(view.token))
                at, h = _windows(view, width, v == _EXACT) if width >= (1 if v == _EXACT else LITERALS) else _windows(view, len(view.token) + 1, False)
                found.append((view, width, at, h, view.place[at]))
            parts = [(v, v, *found[v][:4], np.arange(len(found[v][2]))) for v in range(len(views))]
            view, width, at, h, place = found[_PLAIN]  # a window of NAMED is matched as well by the one of PLAIN at its place
            named = found[_NAMED][4]
            no = np.searchsorted(named, place)
            same = no < len(named)
            same[same] = named[no[same]] == place[same]
            parts.append((_NAMED, _PLAIN, view, width, at[same], h[same], no[same]))
            for v, source, view, width, at, h, no in parts:
                n = len(at)
                if n:
                    yield {
                        "item_id": pa.array([ids[i]] * n, pa.int64()), "view": pa.array(np.full(n, v, np.int32)), "w": pa.array(h.view(np.int64)), "source": pa.array(np.full(n, source, np.int32)),
                        "width": pa.array(np.full(n, width, np.int32)), "item_no": pa.array(no.astype(np.int64)), "item_at": pa.array(view.place[at].astype(np.int64)), "item_slots": _slots(view.value, at, width),
                        "n_windows": pa.array(np.full(n, len(found[v][2]), np.int64)), "reach": pa.array(np.full(n, len(view.token), np.int64)),
                    }

    schema = "item_id long, view int, w long, source int, width int, item_no long, item_at long, item_slots array<long>, n_windows long, reach long"
    return map_batches(benchmark.select(F.col("item_id").cast("long"), "text"), batch, schema)


def _bitmap(windows: DataFrame) -> bytes:
    """2^_BITS bits that hold the window hashes; each task sends its own, and they are joined by OR."""

    def run(batches):
        bits = np.zeros(1 << _BITS, bool)
        for b in batches:
            bits[b.column("w").to_numpy().view(U) >> U(64 - _BITS)] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["bits"])

    out = np.zeros(1 << (_BITS - 3), np.uint8)
    for row in windows.select("w").coalesce(4).mapInArrow(run, "bits binary").toLocalIterator():
        out |= np.frombuffer(row["bits"], np.uint8)
    return out.tobytes()


def _agreeing(hit: np.ndarray, left: np.ndarray, right: np.ndarray, n: int, known: dict[int, int]) -> np.ndarray:
    """Which of ``n`` windows have no pair (item value, document value) in conflict with ``known`` or with each other; ``known`` takes the new pairs."""
    good = np.ones(n, bool)
    pairs = set(zip(left.tolist(), right.tolist()))
    times = collections.Counter(x for x, _ in pairs)
    bad = {(x, y) for x, y in pairs if (known[x] != y if x in known else times[x] > 1)}
    if bad:
        good[hit[[p in bad for p in zip(left.tolist(), right.tolist())]]] = False
    known.update(pairs - bad)
    return good


def _judge(shift, no, at, offsets, left, right, reach: int) -> tuple[int, int, int]:
    """(windows of an item that agree, these with gaps that one changed word explains, slots) in the best place of a document."""
    best = (0, 0, 0)
    order = np.lexsort((no, shift))
    at_shift = shift[order]
    runs = np.split(order, np.flatnonzero(np.diff(at_shift)) + 1)
    cuts = np.flatnonzero(np.diff([shift[r[0]] for r in runs]) > reach) + 1
    for a, b in zip([0, *cuts], [*cuts, len(runs)]):
        alone = []
        for r in runs[a:b]:
            sizes = offsets[r + 1] - offsets[r]
            hit = np.repeat(np.arange(len(r)), sizes)
            flat = np.repeat(offsets[r] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
            known: dict[int, int] = {}
            alone.append((int(_agreeing(hit, left[flat], right[flat], len(r), known).sum()), r, hit, flat))
        alone.sort(key=lambda x: -x[0])  # the alignment that agrees most comes first, others add what agrees with it
        known = {}
        kept = np.concatenate([r[_agreeing(hit, left[flat], right[flat], len(r), known)] for _, r, hit, flat in alone])
        numbers, which = np.unique(no[kept], return_index=True)
        places = at[kept][which]
        gap = np.diff(numbers) - 1
        bridged = int(gap[np.diff(places) - 1 <= WINDOW].sum())
        best = max(best, (len(numbers), len(numbers) + bridged, len(known)), key=lambda x: (x[1], x[0]))
    return best


def text_digest() -> list:
    """Two 64-bit hashes by which texts are told apart; null is the empty text."""
    text = F.coalesce("text", F.lit(""))
    return [F.xxhash64(text).alias("text_a"), F.xxhash64(F.lit("b"), text).alias("text_b")]


def clean(documents: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, enough: int = ENOUGH) -> DataFrame:
    """The rows of ``documents`` whose text holds no item. Texts are judged, not ids: rows of one id, or without one, stay or go by their own text."""
    gone = written(holders(documents, benchmark, coverage, enough).select("text_a", "text_b").distinct(), "contaminated")
    return documents.withColumns({"_a": text_digest()[0], "_b": text_digest()[1]}).join(gone, (F.col("_a") == F.col("text_a")) & (F.col("_b") == F.col("text_b")), "left_anti").select(*documents.columns)


def contaminated(documents: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, enough: int = ENOUGH) -> DataFrame:
    """doc_id, item_id, matched (agreeing windows), n_windows, coverage (with gaps that one word explains), n_slots of the documents that hold an item, with its own or with other numbers, names and units."""
    best = holders(documents, benchmark, coverage, enough).groupBy("doc_id", "item_id").agg(F.max(F.struct("coverage", "matched", "n_windows", "n_slots")).alias("m"))
    return best.select("doc_id", "item_id", "m.matched", "m.n_windows", F.round("m.coverage", 6).alias("coverage"), "m.n_slots")


def holders(documents: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, enough: int = ENOUGH) -> DataFrame:
    """As ``contaminated``, with the digest of the text (text_a, text_b) that holds the item; a row for each view of a text that does."""
    spark = documents.sparkSession
    items = written(item_windows(benchmark), "items")
    stats = items.agg(F.count(F.lit(1)).alias("n"), F.collect_set(F.struct("source", "width")).alias("widths")).first()
    shared = spark.sparkContext.broadcast((_bitmap(items), sorted((r["source"], r["width"]) for r in stats["widths"])))

    def batch(rows: pa.RecordBatch):
        bits, widths = shared.value
        bits = np.frombuffer(bits, np.uint8)
        texts, ids = texts_of(rows.column("text")), rows.column("doc_id")
        for i, j in size_chunks([len(t) for t in texts]):
            views = _views(texts[i:j])
            for v, width in widths:
                view = views[v]
                at, h = _windows(view, width, v == _EXACT)
                place = (h >> U(64 - _BITS)).astype(np.int64)
                hit = (bits[place >> 3] >> (7 - (place & 7)).astype(np.uint8) & 1).astype(bool)
                at, h = at[hit], h[hit]
                if len(at):
                    of = pa.array(view.text[at] + i)
                    yield {"doc_id": ids.take(of), "text_a": rows.column("text_a").take(of), "text_b": rows.column("text_b").take(of), "w": pa.array(h.view(np.int64)), "at": pa.array(view.place[at].astype(np.int64)), "slots": _slots(view.value, at, width)}

    def judge(rows: pa.RecordBatch):
        lists = rows.column("hits")
        begin, flat = lists.offsets.to_numpy().astype(np.int64), lists.values
        shift, no, at = (flat.field(k).to_numpy() for k in ("shift", "item_no", "item_at"))
        a, b = flat.field("item_slots"), flat.field("slots")
        offsets, offsets_b = a.offsets.to_numpy().astype(np.int64), b.offsets.to_numpy().astype(np.int64)
        left, right = a.values.to_numpy()[offsets[0] : offsets[-1]], b.values.to_numpy()[offsets_b[0] : offsets_b[-1]]
        offsets = offsets - offsets[0]
        n_windows, reach = rows.column("n_windows").to_numpy(), rows.column("reach").to_numpy()
        keep, matched, covered, slots = [], [], [], []
        for g in range(rows.num_rows):
            x, y = begin[g], begin[g + 1]
            m, c, s = _judge(shift[x:y], no[x:y], at[x:y], offsets[x : y + 1], left, right, int(reach[g]))
            if c >= coverage * n_windows[g] or m >= enough:
                keep.append(g)
                matched.append(m)
                covered.append(c / n_windows[g])
                slots.append(s)
        at = pa.array(keep, pa.int64())
        return {"doc_id": rows.column("doc_id").take(at), "text_a": rows.column("text_a").take(at), "text_b": rows.column("text_b").take(at), "item_id": rows.column("item_id").take(at), "matched": pa.array(matched, pa.int64()), "n_windows": rows.column("n_windows").take(at), "coverage": pa.array(covered, pa.float64()), "n_slots": pa.array(slots, pa.int64())}

    hits = map_batches(documents.select(F.col("doc_id").cast("long"), "text", *text_digest()), batch, "doc_id long, text_a long, text_b long, w long, at long, slots array<long>")
    right = F.broadcast(items) if stats["n"] <= BROADCAST_WINDOWS else items
    pairs = hits.join(right, "w").filter(F.size("slots") == F.size("item_slots"))
    hit = F.struct((F.col("at") - F.col("item_at")).alias("shift"), "item_no", "item_at", "item_slots", "slots")
    groups = pairs.groupBy("doc_id", "text_a", "text_b", "item_id", "view").agg(F.collect_list(hit).alias("hits"), F.max("n_windows").alias("n_windows"), F.max("reach").alias("reach"))
    return map_batches(groups.select("doc_id", "text_a", "text_b", "item_id", "hits", "n_windows", "reach"), judge, "doc_id long, text_a long, text_b long, item_id long, matched long, n_windows long, coverage double, n_slots long")
