"""Importance resampling towards a target text set.

Texts are bags of hashed word n-grams. A bucket's gain says how much more frequent it is in the target than in the corpus,
and a document's weight is the sum of the gains of its features, read off an array of all gains. Weights with Gumbel noise
of a hash of the id make scores, of which the highest share is drawn: a sample without replacement by importance.

The cutoff is found by bracketing: a quantile sketch of the scores proposes a bracket, exact counts of the scores above and
within it show whether the cutoff lies inside, a wider one is taken if not, and only the bracket is sorted to locate it.
Sorting is by ranges, each row's place being its place in its range behind the counts of the ranges before.

A feature's CRC-32 is put together from those of its words: the CRC of a joined string is the first's, shifted by the length
of the second by table, with the second's. So no n-gram is ever built.

Defined cases: null and empty texts have no features, weight 0 and no place among those that may be drawn. A null id hashes
as an empty one, and comes after all others in ties; rows that are equal in score and id are drawn in any order, with the
same result but for their places. Repeated rows count as often as they are there. An empty corpus gives no rows, an empty target
gains of the smoothed counts. Words of any length are hashed whole.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import bound_batches, dropped, map_batches, written

BUCKETS, LONGEST_RUN, LEAST_WORDS = 10_000, 3, 20
#: Bytes of one numpy pass.
PASS_BYTES = 1 << 20
#: Words of more bytes than this are hashed one by one.
SHORT = 64
#: Relative error of the quantile sketch, as one over this.
ACCURACY = 1000

_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = (c >> np.uint32(1)) ^ (np.uint32(0xEDB88320) * (c & np.uint32(1)))
    return c


_STEP = _crc_table()
_BYTE = np.uint32(0xFF)


def _after_zero(c: np.ndarray) -> np.ndarray:
    """The register after one more zero byte."""
    return _STEP[c & _BYTE] ^ (c >> np.uint32(8))


def _tables(lengths: int) -> np.ndarray:
    """(length, byte of the register, value): what each byte of a register becomes after that many zero bytes."""
    out = np.empty((lengths, 4, 256), np.uint32)
    for q in range(4):
        out[0, q] = np.arange(256, dtype=np.uint32) << np.uint32(8 * q)
    for n in range(1, lengths):
        out[n] = _after_zero(out[n - 1])
    return out


_SHIFT = _tables(SHORT + 2).reshape(-1)


def _doubled() -> list[np.ndarray]:
    """The same for 1, 2, 4, ... zero bytes."""
    out = [_tables(2)[1]]
    for _ in range(40):
        t = out[-1]
        out.append(t[0][t & _BYTE] ^ t[1][(t >> np.uint32(8)) & _BYTE] ^ t[2][(t >> np.uint32(16)) & _BYTE] ^ t[3][t >> np.uint32(24)])
    return out


_DOUBLED = _doubled()


def _shifted(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """CRCs moved on by ``n`` bytes, so that the CRC of what follows can be added."""
    small = np.minimum(n, SHORT + 1)
    at = small * 1024
    out = _SHIFT[at + (crc & _BYTE)] ^ _SHIFT[at + 256 + ((crc >> np.uint32(8)) & _BYTE)] ^ _SHIFT[at + 512 + ((crc >> np.uint32(16)) & _BYTE)] ^ _SHIFT[at + 768 + (crc >> np.uint32(24))]
    far = np.flatnonzero(n > SHORT + 1)
    if len(far):
        c, left = crc[far], n[far].copy()
        for t in _DOUBLED:
            odd = (left & 1) > 0
            d = c[odd]
            c[odd] = t[0][d & _BYTE] ^ t[1][(d >> np.uint32(8)) & _BYTE] ^ t[2][(d >> np.uint32(16)) & _BYTE] ^ t[3][d >> np.uint32(24)]
            left >>= 1
            if not left.any():
                break
        out[far] = c
    return out


def _word_crcs(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The CRC of each word, one byte of all words at a time; long words one by one."""
    order = np.argsort(-np.minimum(length, SHORT + 1), kind="stable")
    n_long = int((length > SHORT).sum())
    crc = np.zeros(len(start), np.uint32)
    for i in order[:n_long].tolist():
        crc[i] = zlib.crc32(data[start[i] : start[i] + length[i]].tobytes())
    order = order[n_long:]
    if len(order):
        sizes, at = length[order], start[order]
        alive = np.searchsorted(-sizes, -np.arange(sizes[0]), "left")  # words longer than j come first
        state = np.full(len(order), 0xFFFFFFFF, np.uint32)
        for j, m in enumerate(alive.tolist()):
            s = state[:m]
            state[:m] = _STEP[(s ^ data[at[:m] + j]) & _BYTE] ^ (s >> np.uint32(8))
        crc[order] = state ^ np.uint32(0xFFFFFFFF)
    return crc


def _features(data: np.ndarray, offsets: np.ndarray, longest: int):
    """Of texts ``data[offsets[i]:offsets[i + 1]]``: the number of words of each, and (text, CRC) of all runs of 1 to ``longest`` words."""
    data = _LOWER[data]
    n_texts = len(offsets) - 1
    inside = _WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    behind = np.zeros(len(data), bool)
    behind[:-1] = inside[1:]
    length = np.flatnonzero(inside & (~behind | edge[1:])) + 1 - start
    text = np.searchsorted(offsets, start, "right") - 1
    crc = _word_crcs(data, start, length)
    spaced = _shifted(np.full(len(crc), zlib.crc32(b" "), np.uint32), length) ^ crc
    texts, found, run = [text], [crc], crc
    for k in range(1, longest):
        run = _shifted(run[:-1], length[k:] + 1) ^ spaced[k:] if len(run) > 1 else run[:0]
        m = len(run)
        same = text[:m] == text[k : k + m]
        texts.append(text[:m][same])
        found.append(run[same])
    return np.bincount(text, minlength=n_texts), np.concatenate(texts), np.concatenate(found)


def _chunks(column: pa.Array):
    """(first row, bytes, offsets) of runs of texts of about PASS_BYTES; null is empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = pc.fill_null(column, "") if column.null_count else column
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, where, raw = column.buffers()
    offsets = np.frombuffer(where, wide)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + PASS_BYTES, "right")) - 1)
        yield i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def bucket_counts(texts: DataFrame, text: str = "text", buckets: int = BUCKETS, longest: int = LONGEST_RUN) -> DataFrame:
    """(bucket, n): how many features of all texts fall into each bucket that has any. A task sends one row a bucket at most."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, data, offsets in _chunks(batch.column(0)):
                total += np.bincount(_features(data, offsets, longest)[2] % np.uint32(buckets), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    bound_batches(texts.sparkSession)
    return texts.select(text).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed frequencies in the target and the corpus, rounded down, by bucket."""
    k = float(len(corpus))
    s, t = corpus.astype(np.float64), target.astype(np.float64)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + k) / ((s + 1) * (t.sum() + k)))).astype(np.int64)


def weights(documents: DataFrame, gain: np.ndarray, keep: tuple[str, ...] = ("doc_id",), text: str = "text", longest: int = LONGEST_RUN) -> DataFrame:
    """``keep`` columns, n_words, n_features and weight of every row."""
    shared = documents.sparkSession.sparkContext.broadcast(gain)

    def batch(rows: pa.RecordBatch) -> dict:
        column, of = rows.column(text), shared.value
        n_words, n_features, weight = (np.zeros(len(column), np.int64) for _ in range(3))
        for i, data, offsets in _chunks(column):
            words, owner, crc = _features(data, offsets, longest)
            j = i + len(words)
            n_words[i:j] = words
            n_features[i:j] = np.bincount(owner, minlength=len(words))
            weight[i:j] = np.bincount(owner, of[crc % np.uint32(len(of))], minlength=len(words))  # sums of whole numbers, exact in doubles
        return {c: rows.column(c) for c in keep} | {"n_words": pa.array(n_words), "n_features": pa.array(n_features), "weight": pa.array(weight)}

    kinds = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in keep)
    return map_batches(documents.select(*dict.fromkeys([*keep, text])), batch, f"{kinds}, n_words long, n_features long, weight long")


def gumbel(key: Column, seed: int) -> Column:
    """Thousandths of Gumbel noise from a hash of the key, rounded down."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def placed(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Written ``rows`` with ``place`` (1, 2, 3, ...) in an order, by ranges: a row's place in its range behind the counts of the ranges before."""
    sorted_rows = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), name)
    part = F.shiftright("_at", 33)
    sizes = sorted_rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))  # as many rows as there are ranges
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    out = sorted_rows.withColumn("_part", part).join(F.broadcast(before), "_part")
    return out.withColumn("place", F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_at", "_part", "_before")


def bracket(scored: DataFrame, k: int, n: int, accuracy: int = ACCURACY) -> tuple[int, int, int]:
    """(low, high, above): the k-th highest of ``n`` scores is from low to high, and ``above`` scores are higher than high.

    One pass of a quantile sketch gives brackets of growing width around the rank; exact counts, all in one more pass, show which of them
    hold it, and the narrowest is taken. The last one reaches from the least to the greatest score, so there is always one.
    """
    middle, margins = 1 - (k - 0.5) / n, [2 / accuracy * 4**i for i in range(6)]
    ends = [(max(0.0, middle - m), min(1.0, middle + m)) for m in margins] + [(0.0, 1.0)]
    found = scored.agg(F.percentile_approx("score", [x for e in ends for x in e], accuracy).alias("q"), F.min("score").alias("low"), F.max("score").alias("high")).first()
    brackets = [(found["q"][2 * i], found["q"][2 * i + 1]) for i in range(len(ends) - 1)] + [(found["low"], found["high"])]
    counts = scored.agg(*(F.count_if(condition).alias(f"{name}{i}") for i, (low, high) in enumerate(brackets) for name, condition in (("above", F.col("score") > high), ("upto", F.col("score") >= low)))).first()
    for i, (low, high) in enumerate(brackets):
        if counts[f"above{i}"] < k <= counts[f"upto{i}"]:
            return low, high, counts[f"above{i}"]
    raise AssertionError("the widest bracket holds every score")


def resample(
    documents: DataFrame, target: DataFrame, percent: int = 5, key: str = "doc_id", text: str = "text", seed: int = 42,
    buckets: int = BUCKETS, longest: int = LONGEST_RUN, least_words: int = LEAST_WORDS, accuracy: int = ACCURACY,
) -> DataFrame:
    """``key``, n_features, weight, score and rank of every document; rank is null for those that aren't drawn.

    Of the documents with at least ``least_words`` words, ``percent`` in a hundred (rounded down) with the highest scores are drawn, ties to the smaller key.
    """
    def counted(texts: DataFrame) -> np.ndarray:
        out = np.zeros(buckets, np.int64)
        for row in bucket_counts(texts, text, buckets, longest).collect():  # at most ``buckets`` rows
            out[row["bucket"]] = row["n"]
        return out

    gain = gains(counted(documents), counted(target))
    scored = weights(documents, gain, (key,), text, longest).withColumn("score", F.col("weight") + gumbel(F.col(key), seed))
    scored = written(scored.withColumn("row", F.monotonically_increasing_id()), "scored")  # parts rows that are equal in all else
    out = [key, "n_features", "weight", "score"]
    able = scored.filter(F.col("n_words") >= least_words)
    n = able.count()
    k = percent * n // 100
    unplaced = scored.select(*out, F.lit(None).cast("long").alias("rank"))
    if not k:
        return unplaced
    low, high, above = bracket(able, k, n, accuracy)
    order = [F.col("score").desc(), F.col(key).asc_nulls_last(), F.col("row")]
    inside = placed(able.filter(F.col("score").between(low, high)), order, "bracket")
    drawn = F.when(F.col("place") <= k - above, F.col("place") + above)
    rest = unplaced.filter(~((scored["n_words"] >= least_words) & (scored["score"] >= low)))
    parts = rest.unionByName(inside.select(*out, drawn.alias("rank")))
    if above:
        parts = parts.unionByName(placed(able.filter(F.col("score") > high), order, "above").select(*out, F.col("place").alias("rank")))
    return parts
