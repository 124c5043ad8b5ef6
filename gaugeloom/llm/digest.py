"""Quartile bucket digests of documents.

Byte triplets (the first byte of a five-byte window with two of the next four) are hashed into 256
buckets and counted; each bucket's count is encoded by the quartile of the text's counts it lies in
(two bits), after a code of the text's length. Two digests are compared by a bounded difference: a
step between quartiles costs 1, two steps 2, three steps 6, the length codes cost up to 32, and the
sum is cut at twice the number of buckets, so the likeness 1 - difference / bound is from 0 to 1.

Defined cases: null is the empty text; texts under five bytes have no triplets and differ by length
only; a document that is alone is its own successor; a null doc_id comes before all others; among
equal ids the text decides the order.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import CHUNK_BYTES, bound_batches

BUCKETS = 256
WINDOW = 5
_PAIRS = [(j, k) for j in range(1, WINDOW) for k in range(j + 1, WINDOW)]
_RNG = np.random.Generator(np.random.PCG64(7))
_TABLE = _RNG.permutation(256).astype(np.uint8)
_STEP = np.array([0, 1, 2, 6], np.uint8)
_BOUND = 2 * BUCKETS
_FIRST = -(1 << 63)


def _counts(encoded: list[bytes]) -> np.ndarray:
    """Bucket counts of each text; texts are cut into pieces that overlap by a window, so memory is bounded."""
    out = np.zeros((len(encoded) + 1, BUCKETS), np.int64)
    pieces, size = [], 0

    def run():
        buf = np.frombuffer(b"".join(p for _, p in pieces), np.uint8)
        base = np.repeat(np.array([i for i, _ in pieces], np.int64) * BUCKETS, [len(p) for _, p in pieces])
        ends = np.cumsum([len(p) for _, p in pieces])
        tail = WINDOW - 1
        for back in range(1, tail + 1):
            base[np.maximum(ends - back, 0)] = len(encoded) * BUCKETS
        base = base[: len(buf) - tail]
        n = len(base)
        for number, (j, k) in enumerate(_PAIRS):
            h = _TABLE[_TABLE[_TABLE[buf[:n] ^ np.uint8(37 * number + 11)] ^ buf[j : j + n]] ^ buf[k : k + n]]
            out.reshape(-1)[:] += np.bincount(base + h, minlength=out.size)
        pieces.clear()

    for i, data in enumerate(encoded):
        for at in range(0, len(data) - WINDOW + 1, CHUNK_BYTES):
            piece = data[at : at + CHUNK_BYTES + WINDOW - 1]
            if size + len(piece) > CHUNK_BYTES and pieces:
                run()
                size = 0
            pieces.append((i, piece))
            size += len(piece)
    if pieces:
        run()
    return out[:-1]


def fingerprints(texts: list[str]) -> list[str]:
    """The digest of each text: two hexadecimal digits of length, then a digit for every two buckets."""
    out: list[str] = []
    for a in range(0, len(texts), 512):
        encoded = [t.encode("utf-8", "surrogatepass") for t in texts[a : a + 512]]
        counts = _counts(encoded)
        quartile = np.partition(counts, (63, 127, 191), axis=1)[:, (63, 127, 191)]
        codes = sum((counts > quartile[:, q : q + 1]).astype(np.uint8) for q in range(3))
        packed = codes[:, 0::4] | codes[:, 1::4] << 2 | codes[:, 2::4] << 4 | codes[:, 3::4] << 6
        length = np.minimum(255, np.round(8 * np.log2(1 + np.array([len(e) for e in encoded], float)))).astype(np.uint8)
        out += [bytes([n]).hex() + row.tobytes().hex() for n, row in zip(length, packed)]
    return out


def _codes(prints: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(bytes.fromhex("".join(prints)), np.uint8).reshape(len(prints), 1 + BUCKETS // 4)
    codes = np.stack([raw[:, 1:] >> s & 3 for s in (0, 2, 4, 6)], axis=2).reshape(len(prints), -1)
    return raw[:, 0].astype(np.int64), codes


def likeness(a: list[str], b: list[str]) -> np.ndarray:
    """1 for equal digests, 0 from the bound of the difference on."""
    if not a:
        return np.zeros(0)
    (la, ca), (lb, cb) = _codes(a), _codes(b)
    steps = np.where(ca > cb, ca - cb, cb - ca)
    difference = _STEP[steps].sum(axis=1, dtype=np.int64) + np.minimum(np.abs(la - lb), 32)
    return 1 - np.minimum(difference, _BOUND) / _BOUND


def edited_text(text: str, following: str) -> str:
    """The last half of the code points (rounded down) replaced by the first as many of the next document."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def compare_with_edits(documents: DataFrame, partitions: int | None = None) -> DataFrame:
    """Each document's digest beside that of its edited text and of the next document.

    Documents are dealt to ranges of doc_id whose bounds are ids of the table; each range also gets a copy
    of the document that begins the next one (the first document after the last range), so a task
    finds every successor in its own sorted rows, and nothing is gathered.
    """
    spark = documents.sparkSession
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_FIRST)).alias("at"))
    found = rows.agg(F.min("at").alias("first"), F.percentile_approx("at", [i / parts for i in range(1, parts)] or [0.5], 10000).alias("cuts")).first()
    bounds = np.unique(np.array([found["first"], *(found["cuts"] or [])] if found["first"] is not None else [0], np.int64))

    @F.pandas_udf("array<int>")
    def ranges(at: pd.Series) -> pd.Series:
        """2 * range, and for the first id of a range also 2 * (range before) + 1."""
        own = np.searchsorted(bounds, at.to_numpy(), "right") - 1
        begins = bounds[own] == at.to_numpy()
        return pd.Series([[2 * o, 2 * ((o - 1) % len(bounds)) + 1] if b else [2 * o] for o, b in zip(own.tolist(), begins.tolist())])

    dealt = rows.withColumn("to", F.explode(ranges("at"))).withColumn("range", F.shiftright("to", 1)).withColumn("copy", F.col("to") % 2)
    dealt = dealt.select("range", "copy", "at", "text", "doc_id").repartition(len(bounds), "range").sortWithinPartitions("range", "copy", "at", "text")
    fields = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches):
        held = None  # the last row of the batch before
        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("range", "copy", "doc_id", "text"))))
            prints = fingerprints([r[3] for r in rows])
            if held is not None:
                rows, prints = [held[0], *rows], [held[1], *prints]
            held = (rows[-1], prints[-1])
            at = [i for i in range(len(rows) - 1) if not rows[i][1]]
            if not at:
                continue
            edits = [edited_text(rows[i][3], rows[i + 1][3]) for i in at]
            shas = [hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edits]
            own, edited = [prints[i] for i in at], fingerprints(edits)
            columns = [
                pa.array([rows[i][2] for i in at], pa.int64()), pa.array([len(rows[i][3]) for i in at], pa.int64()), pa.array(shas), pa.array(own), pa.array(edited),
                pa.array(likeness(own, edited)), pa.array(likeness(own, [prints[i + 1] for i in at])),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=fields)

    bound_batches(dealt.sparkSession)
    return dealt.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
