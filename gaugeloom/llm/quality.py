"""Quality classifier: random Fourier features, ridge by normal equations, isotonic calibration.

Each text gives a few statistics of its whole length (words, lines, cases, symbols, repetition). Their
standardised values go through random Fourier features, which approximate a Gaussian kernel. Each task
sums the normal equations of its rows, the sums are added by Spark, and one small system gives ridge
weights. Scores are then mapped to frequencies by isotonic regression on texts that the weights of
another fold scored.

Defined cases: null and empty texts have all statistics 0 and a score like any other; ties are equal;
without both labels among the training rows every score is the share of label 1 (or 0.5).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytehash import WHITE, buffer_of, owner, span_hashes, spans
from .shared import held_out, map_batches, size_chunks, texts_of, training_rows

#: At most so many labelled rows of each class are learnt from.
PER_CLASS = 5000
FEATURES = 192
THRESHOLD = 0.5
_FOLDS = 2

_CLASS = np.zeros(256, np.uint8)  # 1 lower, 2 upper, 3 digit, 4 sentence punctuation, 5 other ASCII punctuation, 6 white, 7 beyond ASCII
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 7
_CLASS[[ord(c) for c in ".,;:?'\"()-"]] = 4
_CLASS[[ord(c) for c in "!#$%&*+/<=>@[\\]^_`{|}~"]] = 5
_CLASS[WHITE] = 6
STATISTICS = (
    "log_bytes log_words word_length upper digit punctuation symbol white beyond_ascii exclaim pipe capitalised symbol_end distinct_words top_repeat "
    "repeated_lines line_length distinct_trigrams sentence_ends long_words".split()
)


def _share(of: np.ndarray, by: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(of, minlength=n) / np.maximum(by, 1)


def _statistics(texts: list[str]) -> np.ndarray:
    n = len(texts)
    buf, starts = buffer_of(texts)
    kinds = _CLASS[buf]
    size = np.diff(starts) - 1
    counts = np.stack([np.add.reduceat(kinds == k, starts[:-1]) if n else np.zeros(0) for k in range(8)], axis=1) if n else np.zeros((0, 8))
    per_byte = counts / np.maximum(size, 1)[:, None]
    a, b = spans(WHITE[buf])
    text = owner(starts, a)
    n_words = np.bincount(text, minlength=n)
    h = span_hashes(buf, a, b)
    length = b - a
    last, first = kinds[b - 1] if len(b) else np.zeros(0), kinds[a] if len(a) else np.zeros(0)

    def distinct(keys, of):
        """Share of distinct keys, and share of the keys equal to another of their text."""
        order = np.lexsort((keys, of))
        k, o = keys[order], of[order]
        new = np.ones(len(k), bool)
        if len(k) > 1:
            new[1:] = (k[1:] != k[:-1]) | (o[1:] != o[:-1])
        run = np.diff(np.append(np.flatnonzero(new), len(k)))
        total = np.bincount(of, minlength=n)
        top = np.zeros(n)
        np.maximum.at(top, o[new], run)
        return np.bincount(o[new], minlength=n) / np.maximum(total, 1), top / np.maximum(total, 1)

    different, top = distinct(h, text)
    same3 = text[2:] == text[:-2]
    tri = (h[:-2] * np.uint64(3) + h[1:-1] * np.uint64(5) + h[2:] * np.uint64(7))[same3] if len(h) > 2 else np.zeros(0, np.uint64)
    tri_different, _ = distinct(tri, text[:-2][same3] if len(h) > 2 else np.zeros(0, np.int64))
    la, lb = spans(buf == 10)
    line_text = owner(starts, la)
    line_different, _ = distinct(span_hashes(buf, la, lb), line_text)
    n_lines = np.bincount(line_text, minlength=n)
    return np.stack(
        [
            np.log1p(size), np.log1p(n_words), np.bincount(text, length, minlength=n) / np.maximum(n_words, 1), per_byte[:, 2], per_byte[:, 3], per_byte[:, 4], per_byte[:, 5],
            per_byte[:, 6], per_byte[:, 7], np.add.reduceat(buf == 33, starts[:-1]) / np.maximum(size, 1), np.add.reduceat(buf == 124, starts[:-1]) / np.maximum(n_words, 1),
            _share(text[first == 2], n_words, n), _share(text[last == 5], n_words, n), different, top,
            np.where(n_lines > 0, 1 - line_different, 0), np.log1p(np.bincount(line_text, lb - la, minlength=n) / np.maximum(n_lines, 1)), tri_different,
            np.add.reduceat(buf == 46, starts[:-1]) / np.maximum(n_words, 1), _share(text[length > 14], n_words, n),
        ],
        axis=1,
    )


def statistics(texts: list[str]) -> np.ndarray:
    """A row of STATISTICS for each text; all zero for an empty one."""
    out = np.zeros((len(texts), len(STATISTICS)))
    for i, j in size_chunks([len(t) for t in texts]):
        out[i:j] = _statistics(texts[i:j])
        out[i:j][[not t for t in texts[i:j]]] = 0
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    waves: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    steps: np.ndarray  # isotonic: from this raw score on ...
    values: np.ndarray  # ... this frequency

    def scores(self, stats: np.ndarray) -> np.ndarray:
        raw = features(stats, self.mean, self.scale, self.waves, self.phase) @ self.weights
        return np.interp(raw, self.steps, self.values)


def features(stats, mean, scale, waves, phase) -> np.ndarray:
    """Random Fourier features with a constant and the standardised statistics beside them."""
    x = np.clip((stats - mean) / scale, -6, 6)
    return np.concatenate([np.ones((len(x), 1)), x, np.cos(x @ waves + phase) * np.sqrt(2 / waves.shape[1])], axis=1)


def isotonic(raw: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: raw scores and non-decreasing frequencies between which to interpolate."""
    order = np.lexsort((y, raw))
    blocks: list[list[float]] = []  # sum of y, weight, first raw, last raw
    for r, v, w in zip(raw[order], y[order], weight[order]):
        blocks.append([v * w, w, r, r])
        while len(blocks) > 1 and (blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1] or blocks[-2][3] == blocks[-1][2]):
            s, w2, _, hi = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += w2
            blocks[-1][3] = hi
    steps = np.array([x for b in blocks for x in (b[2], b[3])])
    # half a row of either label keeps pure ends off 0 and 1
    values = np.array([v for b in blocks for v in [(b[0] + 0.5 * weight.mean()) / (b[1] + weight.mean())] * 2])
    values = np.maximum.accumulate(values)
    steps, at = np.unique(steps, return_index=True)
    return steps, values[at]


def _solve(a: np.ndarray, b: np.ndarray, ridge: float) -> np.ndarray:
    penalty = np.full(len(b), ridge)
    penalty[0] = 0
    return np.linalg.solve(a + np.diag(penalty) + 1e-9 * np.eye(len(b)), b)


def fit(documents: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, ridge: float = 0.3, width: float = 3.0, parts: int = 8) -> Model:
    """Statistics of the sampled rows are written; two passes over them sum moments and normal equations by task.

    The sums of ``parts`` tasks are added by one more, so the driver gets one array (0.7 MB for the equations), however many
    partitions the session has.
    """
    from .shared import written

    rows = training_rows(documents, labels, "quality", per_class)
    k = len(STATISTICS)

    def stats_of(batch: pa.RecordBatch) -> dict:
        x = statistics(texts_of(batch.column("text")))
        return {"doc_id": batch.column("doc_id"), "y": batch.column("y"), "x": pa.array(list(x), pa.list_(pa.float64()))}

    sample = written(map_batches(rows, stats_of, "doc_id long, y int, x array<double>"), "quality").repartition(parts, F.xxhash64("doc_id")).coalesce(parts)
    rng = np.random.Generator(np.random.PCG64(3))
    waves, phase = rng.normal(0, 1 / width, (k, FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES)

    def sums(fn, size: int) -> np.ndarray:
        """The sum over tasks of ``fn(x, y, fold)``, an array of ``size`` numbers; a task sends one row."""

        def run(batches):
            total = np.zeros(size)
            for b in batches:
                if b.num_rows:
                    x = np.array(b.column("x").to_pylist()).reshape(b.num_rows, k)
                    total += fn(x, b.column("y").to_numpy(zero_copy_only=False).astype(float), b.column("doc_id").to_numpy(zero_copy_only=False) // 3 % _FOLDS)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["s"])

        def add(batches):
            total = np.zeros(size)
            for b in batches:
                for x in b.column("s"):
                    total += np.frombuffer(x.as_buffer())
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["s"])

        return np.frombuffer(sample.mapInArrow(run, "s binary").repartition(1).mapInArrow(add, "s binary").first()["s"])

    moments = sums(lambda x, y, f: np.concatenate([[len(y), y.sum()], x.sum(0), (x * x).sum(0)]), 2 + 2 * k)
    n, ones = moments[:2]
    mean = moments[2 : 2 + k] / max(n, 1)
    scale = np.sqrt(np.maximum(moments[2 + k :] / max(n, 1) - mean**2, 1e-8))
    d = 1 + k + FEATURES
    if not 0 < ones < n:
        prior = ones / n if n else 0.5
        return Model(mean, scale, waves, phase, np.zeros(d), np.array([0.0]), np.array([prior]))
    balance = np.array([0.5 * n / (n - ones), 0.5 * n / ones])

    def normal(x, y, fold):
        z = features(x, mean, scale, waves, phase)
        w = balance[y.astype(int)]
        out = np.zeros((_FOLDS, d, d + 1))
        for i in range(_FOLDS):
            zi, wi = z[fold == i], w[fold == i]
            out[i, :, :d] = (zi * wi[:, None]).T @ zi
            out[i, :, d] = zi.T @ (wi * y[fold == i])
        return out.reshape(-1)

    equations = sums(normal, _FOLDS * d * (d + 1)).reshape(_FOLDS, d, d + 1)
    whole = equations.sum(0)
    weights = _solve(whole[:, :d], whole[:, d], ridge)
    others = [_solve(*(lambda e: (e[:, :d], e[:, d]))(whole - equations[i]), ridge) for i in range(_FOLDS)]
    found = sample.select("doc_id", "y", "x").toPandas().sort_values(["doc_id", "y"])
    x, y = np.array(found["x"].tolist()).reshape(len(found), k), found["y"].to_numpy(float)
    z, fold = features(x, mean, scale, waves, phase), found["doc_id"].to_numpy() // 3 % _FOLDS
    raw = np.where(fold == 0, z @ others[0], z @ others[1])
    # the sample is balanced by class; calibration is for equal classes, so 0.5 separates them
    steps, values = isotonic(raw, y, balance[y.astype(int)])
    return Model(mean, scale, waves, phase, weights, steps, values)


def score(documents: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), threshold: float = THRESHOLD) -> DataFrame:
    """``keep`` columns, score and predicted for every row, by whole texts."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def batch(rows: pa.RecordBatch) -> dict:
        scores = shared.value.scores(statistics(texts_of(rows.column("text"))))
        return {c: rows.column(c) for c in keep} | {"score": pa.array(scores), "predicted": pa.array((scores >= threshold).astype(np.int32))}

    kinds = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in keep)
    return map_batches(documents.select(*dict.fromkeys([*keep, "text"])), batch, f"{kinds}, score double, predicted int")


def classify(documents: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    scored = score(documents, fit(documents, labels, per_class))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
