"""N-gram Jaccard join by universe partition and the pigeonhole principle, exact at any threshold.

A text is the set of its distinct k-word shingles, as 64-bit hashes. Texts of equal sets form a class;
classes are what is joined. Set sizes are cut into bands so that a set can only be similar to sets of its
own band or the one below. For a band, H is the largest symmetric difference of two similar sets. The
universe is hashed into m = H + 1 + slack segments, so of two similar sets at least 1 + slack segments are
equal. A set is indexed under the hash of its part in each segment. Parts that are empty, or hold only
shingles that are common in a sample of the corpus, are shared by too many sets to be worth it: a part
with another shingle is strong, and a set is indexed by its strong parts alone where its weak ones are no
more than the slack. The slack is allocated by cost, segments against sets that have more weak parts.
Those are also indexed under the one-deletion neighbourhoods of their strong parts: if all equal segments of
two similar sets are weak, then among any (weak - slack) strong segments of the one there is one that
differs by exactly one shingle; the smallest that have two strong shingles are probed. A set that has not
so many is indexed by all its parts. So the sample moves cost about, never the result.

Signatures are shuffled as packed arrays (four bytes a signature and one head for the signatures of a
class in a hash bucket), and a task streams over its buckets and passes on only signatures that two classes
share; what it holds is one entry a distinct signature of a hash bucket, however many classes share it. Those of
every other band go first, so half of all are on disk at a time.

Most of the classes that a signature brings together have little else in common, and the more, the larger the corpus is.
So candidates are first held against each other by parities of their sets (see _sketch), which never reject similar
ones; only the sets of those that pass are written and moved.

Candidates are not paired within a bucket. Each bucket has a pivot that its members are verified against, and
members that a link joins to the pivot's component are settled. Of buckets that still hold several components, those of
up to SMALL members are settled by their pairs, at most (SMALL - 1) / 2 a member, and so are those of up to MIDDLE, whose
pairs are told apart by sketches within the task that has the bucket, so that only pairs left open are passed on. Sets of larger ones
are encoded by how they differ from the centre of their group, and indexed anew under rare differences.
Buckets of that index have PIVOTS pivots at a time, and go on until one component or no unmet pair is left.
So links that could join components are never lost. Verification is exact.

Defined cases: null and empty texts have the empty set and are linked with nothing; a null doc_id takes part
in nothing and has a null component; repeated ids are joined like any other rows; ties go to the smaller id.
"""

from __future__ import annotations

import math
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bytehash import mix, shingles
from .components import components
from .shared import bound_batches, dropped, map_batches, sieve, size_chunks, swept, texts_of, written

U = np.uint64
#: Members of a bucket whose pairs across components are all verified.
SMALL = 8
#: Members of a bucket whose pairs are all held against each other by sketches; what more members than that share goes to the second index.
MIDDLE = 1024
#: Pivots of a bucket in the first round of the second index; each round has four times as many as the one before.
PIVOTS = 64
#: Most shingles that count as common (eight bytes each, sent to all tasks).
COMMON = 500_000
#: Signatures are shuffled in so many turns, by their band.
TURNS = 2
#: Signatures that a task gathers before it passes them on.
FLUSH = 300_000
#: Documents are found by a broadcast of at most so many ids (16 bytes each), else by a shuffle.
BROADCAST_IDS = 200_000
#: Slots in which the rarer shingles of a group are counted.
RARE_SLOTS = 1 << 14
#: How much wider each band of w is than the one before.
_STEP = 1.5


class Scheme:
    """Bands, differences and segments for the threshold ``percent`` / 100."""

    def __init__(self, percent: int):
        if not 50 <= percent <= 100:
            raise ValueError("percent must be from 50 to 100")
        self.percent = percent
        self.edges = [1]

    def band(self, size: int) -> int:
        """The band of a set size: band j holds sizes from edges[j] to edges[j] * 100 // percent."""
        while self.edges[-1] <= size:
            self.edges.append(self.edges[-1] * 100 // self.percent + 1)
        return int(np.searchsorted(self.edges, size, "right")) - 1

    @lru_cache(maxsize=None)  # noqa: B019
    def segments(self, band: int) -> tuple[int, int]:
        """(number of segments, slack) of a band; 0 segments where similar sets are equal."""
        low = self.edges[band]
        top = low * 100 // self.percent
        largest = top * 100 // self.percent  # of a partner in the band above
        difference = (100 - self.percent) * (top + largest) // (100 + self.percent)
        if difference == 0:
            return 0, 0
        best = None
        for slack in sorted({0, 1, 2, 3, 4, 6, 8, *(difference * x // 100 for x in range(2, 101, 2))}):
            m = difference + 1 + slack
            cost = m + self._more_weak(m, low, slack) * (2 * top + m)
            if best is None or cost < best[0]:
                best = (cost, m, slack)
        return best[1], best[2]

    @staticmethod
    def _more_weak(m: int, size: int, slack: int) -> float:
        """About the chance that a set of ``size`` leaves more than ``slack`` of ``m`` segments weak (normal law; 2 % besides empty ones)."""
        p = min(0.99, (math.exp(size * math.log1p(-1 / m)) if m > 1 else 0.0) + 0.02)
        return 0.5 * math.erfc((slack + 0.5 - m * p) / math.sqrt(2 * m * p * (1 - p)))


def signatures(found: np.ndarray, band: int, scheme: Scheme, index: bool, common: np.ndarray = np.zeros(0, U)) -> np.ndarray:  # noqa: B008
    """Signatures of a set (sorted distinct hashes) under a band's scheme; ``index``: the band is its own; ``common``: sorted shingles that make no part strong."""
    m, slack = scheme.segments(band)
    if m == 0 or not len(found):
        return np.zeros(0, U)
    segment = (mix(found ^ U(0x5851F42D4C957F2D)) % U(m)).astype(np.int64)
    part = mix(found + U(0x14057B7EF767814F))
    total = np.zeros(m, U)
    np.add.at(total, segment, part)
    count = np.bincount(segment, minlength=m)
    rare = np.ones(len(found), bool)
    if len(common):
        at = np.searchsorted(common, found)
        rare = common[np.minimum(at, len(common) - 1)] != found
    strength = np.bincount(segment[rare], minlength=m)
    strong = strength > 0
    seed = mix(np.arange(m, dtype=U) * U(2) + mix(np.array([1000 * band + scheme.percent], U)))
    missing = int(m - strong.sum()) - slack
    if missing <= 0:
        return np.unique(mix(total[strong] ^ seed[strong]))
    probed = np.flatnonzero(strength > 1)
    if len(probed) < missing:  # too little that is its own: all parts count
        plain = (count > 0) | (int((count == 0).sum()) > slack)
        use = np.flatnonzero(strong)
    else:
        plain = strong
        use = np.flatnonzero(strong) if index else probed[np.argsort(count[probed], kind="stable")][:missing]
    chosen = np.zeros(m, bool)
    chosen[use] = True
    less = chosen[segment] & (strength[segment] - rare > 0)  # what is left is still strong
    salt = U(0xD1342543DE82EF95)
    out = [mix(total[plain] ^ seed[plain]), mix(total[use] ^ seed[use] ^ salt), mix((total[segment[less]] - part[less]) ^ seed[segment[less]] ^ salt)]
    return np.unique(np.concatenate(out))


def common_shingles(documents: DataFrame, k: int, sample: int = 2000, share: float = 0.0025) -> np.ndarray:
    """Shingles in at least ``share`` of the classes among ``sample`` documents (by md5 of the id), the COMMON most frequent, sorted."""

    def batch(rows: pa.RecordBatch):
        for text in texts_of(rows.column("text")):
            found = shingles([text], k)[0]
            if len(found):
                yield {"ent": pa.array(np.full(len(found), _digest(found)[0])), "shingle": pa.array(found.view(np.int64))}

    ids = documents.filter("doc_id is not null").select("doc_id").orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(sample)
    texts = documents.join(F.broadcast(ids.distinct()), "doc_id", "left_semi").select("text")
    counted = map_batches(texts, batch, "ent long, shingle long").distinct().groupBy("shingle").count()
    least = max(3, math.ceil(share * sample))
    often = counted.filter(F.col("count") >= least).orderBy(F.desc("count"), "shingle").limit(COMMON)
    found = [r["shingle"] for r in often.select("shingle").collect()]
    return np.sort(np.array(found, np.int64).view(U))


def sets_of(documents: DataFrame, k: int, id_bits: int = 63, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_shingles and the set's 126-bit digest (d1, d2) of every row, and its ``keep`` columns; ``id_bits``: of d1."""

    def batch(rows: pa.RecordBatch) -> dict:
        texts = texts_of(rows.column("text"))
        n, digest = np.zeros(len(texts), np.int64), np.zeros((len(texts), 2), np.int64)
        for i, j in size_chunks([len(t) for t in texts]):
            for r, found in enumerate(shingles(texts[i:j], k), i):
                n[r], digest[r] = len(found), _digest(found, id_bits)
        return {"doc_id": rows.column("doc_id"), "n_shingles": pa.array(n), "d1": pa.array(digest[:, 0]), "d2": pa.array(digest[:, 1])} | {c: rows.column(c) for c in keep}

    kinds = "".join(f", `{c}` {documents.schema[c].dataType.simpleString()}" for c in keep)
    return map_batches(documents.select(F.col("doc_id").cast("long"), "text", *keep), batch, "doc_id long, n_shingles long, d1 long, d2 long" + kinds)


def _digest(found: np.ndarray, id_bits: int = 63) -> tuple[int, int]:
    """Two numbers of a set, even since the lowest bit marks probes in packed signatures; the first of ``id_bits`` bits."""
    both = mix(np.array([mix(found).sum(), mix(found ^ U(0xA5A5A5A5A5A5A5A5)).sum()], U) + U(len(found)))
    return int((both[:1] >> U(64 - id_bits) << U(1)).view(np.int64)[0]), int((both[1:] & ~U(1)).view(np.int64)[0])


class Names:
    """The name of a class in the graph: d1, and d2 for the few classes whose d1 is that of another class too."""

    def __init__(self, classes: DataFrame):
        # of n classes about n * n / 2^64 are such: a handful at 10^10
        self.shared = [r["d1"] for r in classes.groupBy("d1").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("d1").collect()]

    def column(self):
        return F.when(F.col("d1").isin(self.shared), F.col("d2")).otherwise(F.col("d1")) if self.shared else F.col("d1")

    def function(self, id_bits: int):
        """From a set (hashes) to its name, for use in tasks."""
        shared = frozenset(self.shared)

        def name(found: np.ndarray) -> int:
            d1, d2 = _digest(found, id_bits)
            return d2 if d1 in shared else d1

        return name


def _packed(sigs: np.ndarray, heads: np.ndarray, counts: np.ndarray, buckets: int):
    """Per hash bucket, which the upper half of a signature gives: (bucket, heads, signatures of each head, lower half of the signatures), as bytes."""
    row_head = np.repeat(np.arange(len(heads)), counts)
    bucket = (((sigs >> U(32)) * U(buckets)) >> U(32)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    bucket, sigs, row_head = bucket[order], sigs[order], row_head[order]
    low = sigs.astype(np.uint32)
    present, at = np.unique(bucket, return_index=True)
    for which, i, j in zip(present.tolist(), at, [*at[1:], len(bucket)]):
        run = np.flatnonzero(np.diff(row_head[i:j], prepend=-1))
        yield which, heads[row_head[i:j][run]].tobytes(), np.diff(run, append=j - i).astype(np.int32).tobytes(), low[i:j].tobytes()


class _Shared:
    """Streams (signature, class) of one hash bucket; ``add`` returns the rows whose signature has two classes so far, and those that waited for the second."""

    def __init__(self):
        self.sig, self.head, self.out = np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, sig: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(sig, kind="stable")
        sig, head = sig[order], head[order]
        at = np.flatnonzero(np.diff(sig, prepend=~sig[:1]))
        key, ent = sig[at], head & np.int64(-2)
        low, high = np.minimum.reduceat(ent, at), np.maximum.reduceat(ent, at)
        place = np.searchsorted(self.sig, key)
        place[place == len(self.sig)] = 0
        known = self.sig[place] == key if len(self.sig) else np.zeros(len(key), bool)
        shared = low != high
        old = place[known]
        first = self.head[old] & np.int64(-2)
        shared[known] |= self.out[old] | (low[known] != first) | (high[known] != first)
        woken = old[shared[known] & ~self.out[old]]
        self.out[woken] = True
        rows = np.repeat(shared, np.diff(at, append=len(sig)))
        result = np.concatenate([self.sig[woken], sig[rows]]), np.concatenate([self.head[woken], head[rows]])
        fresh = ~known
        sig, head, out = np.concatenate([self.sig, key[fresh]]), np.concatenate([self.head, head[at][fresh]]), np.concatenate([self.out, shared[fresh]])
        order = np.argsort(sig, kind="stable")
        self.sig, self.head, self.out = sig[order], head[order], out[order]
        return result


def _buckets(documents: DataFrame, k: int, percent: int, name, common, turn: int, spread: int = 2) -> DataFrame:
    """(sig, ent, probe) of the signatures that classes share under the bands of a ``turn``, some more than once: ent is the ``name`` of a class's set. A task emits a set once, however many copies it reads.

    ``common``: a broadcast of sorted shingles that make no part strong. ``spread``: hash buckets for each shuffle partition; more of them hold less memory at a time.
    """
    parts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = parts * spread

    def signed(batches):
        scheme, seen = Scheme(percent), set()
        sigs, heads, counts, total = [], [], [], 0

        def flush():
            nonlocal total
            rows = list(zip(*_packed(np.concatenate(sigs), np.array(heads, np.int64), np.array(counts), buckets)))
            sigs.clear(), heads.clear(), counts.clear()
            total = 0
            return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), *(pa.array(r, pa.binary()) for r in rows[1:])], names=["bucket", "heads", "counts", "sigs"])

        for rows in batches:
            texts = texts_of(rows.column("text"))
            for i, j in size_chunks([len(t) for t in texts]):
                for found in shingles(texts[i:j], k):
                    if not len(found):
                        continue
                    ent = name(found)
                    if ent in seen:
                        continue
                    if len(seen) >= 250_000:  # a class that is met again is emitted again, which does no harm
                        seen.clear()
                    seen.add(ent)
                    band = scheme.band(len(found))
                    for b, probe in ((band, 0), (band - 1, 1)):
                        own = signatures(found, b, scheme, not probe, common.value) if b >= 0 and b % TURNS == turn else ()
                        if len(own):
                            sigs.append(own)
                            heads.append(ent | probe)
                            counts.append(len(own))
                            total += len(own)
                    if total > FLUSH:
                        yield flush()
        if total:
            yield flush()

    def shared(batches):
        state, bucket = None, None
        waiting, size = [], 0

        def rows():
            nonlocal size
            sig, head = state.add(np.concatenate([s for s, _ in waiting]), np.concatenate([h for _, h in waiting]))
            waiting.clear()
            size = 0
            return pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(head & np.int64(-2)), pa.array((head & 1).astype(bool))], names=["sig", "ent", "probe"])

        for batch in batches:
            for r in range(batch.num_rows):
                which = batch.column("bucket")[r].as_py()
                if which != bucket:
                    if waiting:
                        yield rows()
                    state, bucket = _Shared(), which
                heads, counts, low = (np.frombuffer(batch.column(c)[r].as_buffer(), t) for c, t in (("heads", np.int64), ("counts", np.int32), ("sigs", np.uint32)))
                # the turn and the bucket make up for bits that are left out; two signatures taken for one are a candidate more
                waiting.append((low.astype(U) | U(which * TURNS + turn) << U(32), np.repeat(heads, counts)))
                size += len(low)
                if size > FLUSH:
                    yield rows()
        if waiting:
            yield rows()

    packed = documents.filter("doc_id is not null").select("text").mapInArrow(signed, "bucket int, heads binary, counts binary, sigs binary")
    return packed.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(shared, "sig long, ent long, probe boolean")


def _pairs(pairs: DataFrame, sets: DataFrame, values: list[str], similar) -> DataFrame:
    """The pairs (a, b) for which ``similar`` holds; it gets two tuples of ``values``, of which the last are arrays of hashes. The joins may be uneven, and Spark can split them."""
    side = lambda end: sets.select(F.col("ent").alias(end), *(F.col(v).alias(f"{v}_{end}") for v in values))
    both = pairs.join(side("b"), "b").join(side("a"), "a")

    def batch(rows: pa.RecordBatch) -> dict:
        of = lambda end: zip(*([np.frombuffer(x.as_buffer(), U) for x in c] if pa.types.is_binary(c.type) else c.to_pylist() for c in (rows.column(f"{v}_{end}") for v in values)))
        mask = pa.array([similar(x, y) for x, y in zip(of("a"), of("b"))], pa.bool_())
        return {"a": rows.column("a").filter(mask), "b": rows.column("b").filter(mask)}

    return map_batches(both.select("a", "b", *(f"{v}_{end}" for end in "ab" for v in values)), batch, "a long, b long")


def _common(x: np.ndarray, y: np.ndarray) -> int:
    """How many values two sorted arrays of distinct values share."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x):
        return 0
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum())


def _similar_sets(percent: int):
    def similar(x, y) -> bool:
        (x,), (y,) = x, y
        if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
            return False
        inter = _common(x, y)
        return 100 * inter >= percent * (len(x) + len(y) - inter)

    return similar


def _similar_differences(percent: int):
    def similar(x, y) -> bool:
        (w, d), (v, e) = x, y
        need = w + v
        return need <= 0 or (need <= 2 * (100 + percent) * min(len(d), len(e)) and need <= 2 * (100 + percent) * _common(np.sort(d), np.sort(e)))

    return similar


def _sketch(found: np.ndarray) -> bytes:
    """Parities of how many of a set's hashes fall to each of 2^s places, as many as the set has or up to twice that: two sets differ by no fewer shingles than places."""
    places = 1 << max(6, (len(found) - 1).bit_length())
    return np.packbits(np.bincount((mix(found) & U(places - 1)).astype(np.int64), minlength=places) & 1, bitorder="little").tobytes()


def _maybe_similar(percent: int):
    """Whether sketches leave it open that their sets are similar; a wider sketch is folded to the width of the other."""

    def similar(x, y) -> bool:
        (n, x), (m, y) = x, y
        if 100 * min(n, m) < percent * max(n, m):
            return False
        x, y = (x, y) if len(x) >= len(y) else (y, x)
        while len(x) > len(y):
            x = x[: len(x) // 2] ^ x[len(x) // 2 :]
        return (100 + percent) * int(np.bitwise_count(x ^ y).sum()) <= (100 - percent) * (n + m)

    return similar


def _left_open(ent: np.ndarray, probe: np.ndarray, root: np.ndarray, size: np.ndarray, sketches: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of a bucket's classes, of different components and not both probes, that _maybe_similar leaves open."""
    width = np.array([len(s) for s in sketches])
    order = np.argsort(width, kind="stable")
    ent, probe, root, size, width = ent[order], probe[order], root[order], size[order], width[order]
    a, b = [], []
    for one in np.unique(width).tolist():
        first, end = np.searchsorted(width, [one, one + 1])
        bits = []
        for i in order[first:]:
            x = sketches[i]
            while len(x) > one:
                x = x[: len(x) // 2] ^ x[len(x) // 2 :]
            bits.append(x)
        bits = np.stack(bits)
        for r in range(first, end):
            others = slice(r + 1, None)
            fits = (root[others] != root[r]) & ~(probe[others] & probe[r]) & (100 * np.minimum(size[others], size[r]) >= percent * np.maximum(size[others], size[r]))
            at = r + 1 + np.flatnonzero(fits)
            apart = np.bitwise_count(bits[at - first] ^ bits[r - first]).sum(axis=1, dtype=np.int64)
            at = at[(100 + percent) * apart <= (100 - percent) * (size[at] + size[r])]
            a.append(np.maximum(ent[at], ent[r]))
            b.append(np.minimum(ent[at], ent[r]))
    return np.concatenate(a), np.concatenate(b)


def _pairs_of_middle(rows: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """(a, b), distinct, of the classes of different components that share one of the buckets ``rows`` (of at most MIDDLE), aren't both probes, and may be similar by their ``sketches``.

    A task has the sketches of one bucket at a time.
    """

    def met(batches):
        sig, held = None, []

        def pairs():
            ent, probe, root, size = (np.concatenate([h.column(c).to_numpy(zero_copy_only=False) for h in held]) for c in ("ent", "probe", "root", "size"))
            a, b = _left_open(ent, probe, root, size, [np.frombuffer(x.as_buffer(), U) for h in held for x in h.column("bits")], percent)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            sigs = batch.column("sig").to_numpy()
            begins = np.flatnonzero(np.diff(sigs, prepend=~sigs[:1]))
            for i, j in zip(begins.tolist(), [*begins[1:].tolist(), len(sigs)]):
                if held and sigs[i] != sig:
                    yield pairs()
                sig = sigs[i]
                held.append(batch.slice(i, j - i))
        if held:
            yield pairs()

    together = rows.select("sig", "ent", "probe", "root").join(sketches.withColumnRenamed("n", "size"), "ent").repartition("sig").sortWithinPartitions("sig")
    return together.select("sig", "ent", "probe", "root", "size", "bits").mapInArrow(met, "a long, b long").distinct()


def _by_text(documents: DataFrame, reps: DataFrame, k: int, name, values: dict, label: str) -> DataFrame:
    """(ent, ``values``), written: functions of the sorted shingles (name and type to function) of each class in ``reps`` (ent, rep), by the text of its smallest id."""

    def batch(rows: pa.RecordBatch):
        texts, ents = texts_of(rows.column("text")), rows.column("ent").to_pylist()
        for i, j in size_chunks([len(t) for t in texts]):
            found = [(ent, h) for ent, h in zip(ents[i:j], shingles(texts[i:j], k)) if len(h) and name(h) == ent]  # an id may have several texts
            yield {"ent": pa.array([x for x, _ in found], pa.int64())} | {v: pa.array([f(h) for _, h in found], pa.binary() if v.endswith("binary") else pa.int64()) for v, f in values.items()}

    n = reps.count()
    docs = documents.select(F.col("doc_id").cast("long").alias("rep"), "text")
    if n <= BROADCAST_IDS:
        docs = docs.join(F.broadcast(reps), "rep")
    else:  # only texts that may be asked for are moved
        docs = docs.filter(sieve(reps.select("rep"), n)("rep")).join(reps, "rep")
    out = written(map_batches(docs.select("ent", "text"), batch, ", ".join(["ent long", *values])), label)
    return out if out.count() == n else written(out.dropDuplicates(["ent"]), label)  # rows were repeated


def _hashes(documents: DataFrame, reps: DataFrame, k: int, name) -> DataFrame:
    """(ent, hashes), written: the sorted shingles of each class in ``reps``."""
    return _by_text(documents, reps, k, name, {"hashes binary": lambda found: found.tobytes()}, "hashes")


def _ents(pairs: DataFrame) -> DataFrame:
    """The classes of pairs (a, b)."""
    return pairs.select(F.col("a").alias("ent")).unionByName(pairs.select(F.col("b").alias("ent"))).distinct()


def _rooted(rows: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Adds the root of each ent, itself where it has no link."""
    if roots is None:
        return rows.withColumn("root", F.col("ent"))
    return rows.join(roots.select(F.col("node").alias("ent"), "root"), "ent", "left").withColumn("root", F.coalesce("root", "ent"))


def _linked(roots: DataFrame | None, links: DataFrame) -> DataFrame | None:
    """The components ``roots`` (node, root) after new ``links`` (a, b); known components stand for the links that made them."""
    if roots is not None:
        links = links.unionByName(roots.filter("node <> root").select(F.col("root").alias("a"), F.col("node").alias("b")))
    out = written(components(links), "roots")
    dropped(roots)
    return out


def _pairs_of_small(rows: DataFrame) -> DataFrame:
    """(a, b), distinct, of all classes of different components that share one of the small buckets ``rows``, and aren't both probes."""
    other = rows.select("sig", F.col("ent").alias("b"), F.col("root").alias("rb"), F.col("probe").alias("pb"))
    met = rows.join(other, "sig").filter((F.col("ent") > F.col("b")) & (F.col("root") != F.col("rb")) & ~(F.col("probe") & F.col("pb")))
    return met.select(F.col("ent").alias("a"), "b").distinct()


def _groups(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """(ent, g), written: classes that share, directly or in a chain, one of the buckets ``rows`` that still has several components and a class that isn't a probe."""
    rows = _rooted(rows, roots)
    state = rows.groupBy("sig").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min("ent").alias("head"), F.max((~F.col("probe")).cast("int")).alias("asks"))
    star = rows.select("sig", "ent").join(state.filter("lo <> hi and asks = 1"), "sig").filter("ent <> head")
    return written(components(star.select(F.col("head").alias("a"), F.col("ent").alias("b"))).select(F.col("node").alias("ent"), F.col("root").alias("g")), "groups")


class _Centre:
    """The centre of a group of ``size`` sets, and how many of them differ from it at a shingle: known of the shingles ``often`` and, by slot, of rarer ones."""

    def __init__(self, often, often_have, slots, slots_have, size: int):
        order = np.argsort(often.view(U))
        self.often, count = often.view(U)[order], often_have[order]
        central = 2 * count > size
        self.below, self.heart = np.where(central, size - count, count), self.often[central]
        order = np.argsort(slots)
        self.slots, self.slots_have = slots[order], slots_have[order]

    def difference(self, found: np.ndarray) -> np.ndarray:
        """The symmetric difference of a set and the centre; where few sets differ comes first, ties by hash."""
        diff = np.setxor1d(found, self.heart, assume_unique=True)
        count = np.zeros(len(diff))
        if len(self.slots):
            slot = diff.view(np.int64) % RARE_SLOTS
            at = np.minimum(np.searchsorted(self.slots, slot), len(self.slots) - 1)
            count = np.where(self.slots[at] == slot, self.slots_have[at], 0)
        if len(self.often):
            at = np.minimum(np.searchsorted(self.often, diff), len(self.often) - 1)
            count = np.where(self.often[at] == diff, self.below[at], count)
        return diff[np.argsort(count, kind="stable")]


def _differences(members: DataFrame, sizes: DataFrame, percent: int, part: int = 250) -> DataFrame:
    """(ent, g, w, n, diff), written, of ``members`` (ent, g, hashes): how each set differs from the centre of its group, whose number of sets is in ``sizes`` (g, size).

    The centre holds the shingles of more than half of the group's sets. ``diff`` is ordered by how many sets of the
    group differ there, rare first; shingles of at most a quarter of the sets are counted in RARE_SLOTS slots, which
    bounds what is known of a group. ``w`` is (100 + percent) * n - (100 - percent) * set size. Groups are dealt
    out in parts of about ``part`` sets.
    """

    def counted(batches):
        """How many sets have each shingle, summed over the sets of one part of a group, which come one after the other."""
        group, held, size = None, [], 0

        def sums():
            found, have = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(found), group[0])), pa.array(found.view(np.int64)), pa.array(have)], names=["g", "shingle", "have"])

        for batch in batches:
            for r, at in enumerate(zip(batch.column("g").to_pylist(), batch.column("salt").to_pylist())):
                if held and (at != group or size > 1 << 20):
                    yield sums()
                    size = 0
                group = at
                held.append(np.frombuffer(batch.column("hashes")[r].as_buffer(), U))
                size += len(held[-1])
        if held:
            yield sums()

    parts = F.ceil(F.col("size") / part).cast("int")
    salted = members.join(sizes, "g").withColumn("salt", F.pmod(F.xxhash64("ent"), parts).cast("int"))
    together = salted.select("g", "salt", "hashes").repartition("g", "salt").sortWithinPartitions("g", "salt")
    have = together.mapInArrow(counted, "g long, shingle long, have long").groupBy("g", "shingle").agg(F.sum("have").alias("have")).filter("have > 1")
    often = 4 * F.col("have") > F.col("size")
    slots = have.join(sizes, "g").withColumn("often", often).withColumn("key", F.when(F.col("often"), F.col("shingle")).otherwise(F.pmod("shingle", F.lit(RARE_SLOTS))))
    slots = slots.groupBy("g", "often", "key").agg(F.max("have").alias("have"), F.max("size").alias("size"))
    listed = lambda chosen: F.collect_list(F.when(chosen, F.struct("key", "have")))
    centre = slots.groupBy("g").agg(F.max("size").alias("size"), listed(F.col("often")).alias("often"), listed(~F.col("often")).alias("rare"))
    heads = centre.withColumn("salt", F.explode(F.sequence(F.lit(0), parts - 1)))
    none, counts = F.lit(None), ("often.key", "often.have", "rare.key", "rare.have")
    names = [c.replace(".", "_") for c in counts]
    rows = heads.select("g", "salt", F.lit(0).alias("kind"), none.cast("long").alias("ent"), none.cast("binary").alias("hashes"), "size", *(F.col(c).alias(n) for c, n in zip(counts, names)))
    rows = rows.unionByName(salted.select("g", "salt", F.lit(1).alias("kind"), "ent", "hashes", "size", *(none.cast("array<bigint>").alias(n) for n in names)))
    rows = rows.repartition("g", "salt").sortWithinPartitions("g", "salt", "kind")

    def differ(batches):
        group, known = None, None
        for batch in batches:
            out = []
            for r in range(batch.num_rows):
                g, kind = batch.column("g")[r].as_py(), batch.column("kind")[r].as_py()
                if g != group:
                    group, known = g, _Centre(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0), 0)
                if kind == 0:
                    known = _Centre(*(batch.column(n)[r].values.to_numpy() for n in names), batch.column("size")[r].as_py())
                    continue
                found = np.frombuffer(batch.column("hashes")[r].as_buffer(), U)
                diff = known.difference(found)
                out.append((batch.column("ent")[r].as_py(), g, (100 + percent) * len(diff) - (100 - percent) * len(found), len(diff), diff.tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["ent", "g", "w", "n", "diff"])

    return written(rows.mapInArrow(differ, "ent long, g long, w long, n long, diff binary"), "differences")


def _centred(diffs: DataFrame, roots: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """The second index: (sig, ent, probe, root, w, left), and links to leaders (a, b); both written.

    Sets whose differences to their group's centre are d and e differ by |d| + |e| - 2 |d and e|; so they are similar
    if w + w' <= 0, and otherwise only if d and e share at least (w + w') / (2 (100 + percent)) shingles. The first
    kind is settled by the member of least w, the leader. For the second, sets are cut into bands of w, and for each
    band of partners a set is indexed under the rarest shingles of its difference, as many as leave too few for
    such an overlap; ``left`` is how many are left from that shingle on. Members of the leader's component are only probes, for partners outside it: links within it
    change nothing.
    """
    named = _rooted(diffs.select("ent", "g", "w"), roots)
    least = named.groupBy("g").agg(F.min(F.struct("w", "ent", "root")).alias("m")).select("g", F.col("m.w").alias("least"), F.col("m.ent").alias("lead"), F.col("m.root").alias("main"))
    band = F.floor(F.log(1 + (F.col("w") - F.col("least")) / (100 + percent)) / math.log(_STEP)).cast("int")
    led = F.col("w") + F.col("least") <= 0
    sided = named.join(written(least, "leaders"), "g").withColumn("probe", led | (F.col("root") == F.col("main")))
    sided = written(sided.select("ent", "g", "w", "least", "lead", "probe", led.alias("led"), F.when(F.col("probe"), F.col("main")).otherwise(F.col("root")).alias("root"), band.alias("band")), "sided")
    bands = sided.groupBy("g").agg(F.collect_set("band").alias("every"), F.collect_set(F.when(~F.col("probe"), F.col("band"))).alias("other")).filter(F.size("other") > 0)
    asked = sided.join(bands, "g").select("ent", "w", "least", "probe", "root", "band", F.when(F.col("probe"), F.col("other")).otherwise(F.col("every")).alias("partners"))
    rows = diffs.select("ent", "g", "diff").join(asked, "ent")

    def batch(rows: pa.RecordBatch) -> dict:
        w, least, own, salt = (rows.column(c).to_numpy() for c in ("w", "least", "band", "g"))
        at, sigs, left = [], [], []
        for r, (d, partners) in enumerate(zip(rows.column("diff"), rows.column("partners"))):
            d = np.frombuffer(d.as_buffer(), U)
            for other in partners.as_py():
                floor = least[r] + (100 + percent) * (_STEP**other * (1 - 1e-9) - 1)  # no partner of that band has less
                need = max(1, math.ceil((w[r] + floor) / (2 * (100 + percent)) - 1e-6))
                if need <= len(d):
                    key = mix(np.array([salt[r]], np.int64).view(U) + U(256 * min(own[r], other) + max(own[r], other)))
                    sigs.append(mix(d[: len(d) - need + 1] ^ key))
                    left.append(np.arange(len(d), need - 1, -1))
                    at.append(r)
        sig = np.concatenate(sigs) if sigs else np.zeros(0, U)
        at = pa.array(np.repeat(np.array(at, np.int64), [len(x) for x in sigs]))
        return {"sig": pa.array(sig.view(np.int64))} | {c: rows.column(c).take(at) for c in ("ent", "probe", "root", "w")} | {"left": pa.array(np.concatenate(left) if left else np.zeros(0, np.int64))}

    index = written(map_batches(rows, batch, "sig long, ent long, probe boolean, root long, w long, left long"), "index")
    return index, sided.filter("led and ent <> lead").select(F.col("lead").alias("a"), F.col("ent").alias("b"))


def _open_buckets(rows: DataFrame, order) -> DataFrame:
    """(sig, n) of buckets that hold several components and a class that isn't a probe, with their sizes; of those with the same members only the one of the largest sum of ``order``."""
    members = [F.bit_xor(F.xxhash64("ent", "probe", F.lit(x))).alias(f"members{x}") for x in (0, 1)]
    state = rows.groupBy("sig").agg(
        F.min("root").alias("lo"), F.max("root").alias("hi"), F.max((~F.col("probe")).cast("int")).alias("asks"), F.count(F.lit(1)).alias("n"), F.sum(order).alias("order"), *members
    )
    return state.filter("lo <> hi and asks = 1").groupBy("n", "members0", "members1").agg(F.max(F.struct("order", "sig")).alias("m")).select("m.sig", "n")


def similar_classes(documents: DataFrame, classes: DataFrame, k: int, percent: int, names: Names, id_bits: int = 63) -> DataFrame:
    """(node, root) over ``classes`` (ent, rep) that are linked with another class, directly or not."""
    name = names.function(id_bits)
    common = documents.sparkSession.sparkContext.broadcast(common_shingles(documents, k))
    turns = []
    for turn in range(TURNS):
        turns.append(written(_buckets(documents, k, percent, name, common, turn).distinct(), "shared"))
        swept(documents.sparkSession)
    raw = reduce(DataFrame.unionByName, turns)
    pivots = raw.groupBy("sig").agg(F.min(F.when(~F.col("probe"), F.col("ent"))).alias("pivot"), F.min("ent").alias("least"), F.max("ent").alias("most"))
    buckets = written(raw.join(pivots.filter("pivot is not null and least <> most").select("sig", "pivot"), "sig"), "buckets")
    dropped(*turns)
    pairs = buckets.filter("ent <> pivot").select(F.greatest("pivot", "ent").alias("a"), F.least("pivot", "ent").alias("b"))
    pairs = written(pairs.distinct(), "pairs")
    swept(documents.sparkSession)
    reps = written(classes.join(_ents(pairs), "ent", "left_semi").select("ent", "rep"), "reps")
    # most pairs that aren't similar fail by sketches, an eighth of a byte to a quarter a shingle in place of eight
    sketches = _by_text(documents, reps, k, name, {"n long": len, "bits binary": _sketch}, "sketches")
    close = written(_pairs(pairs, sketches, ["n", "bits"], _maybe_similar(percent)), "close")
    known = written(reps.join(_ents(close), "ent", "left_semi"), "known")
    hashes = _hashes(documents, known, k, name)
    roots = _linked(None, _pairs(close, hashes, ["hashes"], _similar_sets(percent)))
    swept(documents.sparkSession)
    rows = _rooted(buckets.filter("ent <> pivot"), roots)  # pivots have met all others of their buckets
    live = written(rows.join(_open_buckets(rows, F.lit(0)), "sig"), "open")
    dropped(buckets, close)

    def with_hashes_of(ents: DataFrame) -> DataFrame:
        """``hashes`` and those of the classes ``ents`` that were not known."""
        nonlocal known
        more = written(reps.join(ents, "ent", "left_semi").join(known.select("ent"), "ent", "left_anti"), "more")
        if more.isEmpty():
            return hashes
        known = known.unionByName(more)
        return hashes.unionByName(_hashes(documents, more, k, name))

    few = _pairs_of_small(live.filter(F.col("n") <= SMALL)).join(pairs, ["a", "b"], "left_anti")
    few = _pairs(few, sketches, ["n", "bits"], _maybe_similar(percent))
    some = _pairs_of_middle(live.filter((F.col("n") > SMALL) & (F.col("n") <= MIDDLE)), sketches, percent).join(pairs, ["a", "b"], "left_anti")
    few = written(few.unionByName(some).distinct(), "few")
    hashes = with_hashes_of(_ents(few))
    roots = _linked(roots, _pairs(few, hashes, ["hashes"], _similar_sets(percent)))
    dropped(pairs, few, sketches)
    swept(documents.sparkSession)
    groups = _groups(live.filter(F.col("n") > MIDDLE).select("sig", "ent", "probe"), roots)
    hashes = with_hashes_of(groups.select("ent"))
    sizes = written(groups.groupBy("g").agg(F.count(F.lit(1)).alias("size")), "sizes")
    diffs = _differences(groups.join(hashes, "ent"), sizes, percent)
    dropped(live, hashes, groups, sizes, reps)
    swept(documents.sparkSession)
    rows, links = _centred(diffs, roots, percent)
    tried, pivots = None, PIVOTS
    while True:
        live = written(rows.join(_open_buckets(rows, F.col("left")).select("sig"), "sig"), "open")
        dropped(rows)
        if live.isEmpty():
            return _linked(roots, links) if tried is None else roots
        place = F.row_number().over(Window.partitionBy("sig").orderBy("ent"))
        heads = written(live.filter("not probe").withColumn("place", place).filter(F.col("place") <= pivots).select("sig", F.col("ent").alias("a"), F.col("root").alias("ra"), F.col("w").alias("wa"), F.col("left").alias("la")), "heads")
        enough = F.col("w") + F.col("wa") <= 2 * (100 + percent) * F.least("left", "la")  # of two similar sets, from their first common shingle on
        pairs = live.join(heads, "sig").filter((F.col("root") != F.col("ra")) & enough)
        pairs = pairs.select(F.greatest("a", "ent").alias("a"), F.least("a", "ent").alias("b")).distinct()
        pairs = written(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        found = _pairs(pairs, diffs, ["w", "diff"], _similar_differences(percent))
        roots = _linked(roots, found if tried is not None else found.unionByName(links))
        tried = pairs if tried is None else tried.unionByName(pairs)
        rest = live.join(heads.select("sig", F.col("a").alias("ent")), ["sig", "ent"], "left_anti")  # pivots have met all others of their buckets
        rows = _rooted(rest.drop("root"), roots)
        pivots *= 4


def memberships(documents: DataFrame, k: int = 5, percent: int = 80, id_bits: int = 63, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_shingles, component, first and the ``keep`` columns of every row.

    ``component`` names the component of links of Jaccard percent / 100 or more that a row's set is in, whatever ids the rows have, and
    ``first`` is the smallest doc_id in it; both are null for an empty set, and for a set that only rows without a doc_id have. ``id_bits``: see sets_of; fewer bits only cost time.
    """
    bound_batches(documents.sparkSession)
    sets = written(sets_of(documents, k, id_bits, keep), "sets")
    classes = written(sets.filter("n_shingles > 0 and doc_id is not null").groupBy("d1", "d2").agg(F.min("doc_id").alias("rep")), "classes")
    names = Names(classes)
    classes = classes.withColumn("ent", names.column())
    roots = similar_classes(documents, classes, k, percent, names, id_bits)
    firsts = roots.join(classes, F.col("node") == F.col("ent")).groupBy("root").agg(F.min("rep").alias("first"))
    firsts = roots.join(firsts, "root").select(F.col("node").alias("ent"), "root", "first")
    named = classes.join(firsts, "ent", "left").select(F.col("d1").alias("c1"), F.col("d2").alias("c2"), F.coalesce("root", "ent").alias("component"), F.least("rep", "first").alias("first"))
    named = written(named, "named")
    joined = sets.join(named, (sets["d1"] == named["c1"]) & (sets["d2"] == named["c2"]) & (sets["n_shingles"] > 0), "left")
    return joined.select("doc_id", "n_shingles", "component", "first", *keep)


def join_components(documents: DataFrame, k: int = 5, percent: int = 80, id_bits: int = 63) -> DataFrame:
    """doc_id, n_shingles, component_id of every row: the smallest doc_id reachable by links of Jaccard percent / 100 or more."""
    joined = memberships(documents, k, percent, id_bits)
    return joined.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.when(F.col("doc_id").isNotNull(), F.col("first"))).otherwise(F.col("doc_id")).alias("component_id"))


def representatives(documents: DataFrame, k: int = 5, percent: int = 80, key: str = "doc_id") -> DataFrame:
    """The rows of ``documents`` without near copies: of each component one row stays, that with the smallest ``key``.

    Rows are told apart by a 128-bit digest of all their columns, not by their key, so a row never goes for another one of its key. Ties of the
    key go by the digest; of rows that are equal in all columns one stays; rows without a key come last, and are compared like
    others. Texts without words are linked with nothing, and all stay.
    """
    digest = {"_a": F.xxhash64(*documents.columns), "_b": F.xxhash64(F.lit("b"), *documents.columns)}
    tagged = documents.withColumns(digest)
    named = tagged.select(F.coalesce(F.col(key), -1 - F.abs(F.shiftright("_a", 1))).alias("doc_id"), "text", F.col(key).alias("_key"), "_a", "_b")
    found = memberships(named, k, percent, keep=("_key", "_a", "_b")).filter("n_shingles > 0")
    classes = written(found.groupBy("component", "_key", "_a", "_b").agg(F.count(F.lit(1)).alias("n")), "classes")
    place = F.struct(F.col("_key").isNull(), "_key", "_a", "_b")
    first = classes.groupBy("component").agg(F.min(place).alias("m"), F.sum("n").alias("all")).filter("all > 1").select("component", F.col("m._a").alias("ka"), F.col("m._b").alias("kb"))
    judged = written(classes.join(first, "component").select("_a", "_b", "n", ((F.col("_a") == F.col("ka")) & (F.col("_b") == F.col("kb"))).alias("stays")), "judged")
    _, kept = _parted(tagged, judged.filter("not stays").select("_a", "_b"))
    repeated = judged.filter("stays and n > 1").select("_a", "_b")
    if not repeated.isEmpty():
        again, kept = _parted(kept, repeated)
        kept = kept.unionByName(again.dropDuplicates(["_a", "_b"]))
    return kept.select(*documents.columns)


def _parted(rows: DataFrame, digests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows whose (_a, _b) is in ``digests``, and the others; of the others hardly any is shuffled."""
    n = digests.count()
    if n <= BROADCAST_IDS:
        few = F.broadcast(digests)
        return rows.join(few, ["_a", "_b"], "left_semi"), rows.join(few, ["_a", "_b"], "left_anti")
    passes = sieve(digests.select("_a"), n)
    likely, others = rows.filter(passes("_a")), rows.filter(~passes("_a"))
    return likely.join(digests, ["_a", "_b"], "left_semi"), others.unionByName(likely.join(digests, ["_a", "_b"], "left_anti"))
