"""Byte-level BPE: encoding of whole texts by published merge ranks, and decoding.

A text is split into pre-tokens by the pattern of the byte-level vocabularies, and each is encoded by itself.
The first tier resolves a pre-token that is a vocabulary entry: a minimal perfect hash (buckets of keys that a
displacement deals to free slots) gives the one entry it can be, and its bytes are compared. The second tier merges what
is left: bytes are linked in a list, a heap holds the ranks of adjacent pairs, and the lowest rank, leftmost first, is
merged until no pair is in the vocabulary. Pre-tokens of a batch are split, hashed and looked up as arrays; a merge is done
once for each distinct pre-token, with a bounded memory of earlier ones.

Defined cases: null and empty texts have no ids. A text of any length is worked on in bounded pieces that begin where a
pre-token begins. Special tokens are ordinary text. Rows with the same text have the same ids. Columns of any name are carried
along by ``keep``. An id that the vocabulary lacks is an error in decoding.
"""

from __future__ import annotations

import base64
import heapq
import re
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bytehash import mix, span_hashes
from .shared import map_batches, texts_of

#: Characters of one numpy pass.
PIECE_CHARS = 1 << 19
#: Distinct merged pre-tokens that a worker remembers.
REMEMBERED = 1 << 18
_ODD = np.uint64(0x9E3779B97F4A7C15)

# White space of Unicode, and the letters and numbers that Unicode 16 added to what older Python versions know.
_WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_NEW_LETTERS = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B),
    (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C),
    (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
_NEW_NUMBERS = ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA))

OTHER, LETTER, NUMBER, SPACE = range(4)
_WHITE_ONE = re.compile(f"[{_WHITE}]")
_CUT = re.compile(f"(?<=[^{_WHITE}])[{_WHITE}]")
_classes: list[np.ndarray] = []


def classes() -> np.ndarray:
    """The class of every code point: letter, number, white space or other."""
    if not _classes:
        kind = np.full(0x110000, OTHER, np.uint8)
        for c in range(0x110000):
            name = unicodedata.category(chr(c))[0]
            if name == "L":
                kind[c] = LETTER
            elif name == "N":
                kind[c] = NUMBER
        for ranges, k in ((_NEW_LETTERS, LETTER), (_NEW_NUMBERS, NUMBER)):
            for a, b in ranges:
                kind[a : b + 1] = k
        kind[[c for c in range(0x3001) if _WHITE_ONE.match(chr(c))]] = SPACE
        _classes.append(kind)
    return _classes[0]


def pre_tokens(points: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where the pre-tokens of texts begin. ``points``: code points of the texts one after the other; ``bounds``: where each begins, and the end.

    A pre-token is a contraction ('s 't 're 've 'm 'll 'd), a run of letters, of numbers or of other characters with a space
    before it if there is one, or a run of white space, of which the last character is left over if more text follows.
    """
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes()[points]
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    change = edge[:n].copy()
    change[1:] |= kind[1:] != kind[:-1]
    first = np.flatnonzero(change)
    end = np.append(first[1:], n)
    of, at_end = kind[first], edge[end]
    white = of == SPACE
    before_text = white & ~at_end
    attached = before_text & (points[end - 1] == 0x20)
    own = np.ones(len(first), bool)
    own[1:] = ~attached[:-1]
    begins = np.zeros(n + 1, bool)
    begins[first[own]] = True
    begins[(end - 1)[before_text & (end - first >= 2)]] = True
    quote = np.flatnonzero((of == OTHER) & (end - first == 1) & (points[first] == 0x27) & own & ~at_end)
    quote = quote[of[quote + 1] == LETTER]
    if len(quote):
        word, room = first[quote + 1], (end - first)[quote + 1]
        a, b = points[word], points[np.minimum(word + 1, n - 1)]
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = (room >= 2) & (((b == ord("e")) & ((a == ord("r")) | (a == ord("v")))) | ((a == ord("l")) & (b == ord("l"))))
        taken = np.where(one, 1, np.where(two, 2, 0))
        begins[word[taken > 0]] = False
        rest = (taken > 0) & (taken < room)
        begins[(word + taken)[rest]] = True
    return np.flatnonzero(begins[:n])


def pieces(text: str, most: int = PIECE_CHARS) -> Iterator[str]:
    """A text in pieces of about ``most`` characters; each but the first begins with white space behind other text, where a pre-token begins whatever stands before."""
    at = 0
    while len(text) - at > most:
        cut = None
        for m in _CUT.finditer(text, at + most // 2, at + most):
            cut = m.start()
        if cut is None or cut <= at:
            later = _CUT.search(text, at + most)
            cut = later.start() if later else len(text)
        yield text[at:cut]
        at = cut
    yield text[at:]


def _within(lengths: np.ndarray) -> np.ndarray:
    """0, 1, ... within each of some runs."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)


def _equal(a: np.ndarray, at_a: np.ndarray, b: np.ndarray, at_b: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether spans of two byte arrays are equal; no span is empty."""
    if not len(lengths):
        return np.zeros(0, bool)
    inside = _within(lengths)
    differs = a[np.repeat(at_a, lengths) + inside] != b[np.repeat(at_b, lengths) + inside]
    return np.add.reduceat(differs, np.cumsum(lengths) - lengths) == 0


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys: n keys have the slots 0 to n - 1.

    Keys are dealt to buckets. Largest first, a bucket of several keys tries displacements until all its keys land on free slots;
    a bucket of one key names a slot that is left over.
    """

    def __init__(self, keys: np.ndarray):
        self.n, self.n_buckets = len(keys), len(keys)
        if len(np.unique(keys)) < self.n:
            raise ValueError("two keys have one hash")
        bucket = (keys % np.uint64(self.n_buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        begin = np.searchsorted(bucket[order], np.arange(self.n_buckets + 1))
        size = np.diff(begin)
        self.shift, free = np.zeros(self.n_buckets, np.int64), np.ones(self.n, bool)
        by_size = np.argsort(-size, kind="stable")
        for b in by_size[size[by_size] > 1].tolist():
            mine = keys[order[begin[b] : begin[b + 1]]]
            for d in range(1 << 40):
                slots = self._slot(mine, np.array([d], np.uint64))
                if free[slots].all() and len(set(slots.tolist())) == len(slots):
                    break
            self.shift[b] = d
            free[slots] = False
        singles = by_size[size[by_size] == 1]
        self.shift[singles] = -1 - np.flatnonzero(free)[: len(singles)]

    def _slot(self, keys: np.ndarray, d: np.ndarray) -> np.ndarray:
        return (mix(keys + d * _ODD) % np.uint64(self.n)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The slot of every key; a key that isn't among those of the build gets any slot."""
        d = self.shift[(keys % np.uint64(self.n_buckets)).astype(np.int64)]
        return np.where(d < 0, -1 - d, self._slot(keys, np.maximum(d, 0).astype(np.uint64)))


class Vocabulary:
    """Entries (bytes) with their ranks, which are their ids."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        entries = list(ranks)
        lengths = np.array([len(x) for x in entries], np.int64)
        self.blob, start = np.frombuffer(b"".join(entries), np.uint8), np.cumsum(lengths) - lengths
        keys = span_hashes(self.blob, start, start + lengths)
        self.hash = PerfectHash(keys)
        slot = self.hash(keys)
        self.start, self.length, self.id = (np.zeros(len(entries), np.int64) for _ in range(3))
        self.start[slot], self.length[slot], self.id[slot] = start, lengths, np.array(list(ranks.values()), np.int64)
        self.of_id = np.full(int(self.id.max()) + 1, -1, np.int64)
        self.of_id[self.id] = np.arange(len(entries))
        self.seen: dict[bytes, bytes] = {}

    def merged(self, piece: bytes) -> bytes:
        """The ids of a pre-token, packed: its bytes as a linked list, pairs merged by a heap of (rank, place) as one number each."""
        n, rank = len(piece), self.ranks.get
        after, before = list(range(1, n + 1)), list(range(-1, n))
        pair = [rank(piece[i : i + 2], -1) for i in range(n - 1)]
        heap = [r << 32 | i for i, r in enumerate(pair) if r >= 0]
        pair.append(-1)
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            i = pop(heap)
            r, i = i >> 32, i & 0xFFFFFFFF
            if pair[i] != r:  # one of the two has been merged since
                continue
            gone = after[i]
            k = after[i] = after[gone]
            pair[gone] = pair[i] = -1
            if k < n:
                before[k] = i
                r = rank(piece[i : after[k]], -1)
                if r >= 0:
                    pair[i] = r
                    push(heap, r << 32 | i)
            p = before[i]
            if p >= 0:
                r = pair[p] = rank(piece[p:k], -1)
                if r >= 0:
                    push(heap, r << 32 | p)
        out, i = array("I"), 0
        while i < n:
            k = after[i]
            out.append(self.ranks[piece[i:k]])
            i = k
        return out.tobytes()

    def remembered(self, piece: bytes) -> bytes:
        ids = self.seen.get(piece)
        if ids is None:
            ids = self.merged(piece)
            if len(piece) <= 64:
                if len(self.seen) >= REMEMBERED:
                    self.seen.clear()
                self.seen[piece] = ids
        return ids

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        parts: list[list[np.ndarray]] = [[] for _ in texts]
        waiting, chars = [], 0
        for i, text in enumerate(texts):
            for piece in pieces(text):
                if waiting and chars + len(piece) > PIECE_CHARS:
                    self._pass(waiting, parts)
                    waiting, chars = [], 0
                waiting.append((i, piece))
                chars += len(piece)
        self._pass(waiting, parts)
        none = np.zeros(0, np.uint32)
        return [np.concatenate(p) if len(p) > 1 else p[0] if p else none for p in parts]

    def _pass(self, waiting: list[tuple[int, str]], parts: list[list[np.ndarray]]) -> None:
        joined = "".join(p for _, p in waiting)
        if not joined:
            return
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        raw = joined.encode()
        buf = np.frombuffer(raw, np.uint8)
        bounds = np.cumsum([0, *(len(p) for _, p in waiting)])
        begin = pre_tokens(points, bounds)
        offset = np.zeros(len(points) + 1, np.int64)
        np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF), out=offset[1:])
        start, end = offset[begin], offset[np.append(begin[1:], len(points))]
        length = end - start
        key = span_hashes(buf, start, end)
        slot = self.hash(key)
        hit = self.length[slot] == length
        maybe = np.flatnonzero(hit)
        hit[maybe] = _equal(buf, start[maybe], self.blob, self.start[slot[maybe]], length[maybe])
        miss = np.flatnonzero(~hit)
        _, rep, which = np.unique(key[miss], return_index=True, return_inverse=True)
        other = np.flatnonzero(length[miss] != length[miss[rep[which]]])
        same = np.setdiff1d(np.arange(len(miss)), other, assume_unique=True) if len(other) else np.arange(len(miss))
        wrong = same[~_equal(buf, start[miss[same]], buf, start[miss[rep[which[same]]]], length[miss[same]])]
        odd = np.union1d(other, wrong)  # of other bytes with the same hash: each by itself
        which[odd] = len(rep) + np.arange(len(odd))
        rep = miss[np.append(rep, odd)]
        found = [self.remembered(raw[a:b]) for a, b in zip(start[rep].tolist(), end[rep].tolist())]
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat = np.frombuffer(b"".join(found), np.uint32)
        count = np.ones(len(begin), np.int64)
        count[miss] = sizes[which]
        place = np.zeros(len(begin) + 1, np.int64)
        np.cumsum(count, out=place[1:])
        out = np.empty(int(place[-1]), np.uint32)
        out[place[:-1][hit]] = self.id[slot[hit]]
        inside = _within(count[miss])
        out[np.repeat(place[miss], count[miss]) + inside] = flat[np.repeat((np.cumsum(sizes) - sizes)[which], count[miss]) + inside]
        cut = place[np.searchsorted(begin, bounds)]
        for (i, _), a, b in zip(waiting, cut[:-1].tolist(), cut[1:].tolist()):
            if b > a:
                parts[i].append(out[a:b])

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of a sequence of ids."""
        ids = ids.astype(np.int64)
        if len(ids) and int(ids.max()) >= len(self.of_id):
            raise ValueError(f"the vocabulary has no id {int(ids.max())}")
        entry = self.of_id[ids]
        if (entry < 0).any():
            raise ValueError(f"the vocabulary has no id {int(ids[entry < 0][0])}")
        length = self.length[entry]
        return self.blob[np.repeat(self.start[entry], length) + _within(length)]


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a published vocabulary: lines of an entry in base 64 and its rank. The file is read by the driver; its size is that of a vocabulary."""
    with open(path, "rb") as lines:
        return {base64.b64decode(entry): int(rank) for entry, rank in (line.split() for line in lines if line.strip())}


_loaded: dict[int, Vocabulary] = {}


def _vocabulary(shared) -> Vocabulary:
    """A worker builds the vocabulary of a broadcast once, and keeps one."""
    if shared.value[0] not in _loaded:
        _loaded.clear()
        _loaded[shared.value[0]] = Vocabulary(shared.value[1])
    return _loaded[shared.value[0]]


def _broadcast(df: DataFrame, ranks: dict[bytes, int]):
    import zlib

    return df.sparkSession.sparkContext.broadcast((zlib.crc32(repr(sorted(ranks.items())).encode()), ranks))


def _kept(df: DataFrame, keep: tuple[str, ...]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)


def _packed(rows: list[np.ndarray]) -> pa.Array:
    """Byte strings of arrays."""
    return pa.array([x.tobytes() for x in rows], pa.binary())


def encode(documents: DataFrame, ranks: dict[bytes, int], keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` columns and ``ids``: the ids of every whole text as little-endian unsigned 32-bit integers, one after the other."""
    shared = _broadcast(documents, ranks)

    def batch(rows: pa.RecordBatch) -> dict:
        ids = _vocabulary(shared).encode(texts_of(rows.column(text)))
        return {c: rows.column(c) for c in keep} | {"ids": _packed([x.astype("<u4", copy=False) for x in ids])}

    return map_batches(documents.select(*dict.fromkeys([*keep, text])), batch, f"{_kept(documents, keep)}, ids binary")


def decode(encoded: DataFrame, ranks: dict[bytes, int], keep: tuple[str, ...] = ("doc_id", "ids")) -> DataFrame:
    """``keep`` columns and ``decoded``: the bytes that ``ids`` stand for; null ids have none."""
    shared = _broadcast(encoded, ranks)

    def batch(rows: pa.RecordBatch) -> dict:
        words = [np.frombuffer(x.as_py() or b"", "<u4") for x in rows.column("ids")]
        return {c: rows.column(c) for c in keep} | {"decoded": _packed([_vocabulary(shared).decode(x) for x in words])}

    return map_batches(encoded.select(*dict.fromkeys([*keep, "ids"])), batch, f"{_kept(encoded, keep)}, decoded binary")
