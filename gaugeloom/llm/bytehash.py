"""Vectorised hashing of words in UTF-8 buffers, without a Python step per word.

A buffer holds several texts, each ended by a line feed, so words never cross texts. The hash of a
word is a polynomial over 64-bit values of its bytes, read off one running sum of the buffer and
then mixed; equal words have equal hashes in every batch, task and run.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240229))
#: A random odd 64-bit value for each byte.
BYTE_VALUES = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = []

#: space, tab, line feed, vertical tab, form feed, carriage return
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER_ASCII = np.arange(256, dtype=np.uint8)
LOWER_ASCII[65:91] += 32


def _geometric(base: int, n: int) -> np.ndarray:
    """1, base, base^2, ... modulo 2^64, by doubling."""
    out = np.ones(n, np.uint64)
    done, factor = 1, base
    while done < n:
        step = min(done, n - done)
        out[done : done + step] = out[:step] * U(factor)
        done += step
        factor = factor * factor % (1 << 64)
    return out


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse for buffers of up to ``n`` bytes."""
    if not _powers or len(_powers[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        _powers[:] = [_geometric(_BASE, size), _geometric(_INVERSE, size)]
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def buffer_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """One byte array of all texts, each followed by a line feed, and where each text begins (with the end last)."""
    parts = [t.encode("utf-8", "surrogatepass") for t in texts]
    starts = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) + 1 for p in parts], out=starts[1:])
    return np.frombuffer(b"\n".join(parts) + b"\n" if parts else b"", np.uint8), starts


def spans(separator: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that are no separators; the buffer ends with a separator."""
    edge = np.empty(len(separator), bool)
    if len(edge):
        edge[0] = not separator[0]
        np.not_equal(separator[1:], separator[:-1], out=edge[1:])
    at = np.flatnonzero(edge)
    return at[0::2], at[1::2]


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = BYTE_VALUES) -> np.ndarray:
    """A mixed 64-bit hash of buf[start:end] for each span."""
    power, inverse = powers(len(buf) + 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(values[buf] * power[:-1], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts])


def owner(starts: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """Which text each position lies in."""
    return np.searchsorted(starts, positions, "right") - 1


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of A-Z-lower-cased texts and, for each text, where its words begin (with the end last)."""
    buf, starts = buffer_of(texts)
    a, b = spans(WHITE[buf])
    return span_hashes(buf, a, b, BYTE_VALUES[LOWER_ASCII]), np.searchsorted(a, starts)


_ROLES = [U(0xD6E8FEB86659FD93), U(0xA0761D6478BD642F), U(0xE7037ED1A0B428DB), U(0x8EBC6AF09C88C6E3), U(0x589965CC75374CC3), U(0x1D8E4E27C47D124F), U(0xEB44ACCAB455D165), U(0x2127599BF4325C37)]


def shingles(texts: list[str], k: int) -> list[np.ndarray]:
    """The sorted distinct k-word shingles of each text, as hashes; fewer words: the whole sequence as one; no word: none."""
    h, at = words(texts)
    n = len(h)
    grams = np.zeros(n, np.uint64)
    for j in range(min(k, n)):
        grams[: n - j] += h[j:] * (_ROLES[j % 8] + U(2 * (j // 8)))
    grams = mix(grams + U(k))
    out = []
    for i in range(len(texts)):
        a, b = at[i], at[i + 1]
        if b - a >= k:
            out.append(np.unique(grams[a : b - k + 1]))
        elif b > a:
            roles = np.array([int(_ROLES[j % 8]) + 2 * (j // 8) for j in range(b - a)], np.uint64)
            out.append(mix(np.array([(1 << 40) + int(b - a)], np.uint64) + (h[a:b] * roles).sum(keepdims=True)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
