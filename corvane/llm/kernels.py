"""Vectorised hashing of words and shingles over flat byte blocks (numpy, no Python loop per word)."""

from __future__ import annotations

import hashlib

import numpy as np

U = np.uint64
_SEED = U(0xA0761D6478BD642F)
#: Spans up to so many bytes are hashed eight bytes at a time over all spans at once, longer ones by a keyed digest.
SHORT = 64
_SEP = np.zeros(256, bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: The prime 2**31 - 1 and two bases: string hashes are polynomials modulo the prime, one for each base.
PRIME, BASES = (1 << 31) - 1, (1_498_217_663, 902_653_009)
_LOW = np.array([(1 << 8 * i) - 1 for i in range(9)], U)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo PRIME, grown on demand."""
    out = _powers.get(base, np.ones(1, U))
    while len(out) < n:
        out = np.concatenate([out, out * U(pow(base, len(out), PRIME)) % U(PRIME)])
        _powers[base] = out
    return out[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def rolling(buf: np.ndarray, size: int) -> np.ndarray:
    """A hash of the `size` bytes at every place, for choosing places only: unlike strings may well be equal under it."""
    base = 0x9E3779B97F4A7C15
    up, down = (np.multiply.accumulate(np.concatenate([np.ones(1, U), np.full(len(buf), x, U)])) for x in (base, pow(base, -1, 1 << 64)))
    total = np.zeros(len(buf) + 1, U)
    np.cumsum((buf.astype(U) + U(1)) * up[:-1], out=total[1:])
    return mix((total[size:] - total[:-size]) * down[: len(total) - size])


def prefix_hash(buf: np.ndarray) -> list[np.ndarray]:
    """For each base the running sums that `span_hash` takes differences of."""
    out = []
    for base in BASES:
        term = (buf.astype(U) + U(1)) * powers(base, len(buf))
        total = np.zeros(len(buf) + 1, U)
        np.cumsum((term & U(PRIME)) + (term >> U(31)), out=total[1:])  # each term is below 2**32
        out.append(total)
    return out


def span_hash(prefix: list[np.ndarray], start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of long byte spans, equal for equal bytes wherever they stand."""
    h = mix((end - start).astype(U) + _SEED)
    for base, total in zip(BASES, prefix, strict=True):
        inverse = powers(pow(base, -1, PRIME), len(total))
        value = (total[end] - total[start]) % U(PRIME) * inverse[start] % U(PRIME)
        h = mix(h ^ value)
    return h


def hash_spans(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans, eight bytes after eight; made for words."""
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(buf) + 1, "<u8", padded, strides=(1,))
    size = end - start
    h = mix(size.astype(U) + _SEED)
    h = mix(h ^ (eight[start] & _LOW[np.minimum(size, 8)]))
    live = np.flatnonzero((size > 8) & (size <= SHORT))
    at = 8
    while len(live):
        left = size[live] - at
        h[live] = mix(h[live] ^ (eight[start[live] + at] & _LOW[np.minimum(left, 8)]))
        live = live[left > 8]
        at += 8
    for i in np.flatnonzero(size > SHORT).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(buf[start[i] : end[i]].tobytes(), digest_size=8, key=b"span").digest(), "little")
    return h


def word_spans(buf: np.ndarray, off: np.ndarray, sep: np.ndarray = _SEP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the row it stands in. Words never cross rows."""
    n = len(buf)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    word = ~sep[buf]
    before = np.zeros(n, bool)
    before[1:] = word[:-1]
    edges = off[:-1][off[:-1] < n]
    before[edges] = False
    after = np.zeros(n, bool)
    after[:-1] = word[1:]
    after[edges[edges > 0] - 1] = False
    starts, ends = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    return starts, ends, np.searchsorted(off, starts, side="right") - 1


def word_hashes(buf: np.ndarray, off: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every word, A-Z lower-cased if asked."""
    if lower:
        buf = LOWER[buf]
    starts, ends, row = word_spans(buf, off)
    return hash_spans(buf, starts, ends), row


def shingles(words: np.ndarray, row: np.ndarray, k: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every run of `k` words in a row; a row of 1 to k-1 words has its whole sequence as one."""
    n = len(words)
    first = np.searchsorted(row, np.arange(rows + 1))
    count = np.diff(first)
    if n >= k:
        h = np.zeros(n - k + 1, U)
        for i in range(k):
            h = mix(h + words[i : n - k + 1 + i]) if i else mix(words[: n - k + 1].copy())
        whole = row[: n - k + 1] == row[k - 1 :]
        h, of = h[whole], row[: n - k + 1][whole]
    else:
        h, of = np.zeros(0, U), np.zeros(0, np.int64)
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        extra = np.zeros(len(short), U)
        for i in range(k - 1):
            has = count[short] > i
            extra[has] = mix(extra[has] + words[first[short[has]] + i] + U(i * 2 + 1))
        h, of = np.concatenate([h, mix(extra + U(0x5EED))]), np.concatenate([of, short])
        order = np.argsort(of, kind="stable")
        h, of = h[order], of[order]
    return h, of
