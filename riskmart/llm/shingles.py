"""Word-shingle sets of whole texts as sorted 64-bit fingerprints, computed by numpy over many texts at once."""

from __future__ import annotations

import numpy as np

WIDTH = 5
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes hashed at once; longer texts go in steps of whole words.
_STEP = 1 << 21


def _mix(x: np.ndarray) -> np.ndarray:
    """Bit mixer on uint64 (xor-shift and odd multipliers)."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, 0x100000001B3, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out)


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start of every word in ``raw`` and its fingerprint."""
    chars = np.frombuffer(raw, dtype=np.uint8)
    edge = np.diff(np.concatenate([[True], _BLANK[chars], [True]]).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    size = end - start
    out = np.zeros(len(start), dtype=np.uint64)
    if not len(start):
        return start, out
    power = _powers(int(size.max()))
    upto, a = np.cumsum(size), 0
    while a < len(start):
        done = upto[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(upto, done + _STEP, side="right")))
        n = size[a:b]
        first = np.cumsum(n) - n
        off = np.arange(int(n.sum())) - np.repeat(first, n)
        value = (chars[off + np.repeat(start[a:b], n)].astype(np.uint64) + np.uint64(1)) * power[off]
        out[a:b] = _mix(np.add.reduceat(value, first) + n.astype(np.uint64) * np.uint64(0x632BE59BD9B4E019))
        a = b
    return start, out


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """Sorted distinct fingerprints of the ``WIDTH``-word shingles of each text (A-Z lower-cased); with
    fewer words the whole sequence is one shingle; without a word the set is empty."""
    out: list[np.ndarray] = []
    held: list[bytes] = []
    size = 0
    for t in texts:
        held.append((t or "").encode().lower())      # bytes.lower() touches A-Z only
        size += len(held[-1]) + 1
        if size >= _STEP:
            out += _sets(held)
            held, size = [], 0
    return out + _sets(held)


def _sets(texts: list[bytes]) -> list[np.ndarray]:
    if not texts:
        return []
    at = np.cumsum([0, *(len(t) + 1 for t in texts)])
    start, h = word_hashes(b"\n".join(texts))
    cut = np.searchsorted(start, at)
    n = max(0, len(h) - WIDTH + 1)
    s = h[:n].copy()
    for k in range(1, WIDTH):
        s = _mix(s * np.uint64(0xA0761D6478BD642F) + h[k:k + n])
    out = []
    for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist()):
        if hi - lo >= WIDTH:
            out.append(np.unique(s[lo:hi - WIDTH + 1]))
        elif hi > lo:
            one = np.array([hi - lo], dtype=np.uint64)
            for x in h[lo:hi]:
                one = _mix(one * np.uint64(0xE7037ED1A0B428DB) + x)
            out.append(one)
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out
