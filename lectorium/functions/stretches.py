"""Digests of stretches of text, and which stretches of a text are whole texts of the same group.

Sums of code points times powers give the digest of any stretch in one step.  A bitmap holds, by group, the first
``STEPS`` signs of every text, its longest head whose length is a power of two, and the whole; a stretch that is not
in it stands for no text.  A full bitmap costs time, never a result: what it lets through is joined by ``exact``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np

#: Lengths of heads that places must pass before longer stretches are tried.
STEPS = (1, 4, 16)
HEAD, FIRST, WHOLE = 1, 2, 3
BASE = 0x9E3779B97F4A7C15 | 1
#: Stretches that are tried at once.
TRIED = 4_000_000


def exact(text: str) -> bytes:
    return hashlib.md5(text.encode("utf-8", "surrogatepass")).digest()


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, b, np.uint64)]), dtype=np.uint64) for b in (BASE, pow(BASE, -1, 1 << 64)))
    return up, down


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ h >> np.uint64(32)


class Stretches:
    """Many texts at once."""

    def __init__(self, texts: Sequence[str]):
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.ends = np.cumsum(self.sizes)
        self.begins = self.ends - self.sizes
        cp = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        self.up, down = _powers(len(cp))
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum((cp + np.uint64(7)) * down[: len(cp)], dtype=np.uint64)])
        # the longest power of two that is not longer than the text
        self.first = np.where(self.sizes > 0, 1 << np.log2(np.maximum(self.sizes, 1)).astype(np.int64), 0)

    def digest(self, place: np.ndarray, size, group: np.ndarray, kind: int) -> np.ndarray:
        salt = np.atleast_1d(size).astype(np.uint64) * np.uint64(0x632BE59BD9B4E019) + np.uint64(kind * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF)
        return _mix((self.sums[place + size] - self.sums[place]) * self.up[place] + group * np.uint64(0xA24BAED4963EE407) + salt)


def _bits(d: np.ndarray, bits: int, kind: int) -> list[np.ndarray]:
    """Places in the bitmap: one of a head, three of a whole text."""
    keep = np.uint64((1 << bits) - 1)
    return [d & keep] if kind != WHOLE else [d & keep, d >> np.uint64(64 - bits), _mix(d + np.uint64(BASE)) & keep]


def bits_of(texts: Sequence[str], groups: Sequence[np.ndarray], bits: int) -> np.ndarray:
    """Places in the bitmap that the texts take, once each.  groups: the digests of each text's groups."""
    s, out = Stretches(texts), []
    for g in groups:
        for n in STEPS:
            at = np.flatnonzero(s.sizes >= n)
            out += _bits(s.digest(s.begins[at], n, g[at], HEAD), bits, HEAD)
        at = np.flatnonzero(s.sizes > 0)
        for kind, n in ((FIRST, s.first), (WHOLE, s.sizes)):
            out += _bits(s.digest(s.begins[at], n[at], g[at], kind), bits, kind)
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def _known(bitmap: np.ndarray, d: np.ndarray, kind: int) -> np.ndarray:
    bits = (len(bitmap) * 64).bit_length() - 1
    has = [(bitmap[(b >> np.uint64(6)).astype(np.int64)] >> (b & np.uint64(63))) & np.uint64(1) == 1 for b in _bits(d, bits, kind)]
    return np.logical_and.reduce(has)


def found(texts: Sequence[str], groups: Sequence[np.ndarray], bitmap: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(text, start, size) of stretches, other than whole texts, that the bitmap holds as a text of a common group."""
    s = Stretches(texts)
    row = np.repeat(np.arange(len(texts)), s.sizes)
    for k, g in enumerate(groups):
        at = np.flatnonzero(np.all([g != h for h in groups[:k]], 0)[row]) if k else np.arange(len(row))
        own = g[row]
        size, longest = 1, int(s.sizes.max(initial=0))
        while size <= longest and len(at):
            at = at[at + size <= s.ends[row[at]]]
            if size in STEPS:
                at = at[_known(bitmap, s.digest(at, size, own[at], HEAD), HEAD)]
            hit = at[_known(bitmap, s.digest(at, size, own[at], FIRST), FIRST)]
            # each length up to twice the head's, some places at a time
            many = np.minimum(2 * size, s.ends[row[hit]] - hit + 1) - size
            step = max(1, TRIED // size)
            for i in range(0, len(hit), step):
                p, n = hit[i : i + step], many[i : i + step]
                place = np.repeat(p, n)
                length = size + np.arange(len(place)) - np.repeat(np.cumsum(n) - n, n)
                r = row[place]
                part = length < s.sizes[r]
                place, length, r = place[part], length[part], r[part]
                ok = _known(bitmap, s.digest(place, length, own[place], WHOLE), WHOLE)
                yield from zip(r[ok].tolist(), (place - s.begins[r])[ok].tolist(), length[ok].tolist())
            size *= 2
