"""Words of many texts at once, as 64-bit hashes in flat arrays."""

from __future__ import annotations

import numpy as np

#: Characters of one block; arrays of a block take about 60 bytes each.
BLOCK = 1_000_000
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_WORD = _LETTER.copy()
_WORD[48:58] = True
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 13, 32]] = True
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class _Powers:
    """base^k and base^-k modulo 2^64, made once per process and as long as needed."""

    up = np.zeros(0, dtype=np.uint64)
    down = np.zeros(0, dtype=np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, 2 * BLOCK)
            cls.up, cls.down = _powers(_BASE, size), _powers(pow(_BASE, -1, 1 << 64), size)
        return cls.up, cls.down


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(32))


def _joined(buffer: np.ndarray) -> np.ndarray:
    """UTF-8 bytes without soft hyphens, zero-width spaces, and hyphens with the line end after them inside a word."""
    end = np.flatnonzero(buffer == 10)
    keep = None
    if len(end):
        p = end - 1
        while True:
            back = (p >= 0) & _BLANK[buffer[p]]
            if not back.any():
                break
            p = p - back
        second = np.maximum(p - 1, 0)
        third = np.maximum(p - 2, 0)
        b = buffer[p]
        two = (buffer[second] == 0xC2) & ((b == 0xAD) | (b == 0xAC))
        three = (buffer[third] == 0xE2) & (buffer[second] == 0x80) & ((b == 0x90) | (b == 0x93))
        width = np.where(two, 2, np.where(three, 3, np.where(b == 45, 1, 0)))
        first = p - width + 1
        hit = (width > 0) & (first > 0) & (p >= 0)
        hit &= _LETTER[buffer[np.maximum(first - 1, 0)]]
        first, q = first[hit], end[hit] + 1
        while len(q):
            ahead = _SPACE[buffer[np.minimum(q, len(buffer) - 1)]] & (q < len(buffer))
            if not ahead.any():
                break
            q = q + ahead
        fine = (q < len(buffer)) & _LETTER[buffer[np.minimum(q, len(buffer) - 1)]] if len(q) else np.zeros(0, dtype=bool)
        if fine.any():
            depth = np.zeros(len(buffer) + 1, dtype=np.int8)
            np.add.at(depth, first[fine], 1)
            np.add.at(depth, q[fine], -1)
            keep = np.cumsum(depth[:-1], dtype=np.int8) == 0
    soft = np.flatnonzero((buffer[:-1] == 0xC2) & (buffer[1:] == 0xAD))
    wide = np.flatnonzero((buffer[:-2] == 0xE2) & (buffer[1:-1] == 0x80) & (buffer[2:] == 0x8B))
    if len(soft) or len(wide):
        keep = np.ones(len(buffer), dtype=bool) if keep is None else keep
        for at, n in ((soft, 2), (wide, 3)):
            for k in range(n):
                keep[at + k] = False
    return buffer if keep is None else buffer[keep]


def hash_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): lower-case words of all texts, and where each text's words start (one entry more than texts).

    Words are runs of letters, digits and other characters that are no ASCII punctuation, white space,
    or punctuation of Latin-1 and the general punctuation block; words cut at line ends are joined.
    """
    raw = ("\x00".join(t.replace("\x00", " ") if "\x00" in t else t for t in texts) + "\x00").lower().encode("utf-8", "replace")
    buffer = _joined(np.frombuffer(raw, dtype=np.uint8))
    word = _WORD[buffer]
    for lead, follow, n in ((0xC2, None, 2), (0xE2, (0x80, 0x81), 3), (0xE3, (0x80,), 3)):
        at = np.flatnonzero(buffer == lead)
        at = at[np.isin(buffer[at + 1], follow)] if follow and len(at) else at
        for k in range(n):
            word[at + k] = False
    edge = np.diff(word.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _Powers.upto(len(buffer) + 1)
    total = np.zeros(len(buffer) + 1, dtype=np.uint64)
    np.cumsum(buffer * up[: len(buffer)], out=total[1:])
    hashes = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    first = np.searchsorted(start, np.flatnonzero(buffer == 0))
    return hashes, np.concatenate([[0], first])


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words."""
    size = max(0, len(hashes) - n + 1)
    h = np.zeros(size, dtype=np.uint64)
    for k in range(n):
        h = mix(h * np.uint64(_BASE) + hashes[k : k + size])
    return h


def blocks(texts: list[str | None]):
    """Slices (from, to) of the list with about BLOCK characters each; a longer text is a block of its own."""
    first = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t or "") > BLOCK:
            yield first, i
            first, size = i, 0
        size += len(t or "") + 1
    if first < len(texts):
        yield first, len(texts)
