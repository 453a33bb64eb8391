"""Small numpy learners: histogram gradient boosting (squared, logistic, pairwise ranking) and
hashed character n-gram likelihood-ratio tables."""

from __future__ import annotations

import numpy as np


class GradientBoosting:
    """Boosted regression trees over binned features.

    `loss` is "squared", "logistic" (y in {0, 1}; predict gives log-odds) or "rank" (pairwise logistic
    within `groups`; y is relevance). Missing values (nan) go to the first bin.
    """

    def __init__(self, trees: int = 100, depth: int = 4, rate: float = 0.1, bins: int = 32, loss: str = "squared", min_rows: int = 8, l2: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.loss, self.min_rows, self.l2 = trees, depth, rate, bins, loss, min_rows, l2

    def _gradient(self, y, f, pairs):
        if self.loss == "squared":
            return y - f, np.ones_like(f)
        if self.loss == "logistic":
            p = 1 / (1 + np.exp(-f))
            return y - p, p * (1 - p) + 1e-6
        better, worse = pairs
        p = 1 / (1 + np.exp(np.clip(f[better] - f[worse], -30, 30)))
        g = np.bincount(better, p, len(f)) - np.bincount(worse, p, len(f))
        w = p * (1 - p)
        return g, np.bincount(better, w, len(f)) + np.bincount(worse, w, len(f)) + 1e-3

    def fit(self, x: np.ndarray, y: np.ndarray, groups: np.ndarray | None = None) -> "GradientBoosting":
        x = np.nan_to_num(np.asarray(x, dtype=np.float64), nan=-1e30)
        y = np.asarray(y, dtype=np.float64)
        n, k = x.shape
        quantiles = np.linspace(0, 1, self.bins + 1)[1:-1]
        self.edges = [np.unique(np.quantile(x[:, j], quantiles)) for j in range(k)] if n else [np.array([]) for _ in range(k)]
        binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1) if n else np.zeros((0, k), int)
        pairs = None
        if self.loss == "rank":
            a, b = [], []
            order = np.argsort(groups, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(groups[order])) + 1):
                good, rest = rows[y[rows] > 0], rows[y[rows] <= 0]
                a.append(np.repeat(good, len(rest)))
                b.append(np.tile(rest, len(good)))
            pairs = np.concatenate(a), np.concatenate(b)
        self.base = float(y.mean()) if self.loss == "squared" and n else float(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5))) if self.loss == "logistic" and n else 0.0
        f = np.full(n, self.base)
        size = 2 ** (self.depth + 1) - 1
        self.feature, self.threshold, self.value = (np.full((self.trees, size), v, dtype=d) for v, d in ((-1, np.int32), (0.0, np.float64), (0.0, np.float64)))
        width = self.bins + 1
        for t in range(self.trees):
            g, h = self._gradient(y, f, pairs)
            node = np.zeros(n, dtype=np.int64)
            for level in range(self.depth):
                first, count = 2**level - 1, 2**level
                live = (node >= first) & (self.feature[t, np.clip((node - 1) // 2, 0, None)] >= 0) if level else np.ones(n, bool)
                rows = np.flatnonzero(live)
                if not len(rows):
                    break
                at = node[rows] - first
                best = np.full(count, 1e-6)
                split = [(-1, 0)] * count
                for j in range(k):
                    key = at * width + binned[rows, j]
                    gs, hs, cs = (np.bincount(key, w, count * width).reshape(count, width).cumsum(1) for w in (g[rows], h[rows], np.ones(len(rows))))
                    gt, ht, ct = gs[:, -1:], hs[:, -1:], cs[:, -1:]
                    gain = gs**2 / (hs + self.l2) + (gt - gs) ** 2 / (ht - hs + self.l2) - gt**2 / (ht + self.l2)
                    gain[(cs < self.min_rows) | (ct - cs < self.min_rows)] = -1
                    gain[:, len(self.edges[j]) :] = -1
                    top = gain.argmax(1)
                    for q in np.flatnonzero(gain[np.arange(count), top] > best):
                        best[q] = gain[q, top[q]]
                        split[q] = (j, int(top[q]))
                for q, (j, b) in enumerate(split):
                    if j >= 0:
                        self.feature[t, first + q] = j
                        self.threshold[t, first + q] = self.edges[j][b]
                j = self.feature[t, node[rows]]
                go = rows[j >= 0]
                j = j[j >= 0]
                node[go] = 2 * node[go] + 1 + (x[go, j] > self.threshold[t, node[go]])
            gs, hs = np.bincount(node, g, size), np.bincount(node, h, size)
            self.value[t] = self.rate * gs / (hs + self.l2)
            f = f + self.value[t][node]
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        x = np.nan_to_num(np.asarray(x, dtype=np.float64), nan=-1e30)
        n = len(x)
        out, rows = np.full(n, self.base), np.arange(n)
        for t in range(self.trees):
            node = np.zeros(n, dtype=np.int64)
            for _ in range(self.depth):
                j = self.feature[t, node]
                inner = j >= 0
                node = np.where(inner, 2 * node + 1 + (x[rows, np.maximum(j, 0)] > self.threshold[t, node]), node)
            out += self.value[t][node]
        return out


#: Places of the n-grams of the classes, and of all others: each kind has its own, so no count of prose falls on an n-gram of a class.
TABLE_BITS, OTHER_BITS = 19, 20
PLACES = (1 << TABLE_BITS) + (1 << OTHER_BITS)
#: Orders of the n-gram models whose scores are kept; a longer one wins where it was seen.
KEPT = (3, 5, 7)
ORDERS = KEPT[-1]
#: What stands between training texts: no n-gram reaches from one into another.
GAP = "\n" * ORDERS
#: Bytes of prose whose counts are taken as they are; those of more are taken in proportion.
PROSE_MASS = 7_000_000
#: Bytes sorted at a time, and distinct n-grams held before they are added up by place.
PIECE, HELD = 1 << 20, 1 << 22
_DIGITS = bytes(48 if 48 <= i <= 57 else i for i in range(256))


def fold(text: str) -> np.ndarray:
    """Bytes of the lower-cased text, digits read as 0."""
    return np.frombuffer(text.lower().encode("utf-8", "replace").translate(_DIGITS), dtype=np.uint8)


def _grams(buffer: np.ndarray) -> np.ndarray:
    """The ORDERS bytes that end at each position from ORDERS on, as one number; its top bytes are the shorter n-grams."""
    return np.ndarray(len(buffer) - ORDERS, dtype="<u8", buffer=buffer, strides=(1,)) >> np.uint64(8)


def _hashes(grams: np.ndarray) -> np.ndarray:
    return ((grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)


def _places(h: np.ndarray, tags: np.ndarray) -> np.ndarray:
    """Place of each hash: that of the class n-gram it is, by `tags`, or one among the others."""
    own = h >> np.uint32(32 - TABLE_BITS)
    return np.where(tags[own] == h, own, (h >> np.uint32(32 - OTHER_BITS)) + np.uint32(1 << TABLE_BITS))


def _pieces(texts: list[str], read):
    """Bytes of the texts between gaps, PIECE at most and the ORDERS bytes before them."""
    group, held = [], 0
    for i, t in enumerate(texts):
        group.append(t)
        held += len(t)
        if held >= PIECE or i + 1 == len(texts):
            buffer = read(GAP + GAP.join(group) + GAP)
            for a in range(ORDERS, len(buffer), PIECE):
                yield buffer[a - ORDERS : a + PIECE]
            group, held = [], 0


def _distinct(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    grams = np.sort(grams)
    first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
    return grams[first], np.diff(first, append=len(grams))


def class_tags(classes: list[list[str]], read=fold) -> np.ndarray:
    """[order, place]: hash of the class n-gram that has the place, the highest among those that would (0: none)."""
    tags = np.zeros((ORDERS, 1 << TABLE_BITS), dtype=np.uint32)
    for texts in classes:
        for b in _pieces(texts, read):
            grams, _ = _distinct(_grams(b))
            for k in range(1, ORDERS + 1):
                h = _hashes(grams >> np.uint64(8 * (ORDERS - k)))
                np.maximum.at(tags[k - 1], h >> np.uint32(32 - TABLE_BITS), h)
    return tags


class GramCounts:
    """How often n-grams of each order stand in texts, by place, and for the kept orders the n-gram of each place (the
    highest by its bytes). Sums and maxima: the order of texts and their division among counters do not matter.

    Only the n-grams of the highest order are counted text by text; the shorter ones are their ends.
    """

    def __init__(self, tags: np.ndarray, read=fold):
        self.tags, self.read = tags, read
        self.found, self.size = [], 0
        self.added = [(np.zeros(0, dtype=np.intp), np.zeros(0, dtype=np.int64))] * (ORDERS + len(KEPT))

    def add(self, texts: list[str]) -> "GramCounts":
        for b in _pieces(texts, self.read):
            self.found.append(_distinct(_grams(b)))
            self.size += len(self.found[-1][0])
            if self.size > HELD:
                self._join()
                if self.size > HELD // 2:
                    self._place()
        return self

    def _join(self) -> None:
        grams, n = (np.concatenate(x) for x in zip(*self.found))
        order = np.argsort(grams, kind="stable")
        grams, n = grams[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
        self.found, self.size = [(grams[first], np.add.reduceat(n, first))], len(first)

    def _place(self) -> None:
        grams, n = self.found[0]
        counts, names = [], []
        for k in range(1, ORDERS + 1):
            own = grams >> np.uint64(8 * (ORDERS - k))
            at = _places(_hashes(own), self.tags[k - 1])
            counts.append(_totals(at, n, np.add))
            if k in KEPT:
                names.append(_totals(at, own.astype(np.int64), np.maximum))
        self.added = merged(self.added, counts + names)
        self.found, self.size = [], 0

    def parts(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """(places, values) of each order's counts and then of each kept order's n-grams."""
        if self.found:
            self._join()
            self._place()
        return self.added


def merged(a: list[tuple[np.ndarray, np.ndarray]], b: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """The parts of both texts together."""
    return [y if not len(x[0]) else x if not len(y[0]) else _totals(np.concatenate([x[0], y[0]]), np.concatenate([x[1], y[1]]), np.add if i < ORDERS else np.maximum) for i, (x, y) in enumerate(zip(a, b))]


def _totals(at: np.ndarray, values: np.ndarray, join: np.ufunc) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(at, kind="stable")
    at = at[order]
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])[: len(at)])
    return at[first].astype(np.intp), join.reduceat(values[order], first) if len(first) else values


def packed(a: np.ndarray) -> tuple:
    """A mostly empty array by its filled rows, for the way to the workers."""
    at = np.flatnonzero(a if a.ndim == 1 else a.any(axis=1))
    return a.shape, at.astype(np.uint32), a[at]


def unpacked(p: tuple) -> np.ndarray:
    a = np.zeros(p[0], dtype=p[2].dtype)
    a[p[1]] = p[2]
    return a


def ratio_tables(classes: list[list[tuple[np.ndarray, np.ndarray]]], prose: list[tuple[np.ndarray, np.ndarray]], tags: np.ndarray, trust: float = 0.5, mass: float = PROSE_MASS) -> list[tuple[np.ndarray, np.ndarray]]:
    """Character n-gram models of each class and of prose, interpolated from order 1 to 7, from their `GramCounts.parts`.

    Returns, for each kept order, a table [place, class] of log P(byte | context, class) - log P(byte |
    context, prose), and the hash of the n-gram of each place (0: none was seen). Counts of more prose
    than `mass` are taken in proportion, as `trust` and thresholds on the ratios hold for prose of about that size.
    """
    sides = [*classes, prose]
    totals = [float(c[0][1].sum()) for c in sides]
    weights = [1.0] * len(classes) + [min(1.0, mass / max(1.0, totals[-1]))]
    tables = []

    def counted(i, k):
        row = np.zeros(PLACES, dtype=np.float32)
        row[sides[i][k - 1][0]] = sides[i][k - 1][1] * weights[i]
        return row

    for j, top in enumerate(KEPT):
        held = np.zeros(PLACES, dtype=np.int64)
        for c in sides:
            at, grams = c[ORDERS + j]
            held[at] = np.maximum(held[at], grams)
        places = np.flatnonzero(held)
        grams = held[places].astype(np.uint64)
        p = np.full((len(sides), len(places)), 1 / 96, dtype=np.float32)
        for k in range(1, top + 1):
            own = grams >> np.uint64(8 * (top - k))
            here = _hashes(own)
            at = _places(here, tags[k - 1])
            if k > 1:
                context = _places(_hashes(own & np.uint64((1 << 8 * (k - 1)) - 1)), tags[k - 2])
            for i in range(len(sides)):
                seen = counted(i, k - 1)[context] if k > 1 else np.float32(totals[i] * weights[i])
                p[i] = (counted(i, k)[at] + trust * p[i]) / (seen + trust)
        logs = np.log(p)
        table, names = np.zeros((PLACES, len(classes)), dtype=np.float32), np.zeros(PLACES, dtype=np.uint32)
        table[places], names[places] = (logs[:-1] - logs[-1]).T, here
        tables.append((table, names))
    return tables


def gram_scores(buffer: np.ndarray, tables: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Log likelihood ratio at each byte, one column per class, from the longest n-gram seen (unseen: 0)."""
    grams = _grams(np.concatenate([np.zeros(ORDERS, dtype=np.uint8), buffer]))
    out, left = None, None
    for k, (table, names) in zip(KEPT[::-1], tables[::-1]):
        h = _hashes((grams if left is None else grams[left]) >> np.uint64(8 * (ORDERS - k)))
        at = _places(h, names)
        if left is None:
            out, left = table[at], np.flatnonzero(names[at] != h)
            out[left] = 0.0
        else:
            found = names[at] == h
            out[left[found]] = table[at[found]]
            left = left[~found]
        if not len(left):
            break
    return out
