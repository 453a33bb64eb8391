"""Problem 7: documents that contain evaluation items, wholly or in part.

Word n-grams of the items are seeds; how many documents hold each tells the rare ones. One pass over
the texts keeps the seeds of each document with the words around them, a join on the n-gram leads
from there to the items, and (document, item) pairs with enough rare seeds near a diagonal are
aligned (Smith-Waterman within bands along these diagonals), which gives the stretches.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmill.llm import bits
from quillmill.llm import tokens as K
from quillmill.session import broadcast_if_small, materialize

#: Words per seed. A seed is common if more than this share of the documents, or of the items, holds it (at least so many of them).
SEED_WORDS, COMMON_DOCS, COMMON_ITEMS, COMMON_LEAST = 3, 0.01, 0.25, 4
#: The rarest so many of any STRETCH_WORDS - SEED_WORDS + 1 seeds in a row are used, common or not.
ALWAYS_USED = 5
#: Alignment scores, and what makes a leak: share of the item's words, words per stretch, edits per word.
MATCH, EDIT = 2, -4
LEAK_SHARE, STRETCH_WORDS, EDIT_SHARE = 0.4, 10, 1 / 6
#: Seeds of one stretch lie within so many words of a diagonal, and a pair has at least so many seeds.
DRIFT, LEAST_SEEDS = 8, 2
#: Words of all items together up to which they are sent to all executors (16 MB); more are joined by a shuffle.
BROADCAST_WORDS = 2_000_000


def align(item: np.ndarray, region: np.ndarray, low: int | None = None, width: int | None = None) -> tuple[int, list[tuple[int, int]]]:
    """Best local alignment: (score, matched (item, region) positions in order), over region positions
    from item position + low on, `width` of them (all of the region where they are not given)."""
    n, m = len(item), len(region)
    if low is None:
        low, width = -n, n + m
    # column c of row i stands for region position i - 1 + low + c; a step up moves one column to the right
    padded = np.full(n + width, -1, dtype=region.dtype) if region.dtype.kind == "i" else np.zeros(n + width, dtype=region.dtype)
    inside = np.zeros(n + width, dtype=bool)
    a, b = max(0, low), min(m, n + width + low)
    if a < b:
        padded[a - low : b - low] = region[a:b]
        inside[a - low : b - low] = True
    view = np.lib.stride_tricks.sliding_window_view
    score = np.where((view(padded, width)[:n] == item[:, None]) & view(inside, width)[:n], MATCH, EDIT).astype(np.int32)
    h = np.zeros((n + 1, width + 1), dtype=np.int32)
    step = np.arange(width, dtype=np.int32) * -EDIT
    for i in range(1, n + 1):
        row = np.maximum(h[i - 1, :-1] + score[i - 1], h[i - 1, 1:] + EDIT)
        np.maximum(row, 0, out=row)
        h[i, :-1] = np.maximum.accumulate(row + step) - step
    best = int(h.max())
    i, c = divmod(int(h.argmax()), width + 1)
    pairs = []
    while i and h[i, c] > 0:
        if score[i - 1, c] == MATCH and h[i, c] == h[i - 1, c] + MATCH:
            pairs.append((i - 1, i - 1 + low + c))
            i -= 1
        elif h[i, c] == h[i - 1, c] + EDIT:
            i -= 1
        elif h[i, c] == h[i - 1, c + 1] + EDIT:
            i, c = i - 1, c + 1
        else:
            c -= 1
    return best, pairs[::-1]


def stretch(pairs: list[tuple[int, int]]) -> tuple[int, int, int] | None:
    """(first, end, matches) in item words of an alignment that is long and close enough."""
    if not pairs:
        return None
    first, end = pairs[0][0], pairs[-1][0] + 1
    span = max(end - first, pairs[-1][1] + 1 - pairs[0][1])
    if end - first < STRETCH_WORDS or span - len(pairs) > EDIT_SHARE * span + 1e-9:
        return None
    return first, end, len(pairs)


def inner(pairs: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """The longest part of an alignment that is a stretch, and the two parts that are longest together, as far as there are any."""
    if stretch(pairs):
        return [pairs]
    if len(pairs) < 2:
        return []
    a, b = np.array(pairs).T
    length = a[None, :] - a[:, None] + 1
    span = np.maximum(length, b[None, :] - b[:, None] + 1)
    k = np.arange(len(a))
    wrong = span - (k[None, :] - k[:, None] + 1)
    long = np.where((length >= STRETCH_WORDS) & (wrong <= EDIT_SHARE * span + 1e-9), length, 0)
    i, j = divmod(int(long.argmax()), len(a))
    if not long[i, j]:
        return []
    both = np.maximum.accumulate(long.max(0))[:-1] + np.maximum.accumulate(long.max(1)[::-1])[::-1][1:]
    at = int(both.argmax()) + 1
    out = [pairs[i : j + 1]]
    if long[:at, :at].any() and long[at:, at:].any():
        for lo, part in ((0, long[:at, :at]), (at, long[at:, at:])):
            i, j = divmod(int(part.argmax()), len(part))
            out.append(pairs[lo + i : lo + j + 1])
    return out


_PAIR = 0x5851F42D4C957F2D


def _whole_pairs(item: np.ndarray, region: np.ndarray) -> int:
    """Neighbouring words of the item that are neighbours somewhere in the region, too."""
    a, b = (w[:-1] * _PAIR + w[1:] for w in (item, region))
    return int(((a[:, None] == b).any(1) if len(a) * len(b) < 1 << 17 else np.isin(a, b)).sum())


#: An edit breaks at most two of the pairs of neighbouring words in a stretch of n, so n - 2 (n // 6) - 1 or more stay whole.
_LEAST_PAIRS = min(n - 2 * int(n * EDIT_SHARE + 1e-9) - 1 for n in range(STRETCH_WORDS, 2 * STRETCH_WORDS))


def band_stretches(item: np.ndarray, region: np.ndarray, low: int, width: int, at: tuple[int, int] = (0, 0)) -> list[list[tuple[int, int]]]:
    """Stretches of the alignments within a band: that of the best one (or its parts, where it bridges stretches or
    has a poor end), then those of the texts on either side of it. `at`: where item and region begin."""
    if len(item) < STRETCH_WORDS or len(region) < 2 or _whole_pairs(item, region) < _LEAST_PAIRS:
        return []
    _, pairs = align(item, region, low, width)
    if not pairs:
        return []
    parts = inner(pairs)
    a, b = pairs[0] if not parts else parts[0][0]
    c, d = pairs[-1] if not parts else parts[0][-1]
    out = [[(i + at[0], j + at[1]) for i, j in p] for p in parts]
    out += band_stretches(item[:a], region[:b], low, width, at)
    return out + band_stretches(item[c + 1 :], region[d + 1 :], low + c - d, width, (at[0] + c + 1, at[1] + d + 1))


def best_two(found: list[list[tuple[int, int]]]) -> tuple[int, int, int]:
    """(item words, matched words, stretches) of the longest stretch or of the two in order that are longest together."""

    def size(*parts):
        return sum(p[-1][0] + 1 - p[0][0] for p in parts), sum(map(len, parts)), len(parts)

    best = max((size(p) for p in found), default=(0, 0, 0))
    for p in found:
        for q in found:
            if q is p or q[0][0] < p[0][0]:
                continue
            # what they share is left to one of them
            later = inner([x for x in q if x[0] > p[-1][0] and x[1] > p[-1][1]])
            sooner = inner([x for x in p if x[0] < q[0][0] and x[1] < q[0][1]])
            best = max([best, *(size(p, x) for x in later[:1]), *(size(x, q) for x in sooner[:1])])
    return best


def covered(item: np.ndarray, region: np.ndarray) -> tuple[int, int, int]:
    """`best_two` of the stretches of an item in a region, without bands."""
    return best_two(band_stretches(item, region, -len(item), len(item) + len(region)))


def judge(item: np.ndarray, segments: list[tuple[int, np.ndarray]], diagonals: np.ndarray) -> tuple[int, int, int]:
    """`best_two` of an item in the kept segments of a document, within bands along the seeds' diagonals."""
    reach = len(item) // 6 + DRIFT
    d = np.sort(diagonals)
    groups = np.split(d, np.flatnonzero(np.diff(d) > reach) + 1)
    views = []
    for g in groups:
        lo, hi = int(g[0]) - reach, int(g[-1]) + reach
        for start, words in segments:
            a, b = max(lo, start), min(hi + len(item), start + len(words))
            if a < b and start <= g[0] + len(item) and g[0] <= start + len(words):
                views.append((lo, hi - lo + 1, a, words[a - start : b - start]))
    pairs = [_whole_pairs(item, w) for *_, w in views]
    if sum(pairs) < np.ceil(LEAK_SHARE * len(item)) * 2 / 3 - 2:
        return 0, 0, 0
    found = []
    for (lo, width, a, w), n in zip(views, pairs):
        if n >= _LEAST_PAIRS:
            found += [[(i, j + a) for i, j in p] for p in band_stretches(item, w, lo - a, width)]
    return best_two(found)


# ---- seeds --------------------------------------------------------------------------------------


def _words(texts: pd.Series) -> list[np.ndarray]:
    out = []
    texts = texts.tolist()
    for a, b in K.blocks(texts):
        h, first = K.hash_words([t or "" for t in texts[a:b]])
        out += [h[first[k] : first[k + 1]] for k in range(b - a)]
    return out


def item_words(items: DataFrame) -> DataFrame:
    """(item_id, words, n): word hashes of each distinct question of ten or more words."""

    def run(batches):
        for b in batches:
            words = _words(b["q"])
            yield pd.DataFrame({"item_id": b["item_id"], "words": [w.astype(np.int64) for w in words], "n": [len(w) for w in words]})

    rows = items.select(F.col("item_id").cast("bigint").alias("item_id"), "q").filter("q is not null and item_id is not null").distinct()
    return rows.mapInPandas(run, "item_id bigint, words array<bigint>, n int").filter(F.col("n") >= STRETCH_WORDS)


def item_seeds(words: DataFrame) -> DataFrame:
    """(gram, item_id, at, n): every n-gram of every item."""

    def run(batches):
        for b in batches:
            codes = [K.grams(np.asarray(w).astype(np.uint64), SEED_WORDS).astype(np.int64) for w in b["words"]]
            size = [len(c) for c in codes]
            yield pd.DataFrame({"gram": np.concatenate([*codes, np.zeros(0, np.int64)]), "item_id": b["item_id"].repeat(size), "at": np.concatenate([*map(np.arange, size), np.zeros(0)]).astype(int), "n": b["n"].repeat(size)})

    return words.mapInPandas(run, "gram bigint, item_id bigint, at int, n int")


_HITS = "key bigint, doc_id bigint, hits array<struct<gram:bigint,at:int>>, segments array<struct<start:int,words:array<bigint>>>"


def document_hits(documents: DataFrame, filter_: np.ndarray, longest: int) -> DataFrame:
    """(key, doc_id, hits, segments): n-grams of each document that pass the filter, with the words around them.

    Only n-grams with another one no farther off than an item can reach are kept, as a pair needs two seeds.
    """
    reach = longest + longest // 6 + 2 * DRIFT
    sent = documents.sparkSession.sparkContext.broadcast(filter_)

    def run(batches):
        table = sent.value
        for b in batches:
            texts, out = b["text"].tolist(), []
            for lo, hi in K.blocks(texts):
                h, first = K.hash_words([t or "" for t in texts[lo:hi]])
                g = K.grams(h, SEED_WORDS)
                at = np.arange(len(g))
                for shift in (0, 32):
                    at = at[bits.found(table, g[at] >> np.uint64(shift))]
                doc = np.searchsorted(first, at, side="right") - 1
                inside = at + SEED_WORDS <= first[doc + 1]
                at, doc = at[inside], doc[inside]
                near = (np.diff(at) <= reach) & (np.diff(doc) == 0)
                kept = np.append(near, False) | np.append(False, near) if len(at) else np.zeros(0, bool)
                at, doc = at[kept], doc[kept]
                for k in np.unique(doc):
                    own = at[doc == k]
                    start, end = first[k], first[k + 1]
                    cut = np.flatnonzero(np.diff(own) > 2 * reach) + 1
                    segments = [{"start": int(max(start, p[0] - reach) - start), "words": h[max(start, p[0] - reach) : min(end, p[-1] + reach)].astype(np.int64)} for p in np.split(own, cut)]
                    row = lo + int(k)
                    out.append((b["key"].iloc[row], b["doc_id"].iloc[row], [{"gram": x, "at": y} for x, y in zip(g[own].astype(np.int64).tolist(), (own - start).tolist())], segments))
            yield pd.DataFrame(out, columns=["key", "doc_id", "hits", "segments"]).astype({"doc_id": "Int64"})

    return documents.select(F.xxhash64("doc_id", "text").alias("key"), "doc_id", "text").mapInPandas(run, _HITS)


def used_seeds(seeds: DataFrame, hits: DataFrame, n_documents: int, n_items: int) -> DataFrame:
    """(gram, item_id, at, least): the seeds that occur and lead to their items, and how many of them a leak keeps.

    Rare seeds are used, and of any run of seeds as long as the shortest stretch the rarest ALWAYS_USED: a passage
    in very many documents makes its own seeds common and is found all the same. A leak of c words in two
    stretches with an edit in six words keeps c / 2 - 4 of its seeds, less those that are not used.
    """
    frequency = hits.select("key", F.explode("hits.gram").alias("gram")).distinct().groupBy("gram").agg(F.count("*").alias("docs"))
    owners = seeds.groupBy("gram").agg(F.countDistinct("item_id").alias("owners"))
    counted = seeds.join(owners, "gram").join(frequency, "gram", "left").withColumn("docs", F.coalesce("docs", F.lit(0)))
    rare = (F.col("docs") <= max(COMMON_LEAST, COMMON_DOCS * n_documents)) & (F.col("owners") <= max(COMMON_LEAST, COMMON_ITEMS * n_items))
    run = STRETCH_WORDS - SEED_WORDS + 1

    def pick(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("at")
        used = p["rare"].to_numpy(bool).copy()
        if not used.all():
            order = np.lexsort((p["at"], p["owners"], p["docs"]))
            rank = np.empty(len(p), dtype=np.int64)
            rank[order] = np.arange(len(p))
            windows = np.lib.stride_tricks.sliding_window_view(rank, min(run, len(p)))
            chosen = np.argsort(windows, axis=1)[:, :ALWAYS_USED] + np.arange(len(windows))[:, None]
            used[chosen.ravel()] = True
        n = int(p["n"].iloc[0])
        least = max(LEAST_SEEDS, int(np.ceil(LEAK_SHARE * n) / 2 - 4) - int((~used).sum()))
        return p.assign(least=least)[used & (p["docs"].to_numpy() > 0)][["gram", "item_id", "at", "least"]]

    return counted.withColumn("rare", rare).groupBy("item_id").applyInPandas(pick, "gram bigint, item_id bigint, at int, least int")


_LEAK = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("item_id", T.LongType()), T.StructField("item_words", T.IntegerType()), T.StructField("covered_words", T.IntegerType()), T.StructField("matched_words", T.IntegerType()), T.StructField("stretches", T.IntegerType())])


def leaks(documents: DataFrame, items: DataFrame, least_share: float = LEAK_SHARE) -> DataFrame:
    """(doc_id, item_id, item_words, covered_words, matched_words, stretches) of each leaked item.

    Null texts and questions leak nothing, nor do questions under ten words; a document with repeated
    rows is reported once per row; items that repeat a question are each reported. There is no limit on
    the number or length of items: only a filter of bounded size is sent to all executors.
    """
    words = materialize(item_words(items), "items")
    seeds = materialize(item_seeds(words), "seeds")
    longest, n_items, n_words = words.agg(F.coalesce(F.max("n"), F.lit(0)), F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    filter_ = bits.build(seeds.select("gram").distinct(), F.col("gram"), F.shiftrightunsigned("gram", 32))
    hits = materialize(document_hits(documents, filter_, longest), "hits")
    used = materialize(used_seeds(seeds, hits, documents.count(), n_items), "used")
    single = hits.select("key", "hits").dropDuplicates(["key"]).select("key", F.inline("hits")).withColumnRenamed("at", "place")
    met = single.join(broadcast_if_small(used), "gram").select("key", "item_id", "least", "at", (F.col("place") - F.col("at")).alias("diagonal"))
    pairs = met.groupBy("key", "item_id", "least").agg(F.collect_set(F.struct("at", "diagonal")).alias("seeds"))
    pairs = pairs.filter(F.size(F.array_distinct("seeds.at")) >= F.col("least")).select("key", "item_id", F.array_distinct("seeds.diagonal").alias("diagonals"))
    with_words = pairs.join(F.broadcast(words) if n_words <= BROADCAST_WORDS else words, "item_id").groupBy("key").agg(F.collect_list(F.struct("item_id", "words", "diagonals")).alias("items"))

    def run(batches):
        for b in batches:
            out = []
            for doc, segments, candidates in zip(b["doc_id"], b["segments"], b["items"]):
                parts = [(s["start"], np.asarray(s["words"])) for s in segments]
                for c in candidates:
                    item = np.asarray(c["words"])
                    total, matched, found = judge(item, parts, np.asarray(c["diagonals"]))
                    if found and total >= least_share * len(item):
                        out.append((doc, c["item_id"], len(item), total, matched, found))
            yield pd.DataFrame(out, columns=_LEAK.names)

    return hits.select("key", "doc_id", "segments").join(with_words, "key").select("doc_id", "segments", "items").mapInPandas(run, _LEAK)


def leaks_found(documents: DataFrame, items: DataFrame) -> DataFrame:
    return leaks(documents, items).select("doc_id", "item_id").distinct()


def leak_report(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Per leaked item: documents, and the largest share of its words found."""
    return leaks(documents, items).groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_docs"), F.round(F.max(F.col("covered_words") / F.col("item_words")), 4).alias("largest_share"))
