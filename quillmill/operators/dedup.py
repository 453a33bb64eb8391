"""Exact and near duplicates: shingles, MinHash signatures, banded candidates, classes."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmill.functions.text import let, lower_words
from quillmill.session import materialize

SHINGLE, PERMUTATIONS, BANDS, THRESHOLD = 5, 128, 16, 0.8
PRIME = 4294967311  # just above 2^32
EMPTY = 0xFFFFFFFF


def permutations(n: int = PERMUTATIONS) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers below 2^30 and offsets below 2^32 by rule, so that any engine can make them."""
    k = np.arange(1, n + 1, dtype=np.int64)
    return (k * 7368787 + 12345) % (1 << 30) | 1, (k * 104395301 + 2713) % (1 << 32)


def shingles(text: Column, k: int = SHINGLE) -> Column:
    """Distinct runs of k lower-case words; fewer than k words give none."""
    none = F.array().cast("array<string>")
    runs = lambda w: F.when(F.size(w) < k, none).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (k - 1), F.lit(1))), lambda i: F.array_join(F.slice(w, i, k), " "))))
    return let(lower_words(text), runs)


def _hashes(found: list[str], kind: str) -> np.ndarray:
    if kind == "md5":
        return np.fromiter((int(hashlib.md5(s.encode()).hexdigest()[:8], 16) for s in found), dtype=np.int64, count=len(found))
    import xxhash

    return np.fromiter((xxhash.xxh32_intdigest(s) for s in found), dtype=np.int64, count=len(found))


def signature(text: str | None, k: int = SHINGLE, kind: str = "xxhash") -> list[int]:
    """Minima of the permuted hashes of the shingles; all EMPTY where there are none."""
    w = (text or "").lower().split()
    found = list({" ".join(w[i : i + k]) for i in range(len(w) - k + 1)})
    if not found:
        return [EMPTY] * PERMUTATIONS
    a, b = permutations()
    h, least = _hashes(found, kind), np.full(PERMUTATIONS, np.iinfo(np.int64).max)
    for i in range(0, len(h), 2048):
        least = np.minimum(least, ((a[:, None] * h[None, i : i + 2048] + b[:, None]) % PRIME).min(1))
    return least.tolist()


def signatures(documents: DataFrame, kind: str = "xxhash") -> DataFrame:
    """(doc_id, signature ARRAY<BIGINT>); null texts have the empty signature."""

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def sign(text: pd.Series) -> pd.Series:
        return pd.Series([signature(t, kind=kind) for t in text])

    return documents.select("doc_id", sign(F.col("text")).alias("signature"))


def exact_groups(documents: DataFrame) -> DataFrame:
    """(doc_id, first_id): the lowest doc_id with the same text. Null texts are a group of their own each.

    The lowest id per hash is pre-aggregated and joined back on the hash; AQE splits a hot hash."""
    keyed = documents.select("doc_id", F.sha2(F.coalesce("text", F.concat(F.lit("\x00null"), F.col("doc_id").cast("string"))), 256).alias("_h"))
    first = keyed.groupBy("_h").agg(F.min("doc_id").alias("first_id"))
    return keyed.join(first, "_h").select("doc_id", "first_id")


def exact_dedup(documents: DataFrame) -> DataFrame:
    """The rows whose text has no copy under a lower doc_id."""
    keep = exact_groups(documents).filter("doc_id = first_id").select(F.col("doc_id").alias("_keep")).distinct()
    return documents.join(keep, F.col("doc_id") == F.col("_keep"), "left_semi")


def band_keys(signed: DataFrame, bands: int = BANDS) -> DataFrame:
    """(band, key, doc_id): one row per band; documents without shingles collide with nothing and are left out."""
    rows = PERMUTATIONS // bands
    keys = F.array(*[F.struct(F.lit(b).alias("band"), F.concat_ws(",", F.slice("signature", b * rows + 1, rows)).alias("key")) for b in range(bands)])
    return signed.filter(F.element_at("signature", 1) != EMPTY).select("doc_id", F.explode(keys).alias("_b")).select(F.col("_b.band").alias("band"), F.xxhash64("_b.key").alias("key"), "doc_id")


def similarity(a: Column, b: Column) -> Column:
    """Share of equal signature positions."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / F.lit(float(PERMUTATIONS))


#: Rounds with a pivot per bucket, documents per block of a bucket after that, and bucket size from which it is split first.
PIVOT_ROUNDS, BLOCK_DOCS, SPLIT_DOCS = 3, 4000, 4000


def equal_positions(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)


def near_links(signed: DataFrame, threshold: float = THRESHOLD, rounds: int = PIVOT_ROUNDS, block: int = BLOCK_DOCS, split: int = SPLIT_DOCS) -> DataFrame:
    """(a, b) with a < b: links that connect what all similar pairs within the buckets connect.

    For `rounds` rounds the lowest document of each bucket is its pivot. Those like it are linked to it; the others
    go to the next round, and are compared with those like the pivot as far as their distances to it allow: the share
    of unequal positions is a metric, so two documents whose distances differ by 1 - threshold or more are not
    alike, nor is a document twice that far from the pivot like any that is like it. What is left after that is compared in
    blocks (`_block_links`). No similar pair of a bucket is left unconnected.
    """
    signed = materialize(signed, "signatures")
    sig = lambda name: signed.select(F.col("doc_id").alias(name), F.col("signature").alias(f"sig_{name}"))
    left = band_keys(signed)
    sizes = left.groupBy("band", "key").agg(F.count("*").alias("_n")).filter("_n > 1")
    left = materialize(left.join(sizes, ["band", "key"]).drop("_n"), "buckets")
    far = (1 - threshold) * PERMUTATIONS  # similar pairs have fewer unequal positions
    links = signed.select(F.col("doc_id").alias("a"), F.col("doc_id").alias("b")).limit(0)

    def compare(pairs: DataFrame) -> DataFrame:
        return pairs.join(sig("a"), "a").join(sig("b"), "b").withColumn("apart", PERMUTATIONS - equal_positions(F.col("sig_a"), F.col("sig_b"))).drop("sig_a", "sig_b")

    for _ in range(rounds):
        pivot = left.groupBy("band", "key").agg(F.min("doc_id").alias("a"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
        judged = materialize(compare(left.join(pivot, ["band", "key"]).filter("doc_id <> a").withColumnRenamed("doc_id", "b")), "judged")
        alike, other = judged.filter(F.col("apart") < far), judged.filter(F.col("apart") >= far)
        links = links.union(alike.select("a", "b"))
        left = other.select("band", "key", F.col("b").alias("doc_id"))
        if left.isEmpty():
            return materialize(links.distinct(), "links")
        edge = other.filter(F.col("apart") < 2 * far).select("band", "key", F.col("b").alias("y"), F.col("apart").alias("_y"))
        crossed = alike.select("band", "key", F.col("b").alias("x"), F.col("apart").alias("_x")).join(edge, ["band", "key"]).filter(F.col("_y") - F.col("_x") < far)
        links = links.union(compare(crossed.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()).filter(F.col("apart") < far).select("a", "b"))
    return materialize(links.union(_block_links(left, signed, far, block, split)).distinct(), "links")


def _block_links(left: DataFrame, signed: DataFrame, far: float, block: int, split: int) -> DataFrame:
    """Links between the documents left in each bucket, all compared with all, in blocks of about `block` documents a side.

    A bucket over `split` documents is split once before: positions are cut into one more run than a similar pair may
    have unequal positions, so such a pair agrees in a whole run, and only documents that do meet. Tasks get two
    blocks each and give links only.
    """
    left = materialize(left, "left")
    sizes = left.groupBy("band", "key").agg(F.count("*").alias("n"))
    marked = left.join(sizes, ["band", "key"]).join(signed, "doc_id")
    runs = math.ceil(far)  # fewer unequal positions than runs
    cuts = [round(i * PERMUTATIONS / runs) for i in range(runs + 1)]
    keys = F.array(*[F.xxhash64("band", "key", F.lit(i), F.concat_ws(",", F.slice("signature", a + 1, b - a))) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))])
    whole = F.array(F.xxhash64("band", "key"))
    groups = materialize(marked.select("doc_id", F.explode(F.when(F.col("n") > split, keys).otherwise(whole)).alias("group")), "groups")
    counts = groups.groupBy("group").agg(F.ceil(F.count("*") / block).alias("blocks"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    placed = groups.join(counts, "group").withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("blocks")))
    # each block meets itself and every other one once, the lower number first
    paired = placed.withColumn("with", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))).join(signed, "doc_id")
    paired = paired.select("group", F.least("own", "with").alias("low"), F.greatest("own", "with").alias("high"), "own", "doc_id", "signature")

    def links(p: pd.DataFrame) -> pd.DataFrame:
        low, high = int(p["low"].iloc[0]), int(p["high"].iloc[0])
        sides = [(q["doc_id"].to_numpy(), np.array(q["signature"].tolist(), dtype=np.int64).reshape(len(q), -1)) for q in (p[p["own"] == low], p[p["own"] == high])]
        (ids, own), (others, their) = sides
        out = []
        for i, s in zip(ids, own) if len(others) else ():
            near = others[((their != s).sum(1) < far) & (others != i)]
            out += [(min(i, j), max(i, j)) for j in near.tolist()]
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return paired.groupBy("group", "low", "high").applyInPandas(links, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, class_id): the lowest id of each connected component, by alternating star contraction."""
    edges = materialize(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("m").alias("a"), "b").filter("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select("m", F.explode(F.array("u", "v")).alias("b")).filter("m <> b").select(F.col("m").alias("a"), "b").distinct()
        new = materialize(small, "edges")
        if new.count() == edges.count() and new.exceptAll(edges).isEmpty():
            break
        edges = new
    return edges.select(F.explode(F.array("a", "b")).alias("id"), F.col("a").alias("m")).groupBy("id").agg(F.min("m").alias("class_id"))


def near_duplicates(documents: DataFrame, kind: str = "xxhash", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, n_links): one row per doc_id with the lowest id of its class and the links found for it.

    Exact copies are collapsed first and get the class of their first copy. Documents with fewer than
    five words are alone unless they are copies. Null texts are alone; an empty table gives no rows.
    """
    groups = materialize(exact_groups(documents.select("doc_id", "text").dropDuplicates(["doc_id"])), "groups")
    first = documents.select("doc_id", "text").dropDuplicates(["doc_id"]).join(groups.filter("doc_id = first_id").select(F.col("doc_id").alias("_f")), F.col("doc_id") == F.col("_f"), "left_semi")
    links = near_links(signatures(first, kind), threshold)
    classes = components(links)
    ends = links.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("_links"))
    per = groups.join(classes.withColumnRenamed("id", "first_id"), "first_id", "left").join(ends.withColumnRenamed("id", "first_id"), "first_id", "left")
    return per.select("doc_id", F.coalesce("class_id", "first_id").alias("class_id"), F.coalesce("_links", F.lit(0)).cast("bigint").alias("n_links"))


def survivors(documents: DataFrame, classes: DataFrame) -> DataFrame:
    """doc_ids that stay: of each class the longest text, the lowest id among equals."""
    sized = documents.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("_n")).dropDuplicates(["doc_id"]).join(classes, "doc_id")
    return sized.groupBy("class_id").agg(F.max_by("doc_id", F.struct("_n", -F.col("doc_id"))).alias("doc_id")).select("doc_id", "class_id")
