"""Corpus operators: profile, quality filter, splitting, train/validation cut, passages, keyword search."""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from functools import reduce
from itertools import accumulate, islice

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmill.functions import lexicon as L
from quillmill.functions import text as X
from quillmill.session import broadcast_if_small, materialize


def category_key(category: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(category)), "[ -]", "_")


def breakdown(documents: DataFrame, by: str) -> DataFrame:
    """Documents, token estimates and share of all tokens per value of `by` (null is a value)."""
    per = documents.groupBy(by).agg(F.count("*").alias("n_docs"), F.sum(X.token_estimate(F.col("text"))).alias("tokens"))
    return per.withColumn("share", F.col("tokens") / F.greatest(F.sum("tokens").over(Window.partitionBy()), F.lit(1)))  # over one row per value


def mixing_check(documents: DataFrame, targets: dict[str, float] = L.MIXING_TARGETS, tolerance: float = 0.05) -> DataFrame:
    """Each target category with its share (0 where it has no documents) and whether it is within the tolerance."""
    have = breakdown(documents.withColumn("category", category_key(F.col("category"))), "category")
    want = documents.sparkSession.createDataFrame(list(targets.items()), "category string, target double")
    return have.select("category", "share").join(F.broadcast(want), "category", "right").select("category", "target", F.coalesce("share", F.lit(0.0)).alias("actual"), (F.abs(F.coalesce("share", F.lit(0.0)) - F.col("target")) <= tolerance).alias("ok"))


def repeated_lines(documents: DataFrame, times: int = 3) -> DataFrame:
    """(doc_id, line, n): stripped lines that occur more than `times` times in a document, counted inside the row."""

    @F.pandas_udf(T.ArrayType(T.StructType([T.StructField("line", T.StringType()), T.StructField("n", T.LongType())])))
    def repeated(text: pd.Series) -> pd.Series:
        def one(t):
            counts = Counter(x for x in map(str.strip, (t or "").split("\n")) if x)
            return [{"line": x, "n": n} for x, n in counts.items() if n > times]

        return text.map(one)

    return documents.select("doc_id", F.inline(repeated(F.col("text"))))


def quality_outcome(text: Column, category: Column, path: Column, phrases: list[str] = L.ARGUMENT_PHRASES, least: int = 500, least_priority: int = 200, density: float = 2.0, density_neuro: float = 1.0) -> Column:
    """too_short, priority, dense or sparse. Short texts stay only in priority categories; those are never judged by density."""
    n = F.coalesce(F.length(text), F.lit(0))
    first = F.coalesce(category.isin(L.PRIORITY_CATEGORIES), F.lit(False))
    need = F.when(F.coalesce(F.lower(path).contains("neuroscience"), F.lit(False)), density_neuro).otherwise(density)
    return F.when((n < least) & ~(first & (n >= least_priority)), "too_short").when(first, "priority").when(X.argument_density(text, phrases) >= need, "dense").otherwise("sparse")


def quality_filter(documents: DataFrame) -> DataFrame:
    """The documents that are not too short or sparse."""
    outcome = quality_outcome(F.col("text"), category_key(F.col("category")), F.col("source"))
    return documents.withColumn("outcome", outcome).filter(F.col("outcome").isin("priority", "dense"))


# ---- sequences ----------------------------------------------------------------------------------


def cut_greedily(sizes: list[int], most: int) -> list[tuple[int, int]]:
    """Slices [from, to) of consecutive items, each as long as its sizes add up to `most` at the most (one item at least)."""
    total, out, start = [0, *accumulate(sizes)], [], 0
    while start < len(sizes):
        end = max(start + 1, bisect_right(total, total[start] + most) - 1)
        out.append((start, end))
        start = end
    return out


def paragraph_chunks(text: Column, most: Column | int, separator: str = "\n\n") -> Column:
    """Greedy chunks of whole paragraphs up to `most` tokens (estimated per paragraph); a longer paragraph is a chunk.

    The cuts are found in running totals, linear in the text; null stays null.
    """

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def chunks(texts: pd.Series, limits: pd.Series) -> pd.Series:
        def one(t, limit):
            if t is None:
                return None
            parts = t.split(separator)
            return [separator.join(parts[a:b]) for a, b in cut_greedily([int(len(p.split()) * 1.3) for p in parts], int(limit))]

        return pd.Series([one(t, m) for t, m in zip(texts, limits)], dtype=object)

    return chunks(text, F.lit(most) if isinstance(most, int) else most)


def split_sequences(documents: DataFrame, most: int = 8192, least_chars: int = 50) -> DataFrame:
    """(doc_id, chunk_idx, category, text, tokens): documents over `most` tokens in chunks, others whole; texts under `least_chars` are left out."""
    kept = documents.filter(F.length(X.strip(F.col("text"))) >= least_chars)
    over = F.when(X.token_estimate(F.col("text")) > most, F.col("text"))  # only these go to a worker
    chunks = F.coalesce(paragraph_chunks(over, most), F.array("text"))
    return kept.select("doc_id", "category", F.posexplode(chunks).alias("chunk_idx", "text")).withColumn("tokens", X.token_estimate(F.col("text")))


def train_val(rows: DataFrame, keys: list[str], share: float = 0.95, seed: int = 42) -> DataFrame:
    """Rows with `split`: floor(share x n) rows in seeded hash order are train, the rest val.

    The order is by md5 of seed and keys. Rows are counted per hash bucket (65,536 at most) and only the bucket that
    holds the cut is sorted, on its keys; the others are placed by their bucket. No row is shuffled. Rows with the same
    keys stay together, on the train side if the cut falls among them.
    """
    mark = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]).cast("binary"))
    place = materialize(rows.select(mark.alias("_m"), F.substring(mark, 1, 4).alias("_b")), "order")
    counts = sorted((r._b, r.n) for r in place.groupBy("_b").agg(F.count("*").alias("n")).collect())
    left, last = math.floor(sum(n for _, n in counts) * share), ""
    bucket = None
    for bucket, n in counts:
        if left <= n:
            break
        left -= n
    if bucket is not None and left > 0:
        last = place.filter(F.col("_b") == bucket).orderBy("_m").limit(left).agg(F.max("_m")).first()[0]
    elif bucket is not None:
        last = bucket  # a prefix comes before all marks of its bucket
    return rows.withColumn("split", F.when(mark <= last, "train").otherwise("val"))


def dataset_card(split: DataFrame) -> DataFrame:
    """One row: train and val sequences and tokens, total, categories of the train part."""
    tokens = F.col("tokens")
    train = F.col("split") == "train"
    return split.agg(F.count_if(train).alias("train_sequences"), F.count_if(~train).alias("val_sequences"), F.coalesce(F.sum(F.when(train, tokens)), F.lit(0)).alias("train_tokens"), F.coalesce(F.sum(F.when(~train, tokens)), F.lit(0)).alias("val_tokens"), F.coalesce(F.sum(tokens), F.lit(0)).alias("total_tokens"))


def train_categories(split: DataFrame) -> DataFrame:
    return split.filter("split = 'train'").groupBy("category").agg(F.count("*").alias("n"))


# ---- passages and search ------------------------------------------------------------------------


def chunk_bounds(sizes: list[int], size: int, overlap: int) -> list[tuple[int, int]]:
    """Slices [from, to) of sentences by their word counts, from running totals.

    A chunk ends before the first sentence that would take it over `size` words, but has one sentence more than what it
    shares with the chunk before. The next one starts with the earliest of its sentences from which at most `overlap` words remain.
    """
    total = [0, *accumulate(sizes)]
    bounds, start, end = [], 0, 0
    while end < len(sizes):
        end = max(end + 1, bisect_right(total, total[start] + size) - 1)
        bounds.append((start, end))
        start = max(start, bisect_left(total, total[end] - overlap))
    return bounds


def sentence_chunks(text: str | None, size: int = 512, overlap: int = 64, least: int = 50) -> list[str]:
    """Chunks of whole sentences of up to `size` words that share up to `overlap` words of whole sentences; those of
    `least` characters or fewer are left out."""
    sentences = re.split(r"(?<=[.!?])\s+", text or "")
    joined = (" ".join(sentences[a:b]).strip() for a, b in chunk_bounds([len(x.split()) for x in sentences], size, overlap))
    return [c for c in joined if len(c) > least]


@F.pandas_udf(T.ArrayType(T.StringType()))
def _chunks(text: pd.Series, size: pd.Series, overlap: pd.Series) -> pd.Series:
    return pd.Series([sentence_chunks(t, int(s), int(o)) for t, s, o in zip(text, size, overlap)])


def passages(documents: DataFrame, size: int = 512, overlap: int = 64) -> DataFrame:
    """(doc_id, chunk_index, passage, category, source) of each document."""
    return documents.select("doc_id", "category", "source", F.posexplode(_chunks("text", F.lit(size), F.lit(overlap))).alias("chunk_index", "passage"))


def keywords(rows: DataFrame, keys: list[str], text: str = "passage", top: int = 30, boost: int = 3) -> DataFrame:
    """(keys, rank, keyword, score): words by frequency, domain terms times `boost`, ties by first place; per row, in the row."""
    domain = frozenset(L.DOMAIN_TERMS)
    entry = T.StructType([T.StructField("rank", T.IntegerType()), T.StructField("keyword", T.StringType()), T.StructField("score", T.LongType())])

    @F.pandas_udf(T.ArrayType(entry))
    def best(tokens: pd.Series) -> pd.Series:
        def one(words):
            counts = Counter(() if words is None else words)  # in order of first place
            scored = sorted(((n * boost if w in domain else n, w) for w, n in counts.items()), key=lambda x: -x[0])[:top]
            return [{"rank": i, "keyword": w, "score": n} for i, (n, w) in enumerate(scored, 1)]

        return tokens.map(one)

    return rows.select(*keys, F.inline(best(X.keyword_tokens(F.col(text), L.STOPWORDS))))


def keyword_search(postings: DataFrame, keys: list[str], queries: DataFrame, top: int = 5) -> DataFrame:
    """(query_id, rank, keys, score): entries by shared keywords, one more per shared domain term; ties by key order."""
    terms = queries.select("query_id", F.explode(X.query_tokens(F.col("query"), L.STOPWORDS)).alias("keyword"))
    found = postings.select(*keys, "keyword").join(broadcast_if_small(terms), "keyword").groupBy("query_id", *keys).agg(F.sum(1 + F.col("keyword").isin(L.DOMAIN_TERMS).cast("int")).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), *keys))
    return found.withColumn("rank", rank).filter(F.col("rank") <= top).select("query_id", "rank", *keys, "score")


#: Claims whose keywords go to all executors at once.
CLAIM_BLOCK = 20_000


def corpus_matches(rows: DataFrame, keys: list[str], text: str, claims: DataFrame, least: int = 2, best: bool = False, block: int = CLAIM_BLOCK) -> DataFrame:
    """(claim_id, keys, score): texts in which at least `least` keywords of a claim occur as substrings.

    `claims` is a stated query set (claim_id, claim): the keywords of `block` claims at a time go to all executors in one
    automaton, and each text is read once per block. With `best`, each task gives only its best match per claim (highest
    score, lowest keys, which are numbers), so that `best_match` shuffles one row per claim and task.
    """
    stop = set(L.VERIFIER_STOP)
    schema = T.StructType([T.StructField("claim_id", T.LongType()), *[rows.schema[k] for k in keys], T.StructField("score", T.LongType())])
    given, parts = claims.select("claim_id", "claim").filter("claim is not null").toLocalIterator(), []
    while few := list(islice(given, block)):
        owners: dict[str, list[tuple[int, int]]] = {}
        for r in few:
            for w, n in Counter(w for w in r.claim.lower().split() if w not in stop and len(w) > 2).items():
                owners.setdefault(w, []).append((r.claim_id, n))
        sent = rows.sparkSession.sparkContext.broadcast(owners)

        def run(batches, sent=sent):
            import ahocorasick

            held = sent.value
            automaton = ahocorasick.Automaton()
            for w in held:
                automaton.add_word(w, w)
            if held:
                automaton.make_automaton()
            top: dict[int, tuple] = {}
            for b in batches:
                out = []
                for t, *at in zip(b[text], *(b[k].tolist() for k in keys)) if held else ():
                    if not t:
                        continue
                    score: Counter = Counter()
                    for w in {w for _, w in automaton.iter(t.lower())}:
                        for cid, n in held[w]:
                            score[cid] += n
                    at = tuple(at)
                    if best:
                        for cid, n in score.items():
                            if n >= least and (cid not in top or (-n, at) < top[cid]):
                                top[cid] = (-n, at)
                    else:
                        out += [(cid, *at, n) for cid, n in score.items() if n >= least]
                if out:
                    yield pd.DataFrame(out, columns=schema.names)
            if top:
                yield pd.DataFrame([(cid, *at, -n) for cid, (n, at) in top.items()], columns=schema.names)

        parts.append(rows.select(*keys, text).mapInPandas(run, schema))
    return reduce(DataFrame.union, parts) if parts else rows.sparkSession.createDataFrame([], schema)


def best_match(matches: DataFrame, keys: list[str]) -> DataFrame:
    """The match with the highest score per claim, the first by key among equals."""
    order = F.struct(F.col("score"), *[-F.col(k) for k in keys])
    return matches.groupBy("claim_id").agg(F.max_by(F.struct(*keys, "score"), order).alias("_m")).select("claim_id", "_m.*")
