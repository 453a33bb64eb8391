"""Claims: extraction and routing, the knowledge store, its hash chain and invalidation."""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmill.functions import lexicon as L
from quillmill.functions import scalars as S
from quillmill.functions import text as X
from quillmill.session import materialize

TIERS = (1, 2, 3, 4)
STATUSES = ("verified", "refuted", "conditional", "timeout", "not_formalizable")


def extract_claims(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, claim_no, claim, claim_type, confidence, start, end): sentences of ten characters or more.

    Offsets advance by length + 1 per sentence, short ones included, whatever white space stood between.
    """
    parts = rows.select(key, F.posexplode(X.claim_sentences(F.col(text))).alias("claim_no", "_s"))
    n = F.length("_s")
    start = F.coalesce(F.sum(n + 1).over(Window.partitionBy(key).orderBy("claim_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = parts.withColumn("start", start).filter(F.length(X.strip(F.col("_s"))) >= 10).withColumn("claim_type", S.claim_type(F.col("_s")))
    return kept.select(key, "claim_no", X.strip(F.col("_s")).alias("claim"), "claim_type", S.claim_confidence(F.col("_s"), F.col("claim_type")).alias("confidence"), F.col("start").cast("bigint").alias("start"), (F.col("start") + n).cast("bigint").alias("end"))


def subclaims(text: Column, most: int = 3, least: int = 10) -> Column:
    """Up to `most` lines longer than `least` characters."""
    return F.slice(F.filter(F.transform(F.split(text, "\n"), X.strip), lambda s: F.length(s) > least), 1, most)


def store_lookup(claims: DataFrame, key: str, store: DataFrame) -> DataFrame:
    """(key, claim, record_id, match): the stored record with the same normalised text, else the first by `seq`
    whose content words have Jaccard over 0.75, else null.

    The similar step joins on words (a pair over 0.75 shares most of them) within the length window
    0.75 |a| < |b| < |a| / 0.75, on a prefix of the rarest words that any such pair must share.
    """
    stop = F.array(*map(F.lit, L.EQUIVALENCE_STOP))
    record = store.select("record_id", "seq", X.normalise_claim(F.col("claim_text")).alias("_t"))
    exact = record.groupBy("_t").agg(F.min_by("record_id", "seq").alias("_exact"))
    asked = claims.select(key, "claim", X.normalise_claim(F.col("claim")).alias("_n"))
    first = asked.join(exact, F.col("_n") == F.col("_t"), "left").drop("_t")
    rest = first.filter("_exact is null").select("_n").distinct().withColumn("_a", F.array_except(F.array_distinct(F.split("_n", " ")), stop))
    known = record.withColumn("_b", F.array_except(F.array_distinct(F.split("_t", " ")), stop)).filter(F.size("_b") > 0)
    counts = known.select(F.explode("_b").alias("_w")).groupBy("_w").agg(F.count("*").alias("_c"))
    # of n words at most floor(n / 4) may be missing: one of the n - ceil(0.75 n) + 1 rarest is shared
    def prefix(df: DataFrame, ids: list[str], words: str) -> DataFrame:
        each = df.select(*ids, F.size(words).alias("_size"), F.explode(words).alias("_w")).join(counts, "_w", "left")
        rank = F.row_number().over(Window.partitionBy(*ids).orderBy(F.coalesce("_c", F.lit(0)), "_w"))
        return each.withColumn("_r", rank).filter(F.col("_r") <= F.col("_size") - F.ceil(F.col("_size") * 0.75) + 1).select(*ids, "_w", F.col("_size"))

    left = prefix(rest.filter(F.size("_a") > 0), ["_n"], "_a").withColumnRenamed("_size", "_sa")
    right = prefix(known, ["record_id"], "_b").withColumnRenamed("_size", "_sb")
    pairs = left.join(right, "_w").filter((F.col("_sb") >= 0.75 * F.col("_sa")) & (F.col("_sa") >= 0.75 * F.col("_sb"))).select("_n", "record_id").distinct()
    judged = pairs.join(rest, "_n").join(known.select("record_id", "seq", "_b"), "record_id").filter(F.size(F.array_intersect("_a", "_b")) / F.size(F.array_union("_a", "_b")) > 0.75)
    similar = judged.groupBy(F.col("_n").alias("_m")).agg(F.min_by("record_id", "seq").alias("_similar"))
    out = first.join(similar, F.col("_n") == F.col("_m"), "left")
    return out.select(key, "claim", F.coalesce("_exact", "_similar").alias("record_id"), F.when(F.col("_exact").isNotNull(), "exact").when(F.col("_similar").isNotNull(), "similar").alias("match"))


def route(claim_type: Column, status: Column) -> Column:
    """A stored claim that is verified or conditional first, then by type."""
    return F.when(status.isin("verified", "conditional"), "vks_hit").when(claim_type == "formal", "z3").when(claim_type == "factual", "corpus").otherwise("soft_pass")


#: Records that go to all executors at once; a larger store is searched block by block.
STORE_BLOCK = 100_000


def lemma_candidates(claims: DataFrame, key: str, store: DataFrame, top: int = 5, block: int = STORE_BLOCK) -> DataFrame:
    """(key, rank, record_id, shared): verified or conditional records that share two words with a claim, by tier, shared words and id.

    Claims meet the inverted word lists of a block of records at a time, in memory, and give their best `top` of it:
    a word that stands in very many claims and records makes no rows.
    """
    usable = store.filter(F.col("status").isin("verified", "conditional")).select("record_id", "tier", "claim_text")
    blocks = max(1, -(-usable.count() // block))
    schema = T.StructType([claims.schema[key], T.StructField("tier", T.IntegerType()), store.schema["record_id"], T.StructField("shared", T.LongType())])
    parts = []
    for k in range(blocks):
        rows = sorted(usable.filter(F.pmod(F.xxhash64("record_id"), F.lit(blocks)) == k).collect(), key=lambda r: r.record_id)
        lists: dict[str, list[int]] = {}
        for i, r in enumerate(rows):
            for w in set((r.claim_text or "").lower().split()):
                lists.setdefault(w, []).append(i)
        sent = claims.sparkSession.sparkContext.broadcast(({w: np.array(v) for w, v in lists.items()}, np.array([r.tier for r in rows], dtype=np.int64), [r.record_id for r in rows]))

        def run(batches, sent=sent):
            held, tiers, ids = sent.value
            for b in batches:
                out, known = [], {}
                for i, text in zip(b[key].tolist(), b["claim"].tolist()):
                    if text is not None and text not in known:
                        found = [held[w] for w in set(text.lower().split()) if w in held]
                        at, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, int), np.zeros(0, int))
                        at, n = at[n >= 2], n[n >= 2]
                        known[text] = [(int(tiers[at[j]]), ids[at[j]], int(n[j])) for j in np.lexsort((at, -n, tiers[at]))[:top]]
                    out += [(i, *x) for x in known.get(text, ())]
                yield pd.DataFrame(out, columns=schema.names)

        parts.append(claims.select(key, "claim").mapInPandas(run, schema))
    rank = F.row_number().over(Window.partitionBy(key).orderBy("tier", F.desc("shared"), "record_id"))
    return reduce(DataFrame.union, parts).withColumn("rank", rank).filter(F.col("rank") <= top).select(key, F.col("rank").cast("bigint").alias("rank"), "record_id", "shared")


def store_stats(store: DataFrame) -> DataFrame:
    """(kind, value, n): records per tier and per status, zeros included."""
    spark = store.sparkSession
    dims = spark.createDataFrame([("tier", str(t)) for t in TIERS] + [("status", x) for x in STATUSES], "kind string, value string")
    have = store.select(F.explode(F.array(F.struct(F.lit("tier").alias("kind"), F.col("tier").cast("string").alias("value")), F.struct(F.lit("status").alias("kind"), F.col("status").alias("value")))).alias("x")).groupBy("x.kind", "x.value").agg(F.count("*").alias("n"))
    return have.join(F.broadcast(dims), ["kind", "value"], "right").select("kind", "value", F.coalesce("n", F.lit(0)).alias("n"))


def hash_chain(records: DataFrame, order: list[str], own: str, chain: str | None = None) -> DataFrame:
    """(chain, n, own, chained): sha256(previous|own)[:16] along the order, within each chain.

    A chain is sequential by nature: its sorted rows pass through one task, batch by batch, of which only the last hash
    is kept; different chains run in parallel. A null `own` gives a null hash, after which the chain starts anew.
    """
    rows = records.select((F.col(chain) if chain else F.lit(0)).alias("chain"), *order, F.col(own).alias("own"))
    schema = T.StructType([rows.schema["chain"], T.StructField("n", T.LongType()), T.StructField("own", T.StringType()), T.StructField("chained", T.StringType())])

    def fold(batches):
        at, n, last = object(), 0, ""
        for b in batches:
            out = []
            for c, value in zip(b["chain"].tolist(), b["own"].tolist()):
                if c != at:
                    at, n, last = c, 0, ""
                n += 1
                hashed = None if value is None else hashlib.sha256(f"{last}|{value}".encode()).hexdigest()[:16]
                out.append((c, n, value, hashed))
                last = hashed or ""
            yield pd.DataFrame(out, columns=schema.names)

    return rows.repartition("chain").sortWithinPartitions("chain", *order, "own").mapInPandas(fold, schema)


def chain_integrity(stored: DataFrame, computed: DataFrame) -> DataFrame:
    """One row: lengths equal, first position that differs (null if none), and whether the chain is whole."""
    both = stored.select("n", F.col("chained").alias("a")).join(computed.select("n", F.col("chained").alias("b")), "n", "full")
    bad = F.min(F.when(~F.col("a").eqNullSafe(F.col("b")), F.col("n")))
    return both.agg(F.count("a").alias("n_stored"), F.count("b").alias("n_computed"), bad.alias("first_bad")).withColumn("intact", F.col("first_bad").isNull())


def dependency_edges(records: DataFrame) -> DataFrame:
    """(record_id, used_by): an edge for each dependency that was stored before the record."""
    deps = records.select(F.col("record_id").alias("used_by"), F.col("seq").alias("_later"), F.explode("depends_on").alias("record_id"))
    return deps.join(records.select("record_id", "seq"), "record_id").filter("seq < _later").select("record_id", "used_by")


def invalidate(edges: DataFrame, start: DataFrame) -> DataFrame:
    """record_ids reached from `start` over used_by edges, the start included; cycles end, as nothing is visited twice."""
    seen = materialize(start.select("record_id").distinct(), "reach")
    front = seen
    while True:
        new = front.join(edges, "record_id").select(F.col("used_by").alias("record_id")).distinct().join(seen, "record_id", "left_anti")
        front = materialize(new, "reach")
        if front.isEmpty():
            return seen
        seen = materialize(seen.union(front), "reach")


def invalidation(records: DataFrame, edges: DataFrame, start: DataFrame) -> DataFrame:
    """Records with their new status; nothing changes if an axiom (tier 1) depends on what is invalidated."""
    hit = invalidate(edges, start).withColumn("_hit", F.lit(True))
    marked = records.join(hit, "record_id", "left")
    blocked = marked.filter("_hit and tier = 1").limit(1).count() > 0
    return records if blocked else marked.withColumn("status", F.when(F.col("_hit"), "refuted").otherwise(F.col("status"))).drop("_hit")


def axioms(store: DataFrame) -> DataFrame:
    """Verified records of tier 1."""
    return store.filter("tier = 1 and status = 'verified'")


#: Seed records (id, claim, status, tier, premises).
SEEDS = [
    ("axiom_cogito_strict_inference", "The Cogito is a valid strict inference: Doubts(ego) -> Thinks(ego) -> Exists(ego). No model exists where the ego doubts but does not exist.", "verified", 1, []),
    ("axiom_real_distinction_s5", "The Real Distinction argument is valid in S5: if mind without body is conceivable (accessible world exists), then mind and body are not identical.", "verified", 1, []),
    ("axiom_cartesian_circle_structure", "The Cartesian Circle exhibits circular justification: CDP -> God's existence -> CDP reliability -> CDP. Under transitivity, CDP justifies itself.", "verified", 1, ["justification_transitivity"]),
    ("contested_ontological_argument", "Descartes' ontological argument is deductively valid IF existence is accepted as a real predicate/perfection.", "conditional", 4, ["god_defined_as_all_perfections", "existence_is_a_perfection"]),
]


def seeded_store(spark) -> DataFrame:
    """(seq, record_id, claim_text, status, tier, premises, own): the seed records in their order; axioms are chained by `hash_chain`."""
    rows = [(i, *r) for i, r in enumerate(SEEDS, 1)]
    table = spark.createDataFrame(rows, "seq int, record_id string, claim_text string, status string, tier int, premises array<string>")
    return table.withColumn("own", S.proof_hash(F.col("claim_text"), F.lit(""), F.col("status")))
