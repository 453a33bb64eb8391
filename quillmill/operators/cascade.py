"""Verification with injected models and solvers: attempts are columns, verdicts come from Arrow-batched callables."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmill.functions import scalars as S
from quillmill.functions import text as X
from quillmill.operators import claims as K
from quillmill.session import materialize

#: A callable over a batch of texts: a model client, a solver or a deterministic stub.
Batch = Callable[[list[str]], list[str]]


def call(fn: Batch, *columns: Column) -> Column:
    """fn over the texts of the columns joined by a line of dashes; not called for null rows."""

    @F.pandas_udf(T.StringType())
    def run(*parts: pd.Series) -> pd.Series:
        joined = [None if any(x is None for x in row) else "\n---\n".join(row) for row in zip(*parts)]
        asked = [x for x in joined if x is not None]
        answers = iter(fn(asked) if asked else [])
        return pd.Series([None if x is None else next(answers) for x in joined], dtype=object)

    return run.asNondeterministic()(*columns)


def generate_verify(queries: DataFrame, generate: Batch, verify: Batch, attempts: int = 3) -> DataFrame:
    """(query_id, query, answer, status, attempt): generate and verify until verified, at most `attempts` times.

    Each round handles the rows still open, with the last verdict as feedback; finished rows are kept.
    """
    open_, done = queries.select("query_id", "query", F.lit("").alias("feedback")), None
    for k in range(1, attempts + 1):
        tried = open_.withColumn("answer", call(generate, F.col("query"), F.col("feedback"))).withColumn("verdict", call(verify, F.col("answer")))
        tried = materialize(tried.withColumn("status", S.verdict_status(F.col("verdict"))).withColumn("attempt", F.lit(k)), "attempt")
        out = tried.select("query_id", "query", "answer", "status", "attempt")
        final = out if k == attempts else out.filter("status = 'verified'")
        done = final if done is None else done.unionByName(final)
        open_ = tried.filter("status <> 'verified' or status is null").select("query_id", "query", F.coalesce("verdict", F.lit("")).alias("feedback"))
    return done


def repair(claims: DataFrame, rewrite: Batch, verify: Batch, attempts: int = 2) -> DataFrame:
    """Refuted, unclear or timed-out claims rewritten by strategy and verified again, with strategy and attempt."""
    done = claims.filter("status = 'verified'").select("claim_id", "claim", "status", F.lit(0).alias("attempt"), F.lit(None).cast("string").alias("strategy"))
    open_ = claims.filter("status <> 'verified'").select("claim_id", "claim", "status")
    for k in range(attempts):
        planned = open_.withColumn("strategy", S.repair_strategy(F.coalesce(F.lit(None).cast("string"), F.lit("")), F.col("status"), F.lit(k)))
        tried = planned.withColumn("claim", call(rewrite, F.col("strategy"), F.col("claim"))).withColumn("status", S.verdict_status(call(verify, F.col("claim"))))
        tried = materialize(tried.withColumn("attempt", F.lit(k + 1)).select("claim_id", "claim", "status", "attempt", "strategy"), "repair")
        done = done.unionByName(tried if k + 1 == attempts else tried.filter("status = 'verified'"))
        open_ = tried.filter("status <> 'verified'").select("claim_id", "claim", "status")
    return done


def repair_stats(repaired: DataFrame) -> DataFrame:
    """One row: claims repaired at all, those verified then, and those that failed."""
    tried = F.col("attempt") > 0
    return repaired.agg(F.count_if(tried).alias("attempted"), F.count_if(tried & (F.col("status") == "verified")).alias("succeeded"), F.count_if(tried & ~F.coalesce(F.col("status") == "verified", F.lit(False))).alias("failed"))


def final_route(confidence: Column, requested: Column, low: float = 0.4, high: float = 0.85) -> Column:
    """SELF, HYBRID or ORACLE by confidence; a request in the text lifts SELF to HYBRID."""
    base = F.when(confidence >= high, "SELF").when(confidence < low, "ORACLE").otherwise("HYBRID")
    return F.when((base == "SELF") & requested.isNotNull(), "HYBRID").otherwise(base)


def counters(results: DataFrame) -> DataFrame:
    """Per response: claims by method and how many are verified."""
    n = lambda m: F.count_if(F.col("method") == m).alias(f"n_{m}")
    return results.groupBy("response_id").agg(F.count("*").alias("n_claims"), F.count_if(F.col("verified")).alias("n_verified"), n("vks_cache"), n("z3"), n("corpus"), n("oracle"), n("soft_pass"))


# ---- whole queries and verifiers ----------------------------------------------------------------

#: Requests that join a draft and what the oracle said, by route.
INTEGRATE = {
    "HYBRID": "Join the analysis and the knowledge into one answer.\nQuestion: %s\nAnalysis: %s\nKnowledge: %s",
    "ORACLE": "Answer again with the knowledge that was missing.\nQuestion: %s\nAnswer: %s\nKnowledge: %s",
}


def answer_queries(queries: DataFrame, generate: Batch, judge: Callable[[DataFrame], dict[str, Column]], consult: Batch) -> DataFrame:
    """(query_id, query, initial, route, oracle_query, oracle_response, final, confidence, passes): the whole cascade.

    A draft is made for every query; `judge` gives columns confidence and error (0-4) over the drafts (query, response,
    initial). Drafts the learner trusts are final. The others go to the oracle, with the question the draft asks for or
    one made from the error, and then through a second pass that joins both; a confidence stated there counts. Each
    pass is written once, so that a model is not asked twice for a row. Null queries stay without answer.
    """
    drafts = queries.select("query_id", "query").withColumn("response", call(generate, F.col("query")))
    drafts = materialize(drafts.withColumn("initial", X.drop_tags(F.col("response"))).withColumn("_asked", X.parse_request(F.col("response"))), "drafts")
    marks = judge(drafts)
    judged = drafts.withColumn("confidence", marks["confidence"]).withColumn("_error", marks["error"])
    judged = judged.withColumn("route", final_route(F.col("confidence"), F.col("_asked")))
    question = F.coalesce(F.col("_asked"), X.code_prompt(F.col("_error"), F.col("query"), F.col("initial")))
    asked = judged.withColumn("oracle_query", F.when(F.col("route") != "SELF", question))
    message = F.when(F.col("oracle_query").isNotNull(), X.oracle_message(F.col("oracle_query"), F.col("initial"), F.col("_error")))
    told = materialize(asked.withColumn("oracle_response", call(consult, message)), "consulted")
    joined = F.when(F.col("route") == "HYBRID", F.format_string(INTEGRATE["HYBRID"], "query", "initial", "oracle_response")).when(F.col("route") == "ORACLE", F.format_string(INTEGRATE["ORACLE"], "query", "initial", "oracle_response"))
    second = materialize(told.withColumn("_second", call(generate, F.when(F.col("oracle_response").isNotNull(), joined))), "second")
    stated = X.parse_confidence(F.col("_second"))
    return second.select("query_id", "query", "initial", "route", "oracle_query", "oracle_response", F.coalesce(X.drop_tags(F.col("_second")), F.col("initial")).alias("final"), F.coalesce(stated, "confidence").alias("confidence"), F.when(F.col("_second").isNotNull(), 2).otherwise(1).alias("passes"))


def cascade_feedback(answers: DataFrame) -> DataFrame:
    """(query_id, oracle, magnitude): whether draft and oracle agree (over 0.7) and by how much they differ, for consulted queries."""
    same = S.agreement(F.col("initial"), F.col("oracle_response"))
    return answers.filter("oracle_response is not null").select("query_id", (same > 0.7).alias("oracle"), (1 - same).alias("magnitude"))


def verify_formal(claims: DataFrame, store: DataFrame, encode: Batch, solve: Batch) -> tuple[DataFrame, DataFrame]:
    """Verdicts (claim_id, claim, code, status, tier, stored) and the records to append to the store.

    Lemmas of the store (up to five) are given to `encode` with the claim; a record depends on those whose id its code
    names. Verified and refuted claims are stored.
    """
    lemmas = K.lemma_candidates(claims, "claim_id", store).join(store.select("record_id", "claim_text", "status"), "record_id")
    listed = lemmas.groupBy("claim_id").agg(F.array_sort(F.collect_list(F.struct("rank", "record_id", F.concat(F.col("claim_text"), F.lit(" ["), F.col("status"), F.lit("]")).alias("line")))).alias("_l"))
    given = claims.select("claim_id", "claim").join(listed, "claim_id", "left")
    context = F.coalesce(F.array_join("_l.line", "\n"), F.lit(""))
    coded = materialize(given.withColumn("code", X.strip_fences(call(encode, F.col("claim"), context))), "coded")
    judged = coded.withColumn("status", F.coalesce(S.verdict_status(call(solve, F.col("code"))), F.lit("not_formalizable"))).withColumn("tier", S.claim_tier(F.col("claim")))
    judged = materialize(judged.withColumn("stored", F.col("status").isin("verified", "refuted")), "judged")
    used = F.coalesce(F.filter("_l.record_id", lambda x: F.col("code").contains(x.cast("string"))), F.array().cast("array<string>"))
    records = judged.filter("stored").select(S.claim_id(F.col("claim")).alias("record_id"), F.col("claim").alias("claim_text"), "status", "tier", used.cast("array<string>").alias("depends_on"), S.proof_hash(F.col("claim"), F.col("code"), F.col("status")).alias("hash"))
    return judged.select("claim_id", "claim", "code", "status", "tier", "stored"), records


def verify_factual(claims: DataFrame, best: DataFrame) -> DataFrame:
    """(claim_id, claim, status, artifact, stored): verified by the best match of the corpus (claim_id, source, passage), else not formalizable."""
    found = claims.join(best.select(F.col("claim_id").alias("_c"), F.concat_ws(":", F.lit("corpus"), F.col("source").cast("string"), F.coalesce(F.col("passage").cast("string"), F.lit("unknown"))).alias("artifact")), F.col("claim_id") == F.col("_c"), "left")
    hit = F.col("_c").isNotNull()
    return found.select("claim_id", "claim", F.when(hit, "verified").otherwise("not_formalizable").alias("status"), F.coalesce("artifact", F.lit("no_corpus_match")).alias("artifact"), hit.alias("stored"))


def portfolio(first: Column, second: Column) -> Column:
    """The definitive answer of two solvers, the first one's where both have one; `second` null: not asked."""
    sure = lambda c: F.when(c.isin("sat", "unsat"), c)
    return F.when(second.isNull(), first).otherwise(F.coalesce(sure(first), sure(second), F.lit("timeout")))


def joined_subclaims(parts: DataFrame) -> DataFrame:
    """(claim_id, claim, status): sub-claims (claim_id, at, claim, status) joined by AND, verified if all of them are."""
    per = parts.groupBy("claim_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("at", "claim")))["claim"], " AND ").alias("claim"), F.min(F.coalesce(F.col("status") == "verified", F.lit(False))).alias("_all"))
    return per.select("claim_id", "claim", F.when(F.col("_all"), "verified").otherwise("timeout").alias("status"))


def unsat_core(output: Column, status: Column) -> Column:
    """Labels after "core:" in a solver's output; empty unless it is unsat."""
    listed = F.regexp_extract(output, r"core:\s*\[([^\]]*)\]", 1)
    return F.when(status == "unsat", F.filter(F.split(listed, r"\s*,\s*"), lambda x: x != "")).otherwise(F.array().cast("array<string>"))
