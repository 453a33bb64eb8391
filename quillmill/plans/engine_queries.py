"""Queries over claims, signals, feedback, training sets, manifest, vectors, logic and streams, with oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmill.functions import lexicon as L
from quillmill.functions import scalars as S
from quillmill.functions import text as X
from quillmill.operators import claims as K
from quillmill.operators import feedback as B
from quillmill.operators import logic as G
from quillmill.operators import manifest as M
from quillmill.operators import sft as T
from quillmill.plans.corpus_queries import SQL_STRIP, SQL_WORDS, WS, md5, sql_list
from quillmill.session import load
from quillmill.sources import files as FS
from quillmill.streaming import streams as ST


def sft(s, d):
    return load(s, d, "sft_examples")


def _responses(s, d):
    return sft(s, d).select("row_id", "assistant_response")


# ---- claims and store ---------------------------------------------------------------------------


def claims(s, d):
    rows = K.extract_claims(_responses(s, d), "row_id", "assistant_response")
    return rows.select("row_id", md5(F.col("claim")).alias("claim_md5"), "claim_type", F.round("confidence", 6).alias("confidence"), "start", "end")


def claim_type_counts(s, d):
    return K.extract_claims(_responses(s, d), "row_id", "assistant_response").groupBy("claim_type").agg(F.count("*").alias("n"))


def _store(s, d):
    """Stored records: the evaluation questions as claims with tier and status by rule."""
    status = F.when(F.col("item_id") % 5 == 0, "refuted").when(F.col("item_id") % 7 == 0, "timeout").when(F.col("item_id") % 3 == 0, "conditional").otherwise("verified")
    return load(s, d, "eval_items").select(F.col("item_id").alias("record_id"), F.col("item_id").alias("seq"), F.col("q").alias("claim_text"), (F.col("item_id") % 4 + 1).cast("int").alias("tier"), status.alias("status"))


def _asked(s, d):
    """Claims to look up: the questions again, every second one with its first word lost."""
    q = F.when(F.col("item_id") % 2 == 0, F.concat(F.lit(" "), F.upper("q"))).otherwise(F.regexp_replace("q", r"^\S+\s+", ""))
    return load(s, d, "eval_items").select(F.col("item_id").alias("query_id"), q.alias("claim"))


def store_lookup(s, d):
    return K.store_lookup(_asked(s, d), "query_id", _store(s, d)).select("query_id", "record_id", "match")


def claim_routes(s, d):
    found = K.store_lookup(_asked(s, d), "query_id", _store(s, d)).withColumn("claim_type", S.claim_type(F.col("claim")))
    status = _store(s, d).select("record_id", "status")
    return found.join(status, "record_id", "left").select("query_id", K.route(F.col("claim_type"), F.col("status")).alias("bucket"))


def lemma_candidates(s, d):
    return K.lemma_candidates(_asked(s, d), "query_id", _store(s, d))


def store_stats(s, d):
    return K.store_stats(_store(s, d))


def proof_hash(s, d):
    return _store(s, d).select("record_id", S.proof_hash(F.col("claim_text"), F.lit(None).cast("string"), F.col("status")).alias("hash"), S.claim_id(F.col("claim_text")).alias("claim_id"), S.claim_tier(F.col("claim_text")).alias("tier"))


def hash_chain(s, d):
    own = _store(s, d).filter("tier = 1").withColumn("own", S.proof_hash(F.col("claim_text"), F.lit(""), F.col("status")))
    return K.hash_chain(own, ["seq"], "own").select("n", "own", "chained")


def chain_integrity(s, d):
    whole = hash_chain(s, d)
    return K.chain_integrity(whole.withColumn("chained", F.when(F.col("n") == 17, "broken").otherwise(F.col("chained"))), whole)


def _records(s, d):
    i = F.col("record_id")
    return _store(s, d).withColumn("depends_on", F.array((i / 2).cast("bigint"), (i / 3).cast("bigint"), i + 1))


def dependency_edges(s, d):
    return K.dependency_edges(_records(s, d))


def invalidate_cascade(s, d):
    return K.invalidate(K.dependency_edges(_records(s, d)), s.range(5, 6).select(F.col("id").alias("record_id")))


def subclaims(s, d):
    return _responses(s, d).select("row_id", F.posexplode(K.subclaims(F.col("assistant_response"))).alias("n", "c")).select("row_id", F.col("n").cast("bigint").alias("n"), md5(F.col("c")).alias("claim_md5"))


# ---- signals ------------------------------------------------------------------------------------


def lite_signals(s, d):
    cols = S.lite_signals(F.col("assistant_response"), F.col("w"))
    rows = _responses(s, d).filter("assistant_response is not null").withColumn("w", X.lower_words(F.col("assistant_response"))).select("row_id", *[c.alias(n) for n, c in cols.items()])
    return rows.select("row_id", *[F.round(F.col(n).cast("double"), 6).alias(n) for n in cols])


def full_signals(s, d):
    cols = S.full_signals(F.col("assistant_response"), F.col("user_prompt"), F.col("w"))
    return sft(s, d).filter("assistant_response is not null").withColumn("w", X.lower_words(F.col("assistant_response"))).select("row_id", *[F.round(c.cast("double"), 6).alias(n) for n, c in cols.items() if n in ("hedge_ratio", "ood_score", "question_complexity", "formal_ratio", "factual_ratio", "token_entropy")])


def agreement(s, d):
    a, b = F.col("assistant_response"), F.col("source_passage")
    rows = sft(s, d).filter(a.isNotNull() & b.isNotNull())
    return rows.select("row_id", F.round(S.agreement(a, b), 9).alias("agreement"), S.equivalent(a, b).alias("same"), F.round(S.agreement(a, b, L.BOOTSTRAP_STOP, None), 9).alias("bootstrap"))


def parsed_tags(s, d):
    t = F.col("assistant_response")
    return _responses(s, d).filter(t.contains("[CONFIDENCE") | t.contains("[ORACLE_REQUEST")).select("row_id", X.parse_confidence(t).alias("confidence"), X.parse_request(t).alias("request"), md5(X.drop_tags(t)).alias("text_md5"))


def usage_cost(s, d):
    prices = s.createDataFrame(L.PROVIDER_PRICES, "provider string, price_in double, price_out double")
    used = sft(s, d).agg(F.sum(X.token_estimate(F.col("user_prompt"))).alias("tokens_in"), F.sum(X.token_estimate(F.col("assistant_response"))).alias("tokens_out"), F.count("*").alias("calls"))
    every = prices.withColumn("u", F.lit(0)).join(F.broadcast(used.withColumn("u", F.lit(0))), "u")  # one row of totals
    cost = S.usage_cost(F.col("tokens_in"), F.col("tokens_out"), F.col("price_in"), F.col("price_out"))
    return every.select("provider", "calls", F.round(cost, 6).alias("cost"), F.round(cost / F.col("calls"), 9).alias("avg_cost"))


# ---- feedback and measures ----------------------------------------------------------------------


def _labelled(s, d):
    return B.labelled(B.outcomes(load(s, d, "events")))


def feedback_labels(s, d):
    return _labelled(s, d).select("seq", F.round("true_confidence", 9).alias("true_confidence"), "true_routing", "true_error")


def recency_weights(s, d):
    return B.recency_weights(_labelled(s, d), "seq").select("seq", F.round("weight", 9).alias("weight"))


def recency_sample(s, d):
    return B.recency_sample(_labelled(s, d).select("seq"), "seq").select("draw", "seq")


def buffer_tail(s, d):
    return B.buffer_tail(_labelled(s, d), "seq", 10_000).select("seq")


def recent_loss(s, d):
    return B.recent_loss(_labelled(s, d).withColumn("loss", F.abs(F.col("predicted_confidence") - F.col("true_confidence"))), "seq", "loss").select(F.round("mean_loss", 9).alias("mean_loss"))


def convergence(s, d):
    return B.convergence(_labelled(s, d), "seq").select("checkpoint", *[F.round(c, 9).alias(c) for c in ("calibration_error", "routing_accuracy", "avg_confidence")])


def convergence_trend(s, d):
    return B.trend(B.convergence(_labelled(s, d), "seq")).select(*[F.round(c, 9).alias(c) for c in ("calibration_gain", "routing_gain")])


def routing_accuracy(s, d):
    code = F.when(F.col("predicted_routing") == "SELF", 0).when(F.col("predicted_routing") == "ORACLE", 1).when(F.col("predicted_routing") == "HYBRID", 2)
    return B.accuracy(_labelled(s, d).withColumn("p", code), "true_routing", "p").withColumn("accuracy", F.round("accuracy", 9))


def calibration_bins(s, d):
    return B.calibration_bins(_labelled(s, d).filter("z3 is not null"), "predicted_confidence", "z3").withColumn("accuracy", F.round("accuracy", 9))


def calibration_error(s, d):
    return B.calibration_error(_labelled(s, d).filter("z3 is not null"), "predicted_confidence", "z3").withColumn("ece", F.round("ece", 9))


def _run(s, d):
    method = F.when(F.col("event_id") % 7 < 3, "vks_cache").when(F.col("event_id") % 7 < 5, "oracle").otherwise("z3")
    return load(s, d, "events").select(F.floor(F.col("event_id") / 1000).alias("epoch"), method.alias("method"), (F.col("event_id") % 3 == 0).alias("repaired"), F.col("value").alias("latency"))


def growth_by_epoch(s, d):
    return B.growth(_run(s, d), "epoch").select("epoch", "n", *[F.round(c, 6).alias(c) for c in ("hit_rate", "oracle_rate", "repair_rate", "mean_latency")])


def repair_savings(s, d):
    return B.repair_savings(_run(s, d)).withColumn("savings", F.round("savings", 9))


def engine_rates(s, d):
    return B.engine_rates(_labelled(s, d)).select("n", *[F.round(c, 9).alias(c) for c in ("self_rate", "oracle_rate", "hybrid_rate", "z3_accuracy")])


def criteria_gate(s, d):
    cal = B.calibration_error(_labelled(s, d).filter("z3 is not null"), "predicted_confidence", "z3").select(F.lit("ece").alias("metric"), F.round("ece", 9).alias("value"), F.lit(0.15).alias("threshold"), F.lit(True).alias("lower_is_better"))
    hit = _run(s, d).agg(F.round(F.count_if(F.col("method") == "vks_cache") / F.count("*"), 9).alias("value")).select(F.lit("hit_rate").alias("metric"), "value", F.lit(0.4).alias("threshold"), F.lit(False).alias("lower_is_better"))
    return B.gate(cal.unionByName(hit))


def perplexity(s, d):
    rows = sft(s, d).filter("council_agreement is not null").select("example_type", F.col("council_agreement").alias("loss"), X.token_estimate(F.col("assistant_response")).alias("tokens"))
    return B.perplexity(rows, ["example_type"]).withColumn("perplexity", F.round("perplexity", 6))


def nudged_latest(s, d):
    return B.nudge_latest(_labelled(s, d), "seq", F.lit("solver_fail")).filter(F.col("true_error") == 3).agg(F.count("*").alias("n_formal"), F.round(F.sum(F.round("true_confidence", 6)), 4).alias("total"))


# ---- training sets ------------------------------------------------------------------------------


def chat_format(s, d):
    return T.chat_format(sft(s, d)).select("row_id", md5(F.col("chat")).alias("chat_md5"))


def review_merge(s, d):
    rows = sft(s, d)
    reviewed = rows.filter("human_reviewed")
    return T.review_merge(rows, reviewed).select("row_id", "review_status", md5(F.coalesce("assistant_response", F.lit(""))).alias("response_md5"))


def sft_counts(s, d):
    return sft(s, d).groupBy("example_type", T.status_key(F.col("review_status")).alias("status")).agg(F.count("*").alias("n"), F.countDistinct("philosopher").alias("n_philosophers"))


def pending_reviews(s, d):
    return T.pending(sft(s, d)).groupBy("example_type").agg(F.count("*").alias("n"))


def council(s, d):
    return T.council(sft(s, d), "id").select("id", "row_id", "n", F.round("agreement", 9).alias("agreement"))


def generated_examples(s, d):
    return T.generate(T.first_passages(sft(s, d)), ("A", "B", "C", "D")).select("philosopher", F.col("rank").cast("bigint").alias("rank"), "type", md5(F.col("prompt")).alias("prompt_md5"))


def answer_checks(s, d):
    r = F.col("assistant_response")
    return _responses(s, d).filter(r.isNotNull()).select("row_id", S.choice_letter(r).alias("choice"), S.defers(r).alias("defers"), S.says_valid(r).alias("valid"), S.says_valid(r, True).alias("valid_first_line"), S.knowledge_hit(r, F.array(F.lit("modus"), F.lit("stimulus"))).alias("knows"), S.scheme_hit(r, F.lit("argument_from_sign")).alias("scheme"), F.round(S.coverage(r, F.array(F.lit("OBJECTION"), F.lit("DEFENCE"), F.lit("Form"))), 6).alias("coverage"))


# ---- manifest -----------------------------------------------------------------------------------


def entries(s, d):
    return load(s, d, "manifest_entries")


def manifest_summary(s, d):
    return M.summary(entries(s, d)).withColumn("megabytes", F.round("megabytes", 6))


def latest_downloads(s, d):
    return M.latest(entries(s, d))


def pending_downloads(s, d):
    return M.pending(load(s, d, "documents").select("doc_id", "url"), entries(s, d).filter("duplicate_of is null"))


def title_matches(s, d):
    """Titles against a library's names, which have the author behind the title."""
    keyed = lambda c: entries(s, d).groupBy(S.title_key(c).alias("key")).agg(F.min("entry_id").alias("id")).filter("key is not null")
    return M.title_matches(keyed(F.col("title")), keyed(F.concat("title", F.lit(" "), "author")))


def cross_source_duplicates(s, d):
    return M.cross_source_duplicates(entries(s, d))


def file_names(s, d):
    t, f = F.col("title"), F.col("filename")
    return entries(s, d).select("entry_id", S.safe_filename(t).alias("safe"), S.book_filename(t, 24).alias("book"), S.title_key(t).alias("key"), S.path_category(f).alias("folder"), S.file_category(t).alias("category"), M.file_key(f).alias("file_key"), S.title_relevant(t, F.col("author")).alias("relevant"))


#: Paths over several folders, for entries whose titles name works, too.
SQL_PATH = "concat('raw/', CASE entry_id % 6 WHEN 0 THEN 'formal_logic' WHEN 1 THEN 'SEP' WHEN 2 THEN 'arxiv' WHEN 3 THEN 'neuroscience' WHEN 4 THEN 'other' ELSE 'descartes_primary/meditations' END, '/', CASE entry_id % 7 WHEN 0 THEN 'Meditation_II_' WHEN 1 THEN 'Passions-first-' ELSE '' END, replace(lower(title), ' ', '_'), '.txt')"


def source_citations(s, d):
    path = F.expr(SQL_PATH)
    return entries(s, d).select("entry_id", S.source_citation(path).alias("citation"), S.index_category(path).alias("category"))


# ---- vectors and logic --------------------------------------------------------------------------


def vector_norms(s, d):
    e = F.col("embedding")
    ones = F.transform(e, lambda x: F.lit(0.125))
    return load(s, d, "embeddings").select("vec_id", F.round(S.norm(e), 6).alias("norm"), F.round(S.distance(e, ones), 6).alias("distance"), F.round(S.cosine(e, ones), 6).alias("cosine"))


def knn(s, d):
    rows = load(s, d, "embeddings")
    queries = rows.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return G.nearest(queries, rows, 10).select("query_id", F.col("rank").cast("bigint").alias("rank"), "vec_id", F.round("distance", 5).alias("distance"))


def theory_distances(s, d):
    return G.theory_pairs(G.theory_table(s)).select("a", "b", F.round("distance", 9).alias("distance"), F.round("cosine", 9).alias("cosine"))


def separating_dimensions(s, d):
    t = G.theory_table(s)
    base = t.filter("name = 'SD'").select(F.col("v").alias("u"), F.lit(0).alias("k"))
    rows = t.filter("name <> 'SD'").withColumn("k", F.lit(0)).join(F.broadcast(base), "k").drop("k")
    return G.separating_dimensions(rows, L.DIMENSIONS).select("name", F.array_join("dimensions", ",").alias("dimensions"))


def belnap_ops(s, d):
    a, b = F.col("a"), F.col("b")
    pairs = s.range(16).select((F.col("id") / 4).cast("int").alias("a"), (F.col("id") % 4).cast("int").alias("b"))
    return pairs.select("a", "b", S.belnap_and(a, b).alias("conj"), S.belnap_or(a, b).alias("disj"), S.belnap_not(a).alias("neg"), S.belnap_and_lattice(a, b).alias("meet"))


ARGS = [("a", True), ("b", False), ("c", False), ("x", False), ("m", False), ("n", False), ("y", False)]
ATTACKS = [("a", "b"), ("b", "c"), ("a", "x"), ("m", "x"), ("m", "n"), ("n", "m"), ("x", "y")]
PREFERS = [("c", "b"), ("m", "x")]


def _graph(s):
    return s.createDataFrame(ARGS, "arg_id string, is_strict boolean"), s.createDataFrame(ATTACKS, "attacker string, target string"), s.createDataFrame(PREFERS, "preferred string, over string")


def defeated_arguments(s, d):
    return G.defeated(*_graph(s))


def grounded_extension(s, d):
    a, t, _ = _graph(s)
    return G.grounded(a, t)


def aif_edges(s, d):
    a, t, _ = _graph(s)
    return G.aif(a, t)[1]


def _frame(s, d):
    nations = load(s, d, "nation")
    return nations.select(F.col("n_nationkey").alias("w")), nations.select(F.col("n_nationkey").alias("u"), ((F.col("n_nationkey") * 2 + 1) % 25).cast("int").alias("v")), nations.filter("n_regionkey <> 1").select(F.col("n_nationkey").alias("w"))


def frame_closure(s, d):
    w, r, _ = _frame(s, d)
    return G.frame_closure(w, r, "S4")


def modal_box_diamond(s, d):
    w, r, p = _frame(s, d)
    return G.box_diamond(w, G.frame_closure(w, r, "T"), p)


def max_consistent_subsets(s, d):
    found = G.consistent_subsets(s.createDataFrame([("p", "q")], "a string, b string"), ["p", "q", "r"])
    return s.createDataFrame([(i, ",".join(x)) for i, x in enumerate(found)], "n int, labels string")


# ---- pages and streams --------------------------------------------------------------------------


def html_to_text(s, d):
    page = F.concat(F.lit("<html><head><title>t</title><script>x()</script></head><body><nav>menu</nav><h1>"), "source", F.lit("</h1><p>"), F.replace(F.replace(F.regexp_replace("text", r"[<>&]", " "), F.lit("\r"), F.lit("")), F.lit("\n\n"), F.lit("</p><p>")), F.lit("</p><footer>end</footer></body></html>"))
    return load(s, d, "documents").select("doc_id", FS.html_to_text(page).alias("t")).select("doc_id", F.length("t").cast("bigint").alias("n"), md5(F.col("t")).alias("text_md5"))


def stream_tumbling(s, d):
    return ST.run_available(ST.windowed(ST.event_stream(s, f"{d}/events.parquet"), "1 hour"), "complete", "tumbling")


def stream_sliding(s, d):
    return ST.run_available(ST.windowed(ST.event_stream(s, f"{d}/events.parquet"), "2 hours", "1 hour"), "complete", "sliding")


def stream_sessions(s, d):
    return ST.run_available(ST.sessions(ST.event_stream(s, f"{d}/events.parquet")), "complete", "sessions")


def stream_feedback(s, d):
    rows = ST.feedback(ST.event_stream(s, f"{d}/events.parquet")).select("seq", F.round("true_confidence", 9).alias("true_confidence"), "true_routing", "true_error")
    return ST.run_available(rows, "append", "feedback")


def stream_triggers(s, d):
    return ST.run_available(ST.triggers(ST.event_stream(s, f"{d}/events.parquet")), "update", "triggers").groupBy("user_id").agg(F.max("n_rows").alias("n_rows"), F.max("n_triggers").alias("n_triggers"))


QUERIES = {f.__name__: f for f in (claims, claim_type_counts, store_lookup, claim_routes, lemma_candidates, store_stats, proof_hash, hash_chain, chain_integrity, dependency_edges, invalidate_cascade, subclaims, lite_signals, full_signals, agreement, parsed_tags, usage_cost, feedback_labels, recency_weights, recency_sample, buffer_tail, recent_loss, convergence, convergence_trend, routing_accuracy, calibration_bins, calibration_error, growth_by_epoch, repair_savings, engine_rates, criteria_gate, perplexity, nudged_latest, chat_format, review_merge, sft_counts, pending_reviews, council, generated_examples, answer_checks, manifest_summary, latest_downloads, pending_downloads, title_matches, cross_source_duplicates, file_names, source_citations, vector_norms, knn, theory_distances, separating_dimensions, belnap_ops, defeated_arguments, grounded_extension, aif_edges, frame_closure, modal_box_diamond, max_consistent_subsets, html_to_text, stream_tumbling, stream_sliding, stream_sessions, stream_feedback, stream_triggers)}

# ---- oracle -------------------------------------------------------------------------------------

_Q = lambda x: "'" + x.replace("'", "''") + "'"
_HITS = lambda col, pats: " + ".join(f"regexp_matches({col}, {_Q(p)})::INT" for p in pats)
_PRESENT = lambda col, ps: " + ".join(f"contains({col}, {_Q(p)})::INT" for p in ps)
# sentences: a sentinel after . ! ? and before the capital that follows white space
_CLAIMS = f"""cut AS (SELECT row_id, string_split(regexp_replace(assistant_response, '([.!?])[{WS}]+([A-Z])', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS l FROM sft_examples),
parts AS (SELECT row_id, unnest(l) AS s, generate_subscripts(l, 1) AS k FROM cut),
placed AS (SELECT row_id, s, k, coalesce(sum(length(s) + 1) OVER (PARTITION BY row_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM parts WHERE length({SQL_STRIP % 's'}) > 0),
judged AS (SELECT row_id, s, start, {_HITS('lower(s)', L.FORMAL_PATTERNS)} AS f, {_HITS('s', L.FACTUAL_PATTERNS)} AS a, {_PRESENT('lower(s)', L.META_PHRASES)} AS m FROM placed WHERE length({SQL_STRIP % 's'}) >= 10),
typed AS (SELECT *, CASE WHEN f = 0 AND a = 0 AND m = 0 THEN 'interpretive' WHEN f >= a AND f >= m THEN 'formal' WHEN a >= m THEN 'factual' ELSE 'meta_philosophical' END AS claim_type FROM judged)"""
_STORE = "store AS (SELECT item_id AS record_id, q AS claim_text, (item_id % 4 + 1)::INT AS tier, CASE WHEN item_id % 5 = 0 THEN 'refuted' WHEN item_id % 7 = 0 THEN 'timeout' WHEN item_id % 3 = 0 THEN 'conditional' ELSE 'verified' END AS status FROM eval_items)"
_ASKED = "asked AS (SELECT item_id AS query_id, CASE WHEN item_id % 2 = 0 THEN ' ' || upper(q) ELSE regexp_replace(q, '^\\S+\\s+', '') END AS claim FROM eval_items)"
_NORM = lambda c: f"array_to_string({SQL_WORDS % f'lower({c})'}, ' ')"
_CONTENT = lambda c, stop: f"list_filter(list_distinct({SQL_WORDS % f'lower({c})'}), lambda z: NOT list_contains({sql_list(stop)}, z))"
_LOOKUP = f"""{_STORE}, {_ASKED},
a AS (SELECT query_id, {_NORM('claim')} AS n, {_CONTENT('claim', L.EQUIVALENCE_STOP)} AS w, claim FROM asked),
b AS (SELECT record_id, {_NORM('claim_text')} AS n, {_CONTENT('claim_text', L.EQUIVALENCE_STOP)} AS w FROM store),
ex AS (SELECT query_id, min(record_id) AS record_id FROM a JOIN b USING (n) GROUP BY 1),
si AS (SELECT query_id, min(record_id) AS record_id FROM a JOIN b ON len(list_intersect(a.w, b.w)) > 0.75 * len(list_distinct(list_concat(a.w, b.w))) GROUP BY 1),
found AS (SELECT query_id, claim, coalesce(ex.record_id, si.record_id) AS record_id, CASE WHEN ex.record_id IS NOT NULL THEN 'exact' WHEN si.record_id IS NOT NULL THEN 'similar' END AS match FROM a LEFT JOIN ex USING (query_id) LEFT JOIN si USING (query_id))"""
_CHAIN = f"""{_STORE},
own AS (SELECT row_number() OVER (ORDER BY record_id) AS n, substr(sha256(claim_text || '||' || status), 1, 16) AS own FROM store WHERE tier = 1),
chain(n, own, chained) AS (SELECT n, own, substr(sha256('|' || own), 1, 16) FROM own WHERE n = 1 UNION ALL SELECT o.n, o.own, substr(sha256(c.chained || '|' || o.own), 1, 16) FROM chain c JOIN own o ON o.n = c.n + 1)"""
_EDGES = "edges AS (SELECT dep AS record_id, item_id AS used_by FROM (SELECT item_id, unnest([item_id // 2, item_id // 3, item_id + 1]) AS dep FROM eval_items) WHERE dep >= 1 AND dep < item_id)"
_TOK = lambda c: f"coalesce(floor(len({SQL_WORDS % c}) * 1.3::DOUBLE), 0)::BIGINT"
_SENT = lambda c: f"list_filter(list_transform(string_split_regex({c}, '[.!?]+'), lambda z: {SQL_STRIP % 'z'}), lambda z: z <> '')"
_FB = """o AS (SELECT event_id AS seq, value, json_extract(props, '$.k')::INT AS k FROM events),
o2 AS (SELECT seq, CASE WHEN seq % 3 <> 0 THEN k % 2 = 0 END AS z3, CASE WHEN seq % 4 <> 1 THEN k % 5 <> 0 END AS oracle, CASE WHEN seq % 5 <> 2 THEN least(value / 20, 1.5) END AS magnitude, CASE WHEN seq % 2 <> 0 THEN k > 20 END AS accepted, least(k / 100.0::DOUBLE, 1.0) AS predicted_confidence, CASE WHEN k < 40 THEN 'SELF' WHEN k < 70 THEN 'ORACLE' WHEN k < 95 THEN 'HYBRID' ELSE '?' END AS predicted_routing FROM o),
o3 AS (SELECT *, CASE WHEN z3 IS NULL AND oracle IS NULL AND magnitude IS NULL AND accepted IS NULL THEN 0.5::DOUBLE ELSE
 (coalesce(3.0::DOUBLE * z3::INT, 0) + coalesce(2.0::DOUBLE * oracle::INT, 0) + coalesce(1.5::DOUBLE * (1 - least(magnitude, 1.0)), 0) + coalesce(0.5::DOUBLE * CASE WHEN accepted THEN 1.0::DOUBLE WHEN NOT accepted THEN 0.3::DOUBLE END, 0)) / ((z3 IS NOT NULL)::INT * 3.0::DOUBLE + (oracle IS NOT NULL)::INT * 2.0::DOUBLE + (magnitude IS NOT NULL)::INT * 1.5::DOUBLE + (accepted IS NOT NULL)::INT * 0.5::DOUBLE) END AS true_confidence FROM o2),
fb AS (SELECT *, CASE WHEN true_confidence >= 0.85 THEN 0 WHEN true_confidence < 0.4 THEN 1 ELSE 2 END AS true_routing,
 CASE WHEN z3 = false THEN 3 WHEN oracle = false THEN CASE WHEN coalesce(magnitude, 0.5) > 0.7 THEN 1 ELSE 2 END WHEN coalesce(magnitude, 0) > 0.8 THEN 4 ELSE 0 END AS true_error,
 CASE predicted_routing WHEN 'SELF' THEN 0 WHEN 'ORACLE' THEN 1 WHEN 'HYBRID' THEN 2 END AS code FROM o3)"""
_CONV = f"""{_FB}, num AS (SELECT *, row_number() OVER (ORDER BY seq) AS rn, count(*) OVER () AS n FROM fb),
points AS (SELECT DISTINCT c FROM (SELECT unnest([50, 100, 200, 500, 1000, n]) AS c, n FROM (SELECT count(*) AS n FROM fb)) WHERE c <= n),
conv AS (SELECT c AS checkpoint, sum(abs(predicted_confidence - true_confidence)) / count(*) AS ce, count(*) FILTER (code = true_routing) / greatest(count(code), 1) AS ra, sum(predicted_confidence) / count(*) AS ac FROM points JOIN num ON rn <= c GROUP BY 1)"""
_BINS = f"{_FB}, bins AS (SELECT least(floor(predicted_confidence * 5), 4)::BIGINT AS bin, count(*) AS n, avg(z3::INT) AS accuracy FROM fb WHERE z3 IS NOT NULL GROUP BY 1)"
_RUN = "run AS (SELECT event_id // 1000 AS epoch, CASE WHEN event_id % 7 < 3 THEN 'vks_cache' WHEN event_id % 7 < 5 THEN 'oracle' ELSE 'z3' END AS method, event_id % 3 = 0 AS repaired, value AS latency FROM events)"
_ANY = lambda c, ks: "(" + " OR ".join(f"contains({c}, {_Q(k)})" for k in ks) + ")"
_VALUES = lambda rows, cols: f"(VALUES {', '.join('(' + ', '.join(repr(x) if not isinstance(x, bool) else str(x).lower() for x in r) + ')' for r in rows)}) AS t({cols})"
_KEY = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(title), '[_\\-.]', ' ', 'g'), '\\([^)]*\\)', '', 'g'), '\\[[^\\]]*\\]', '', 'g'), '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g'))"
_THEORY = f"theory AS (SELECT * FROM (VALUES {', '.join(f'({i}, {n!r}, {v}::DOUBLE[])' for i, (n, v) in enumerate(L.THEORIES.items()))}) AS t(id, name, v))"
_FRAME = "r AS (SELECT n_nationkey AS u, ((n_nationkey * 2 + 1) % 25)::INT AS v FROM nation), w AS (SELECT n_nationkey AS w FROM nation)"
_HOUR = lambda hours: f"SELECT start, event_type, count(*) AS n, sum((value * 100)::BIGINT)::BIGINT AS total_cents FROM (SELECT *, date_trunc('hour', ts) - INTERVAL (i) HOUR AS start FROM events, generate_series(0, {hours - 1}) AS g(i)) GROUP BY 1, 2"
_CONF, _REQ = r"\[CONFIDENCE:\s*([0-9.]+)\]", r"\[ORACLE_REQUEST:([^\]]*)\]"
_UNTAGGED = f"regexp_replace(regexp_replace(t, '{_CONF}', '', 'g'), '{_REQ}', '', 'g')"
_BOOK = r"regexp_replace(regexp_replace(title, '^\[.*?\]\s*', ''), '[^\p{L}\p{N}_" + WS + r"\-.]', '', 'g')"
_CATEGORY = " ".join(f"WHEN {_ANY('lower(title)', ks)} THEN '{c}'" for c, ks in L.FILE_CATEGORIES.items())
ORACLE = {
    "claims": f"WITH {_CLAIMS} SELECT row_id, md5({SQL_STRIP % 's'}) AS claim_md5, claim_type, round(CASE claim_type WHEN 'formal' THEN least(0.5 + 0.15 * f, 0.99) WHEN 'factual' THEN least(0.5 + 0.2 * a, 0.99) ELSE 0.5 END::DOUBLE, 6) AS confidence, start, (start + length(s))::BIGINT AS \"end\" FROM typed",
    "claim_type_counts": f"WITH {_CLAIMS} SELECT claim_type, count(*) AS n FROM typed GROUP BY 1",
    "store_lookup": f"WITH {_LOOKUP} SELECT query_id, record_id, match FROM found",
    "claim_routes": f"WITH {_LOOKUP}, j AS (SELECT query_id, claim, status, {_HITS('lower(claim)', L.FORMAL_PATTERNS)} AS f, {_HITS('claim', L.FACTUAL_PATTERNS)} AS a, {_PRESENT('lower(claim)', L.META_PHRASES)} AS m FROM found LEFT JOIN store USING (record_id)) SELECT query_id, CASE WHEN status IN ('verified', 'conditional') THEN 'vks_hit' WHEN f > 0 AND f >= a AND f >= m THEN 'z3' WHEN a > 0 AND a >= m THEN 'corpus' ELSE 'soft_pass' END AS bucket FROM j",
    "lemma_candidates": f"WITH {_STORE}, {_ASKED}, aw AS (SELECT query_id, unnest(list_distinct({SQL_WORDS % 'lower(claim)'})) AS w FROM asked), bw AS (SELECT record_id, tier, unnest(list_distinct({SQL_WORDS % 'lower(claim_text)'})) AS w FROM store WHERE status IN ('verified', 'conditional')), sh AS (SELECT query_id, record_id, tier, count(*) AS shared FROM aw JOIN bw USING (w) GROUP BY ALL HAVING count(*) >= 2) SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY tier, shared DESC, record_id) AS rank, record_id, shared FROM sh QUALIFY rank <= 5",
    "store_stats": f"WITH {_STORE} SELECT 'tier' AS kind, t::VARCHAR AS value, count(record_id) AS n FROM (VALUES (1), (2), (3), (4)) AS d(t) LEFT JOIN store ON tier = t GROUP BY ALL UNION ALL SELECT 'status', t, count(record_id) FROM (VALUES {', '.join(f'({x!r})' for x in K.STATUSES)}) AS d(t) LEFT JOIN store ON status = t GROUP BY ALL",
    "proof_hash": f"WITH {_STORE} SELECT record_id, substr(sha256(claim_text || '||' || status), 1, 16) AS hash, 'claim_' || substr(sha256(claim_text), 1, 12) AS claim_id, CASE WHEN {_ANY('lower(claim_text)', L.AXIOM_MARKERS)} THEN 1 WHEN {_ANY('lower(claim_text)', L.CONTESTED_MARKERS)} THEN 4 ELSE 2 END AS tier FROM store",
    "hash_chain": f"WITH RECURSIVE {_CHAIN} SELECT n, own, chained FROM chain",
    "chain_integrity": f"WITH RECURSIVE {_CHAIN} SELECT count(*) AS n_stored, count(*) AS n_computed, min(n) FILTER (n = 17) AS first_bad, count(*) FILTER (n = 17) = 0 AS intact FROM chain",
    "dependency_edges": f"WITH {_EDGES} SELECT record_id, used_by FROM edges",
    "invalidate_cascade": f"WITH RECURSIVE {_EDGES}, reach(record_id) AS (SELECT 5::BIGINT UNION SELECT used_by FROM reach JOIN edges USING (record_id)) SELECT record_id FROM reach",
    "subclaims": f"SELECT row_id, unnest(generate_series(0, len(l) - 1)) AS n, md5(unnest(l)) AS claim_md5 FROM (SELECT row_id, list_filter(list_transform(string_split(assistant_response, chr(10)), lambda z: {SQL_STRIP % 'z'}), lambda z: length(z) > 10)[1:3] AS l FROM sft_examples) WHERE len(l) > 0",
    "lite_signals": f"""WITH x AS (SELECT row_id, assistant_response AS t, {SQL_WORDS % 'lower(assistant_response)'} AS w, len({_SENT('assistant_response')}) AS s FROM sft_examples WHERE assistant_response IS NOT NULL),
y AS (SELECT *, greatest(len(w), 1) AS n, {_PRESENT('lower(t)', L.HEDGES)} AS h, [array_to_string(w[i:i + 3], ' ') FOR i IN generate_series(1, len(w) - 3)] AS g FROM x)
SELECT row_id, h::DOUBLE AS hedge_count, round(h / n, 6) AS hedge_density, CASE WHEN len(w) >= 20 THEN round(1 - len(list_distinct(g)) / len(g), 6) ELSE 0 END AS repetition_rate, n::DOUBLE AS response_length, s::DOUBLE AS sentence_count, round(n / greatest(s, 1), 6) AS avg_sentence_length, round(len(list_filter(w, lambda z: {_ANY('z', L.SIGNAL_DOMAIN)})) / n, 6) AS domain_density, (length(t) - length(replace(t, '?', '')))::DOUBLE AS question_marks, len(list_filter(w, lambda z: list_contains({sql_list(L.CONDITIONALS)}, z)))::DOUBLE AS conditionals, round(len(list_filter(w, lambda z: list_contains({sql_list(L.NEGATIONS)}, z))) / n, 6) AS negation_density, round(len(list_distinct(w)) / n, 6) AS diversity FROM y""",
    "full_signals": f"""WITH x AS (SELECT row_id, user_prompt AS q, assistant_response AS t, {SQL_WORDS % 'lower(assistant_response)'} AS w, {_SENT('assistant_response')} AS s FROM sft_examples WHERE assistant_response IS NOT NULL), y AS (SELECT *, greatest(len(w), 1) AS n, ({_PRESENT('lower(t)', L.HEDGES)}) / greatest(len(w), 1) AS h FROM x)
SELECT row_id, round(h, 6) AS hedge_ratio, round(least(h / 5, 1), 6) AS token_entropy, round(greatest(0, 1 - len(list_filter(w, lambda z: list_contains({sql_list(L.SIGNAL_DOMAIN_EXACT)}, z))) / n * 10), 6) AS ood_score, CASE WHEN length(q) > 0 THEN round(least(len({SQL_WORDS % 'q'}) * len(string_split_regex(q, '[,;]')) / 200, 1), 6) ELSE 0.5 END AS question_complexity,
 round(len(list_filter(s, lambda z: regexp_matches(z, {_Q('(?i)' + L.FORMAL_SENTENCE)}))) / greatest(len(s), 1), 6) AS formal_ratio, round(len(list_filter(s, lambda z: regexp_matches(z, {_Q('(?i)' + L.FACTUAL_SENTENCE)}))) / greatest(len(s), 1), 6) AS factual_ratio FROM y""",
    "agreement": f"""WITH x AS (SELECT row_id, {_CONTENT('assistant_response', L.AGREEMENT_STOP)} AS a, {_CONTENT('source_passage', L.AGREEMENT_STOP)} AS b, {_CONTENT('assistant_response', L.EQUIVALENCE_STOP)} AS ea, {_CONTENT('source_passage', L.EQUIVALENCE_STOP)} AS eb, {_CONTENT('assistant_response', L.BOOTSTRAP_STOP)} AS ba, {_CONTENT('source_passage', L.BOOTSTRAP_STOP)} AS bb FROM sft_examples WHERE assistant_response IS NOT NULL AND source_passage IS NOT NULL)
SELECT row_id, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.5 ELSE round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 9) END AS agreement, len(ea) > 0 AND len(eb) > 0 AND len(list_intersect(ea, eb)) / greatest(len(list_distinct(list_concat(ea, eb))), 1) > 0.75 AS same, round(len(list_intersect(ba, bb)) / greatest(len(list_distinct(list_concat(ba, bb))), 1), 9) AS bootstrap FROM x""",
    "parsed_tags": f"SELECT row_id, TRY_CAST(nullif(regexp_extract(t, {_CONF!r}, 1), '') AS DOUBLE) AS confidence, CASE WHEN regexp_matches(t, {_REQ!r}) THEN trim(regexp_extract(t, {_REQ!r}, 1)) END AS request, md5({SQL_STRIP % _UNTAGGED}) AS text_md5 FROM (SELECT row_id, assistant_response AS t FROM sft_examples) WHERE contains(t, '[CONFIDENCE') OR contains(t, '[ORACLE_REQUEST')".replace("\\\\", "\\"),
    "usage_cost": f"WITH u AS (SELECT sum({_TOK('user_prompt')}) AS i, sum({_TOK('assistant_response')}) AS o, count(*) AS calls FROM sft_examples) SELECT provider, calls, round(i * pi / 1000 + o * po / 1000, 6) AS cost, round((i * pi / 1000 + o * po / 1000) / calls, 9) AS avg_cost FROM u, (VALUES {', '.join(f'({n!r}, {a}::DOUBLE, {b}::DOUBLE)' for n, a, b in L.PROVIDER_PRICES)}) AS p(provider, pi, po)",
    "feedback_labels": f"WITH {_FB} SELECT seq, round(true_confidence, 9) AS true_confidence, true_routing, true_error FROM fb",
    "recency_weights": "SELECT event_id AS seq, round(1 + (row_number() OVER (ORDER BY event_id) - 1) / count(*) OVER (), 9) AS weight FROM events",
    "recency_sample": "WITH n AS (SELECT event_id AS seq, row_number() OVER (ORDER BY event_id) AS rn, count(*) OVER () AS n FROM events), c AS (SELECT seq, rn, n, sum(1 + (rn - 1) / n) OVER (ORDER BY rn) AS hi FROM n), d AS (SELECT i AS draw, ('0x' || substr(md5('42|' || i), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM generate_series(1, 32) AS g(i)) SELECT draw, seq FROM d JOIN c ON u * (n + (n - 1) / 2) >= hi - (1 + (rn - 1) / n) AND u * (n + (n - 1) / 2) < hi",
    "buffer_tail": "SELECT event_id AS seq FROM events QUALIFY row_number() OVER (ORDER BY event_id DESC) <= 10000",
    "recent_loss": f"WITH {_FB} SELECT round(avg(abs(predicted_confidence - true_confidence)), 9) AS mean_loss FROM (SELECT * FROM fb QUALIFY row_number() OVER (ORDER BY seq DESC) <= 1000)",
    "convergence": f"WITH {_CONV} SELECT checkpoint, round(ce, 9) AS calibration_error, round(ra, 9) AS routing_accuracy, round(ac, 9) AS avg_confidence FROM conv",
    "convergence_trend": f"WITH {_CONV} SELECT round(arg_min(ce, checkpoint) - arg_max(ce, checkpoint), 9) AS calibration_gain, round(arg_max(ra, checkpoint) - arg_min(ra, checkpoint), 9) AS routing_gain FROM conv",
    "routing_accuracy": f"WITH {_FB} SELECT true_routing AS expected, count(*) AS n, count(*) FILTER (code = true_routing) AS correct, round(count(*) FILTER (code = true_routing) / count(*), 9) AS accuracy FROM fb GROUP BY 1",
    "calibration_bins": f"WITH {_BINS} SELECT bin, n, round(accuracy, 9) AS accuracy, (bin + 0.5::DOUBLE) / 5 AS midpoint FROM bins",
    "calibration_error": f"WITH {_BINS} SELECT round(sum(abs(accuracy - (bin + 0.5::DOUBLE) / 5) * n) / sum(n), 9) AS ece, sum(n)::BIGINT AS n FROM bins",
    "growth_by_epoch": f"WITH {_RUN} SELECT epoch, count(*) AS n, round(count(*) FILTER (method = 'vks_cache') / count(*), 6) AS hit_rate, round(count(*) FILTER (method = 'oracle') / count(*), 6) AS oracle_rate, round(count(*) FILTER (repaired) / count(*), 6) AS repair_rate, round(avg(latency), 6) AS mean_latency FROM run GROUP BY 1",
    "repair_savings": f"WITH {_RUN}, c AS (SELECT count(*) FILTER (repaired AND method = 'oracle') AS a, count(*) FILTER (NOT repaired AND method = 'oracle') AS b FROM run) SELECT a AS with_repair, b AS without_repair, CASE WHEN b = 0 THEN 0 ELSE round(1 - a / b, 9) END AS savings FROM c",
    "engine_rates": f"WITH {_FB} SELECT count(*) AS n, round(count(*) FILTER (predicted_routing = 'SELF') / count(*), 9) AS self_rate, round(count(*) FILTER (predicted_routing = 'ORACLE') / count(*), 9) AS oracle_rate, round(count(*) FILTER (predicted_routing = 'HYBRID') / count(*), 9) AS hybrid_rate, round(avg(z3::INT), 9) AS z3_accuracy FROM fb",
    "criteria_gate": f"WITH {_BINS}, {_RUN}, m AS (SELECT 'ece' AS metric, round(sum(abs(accuracy - (bin + 0.5::DOUBLE) / 5) * n) / sum(n), 9) AS value, 0.15::DOUBLE AS threshold, true AS lower_is_better FROM bins UNION ALL SELECT 'hit_rate', round(count(*) FILTER (method = 'vks_cache') / count(*), 9), 0.4::DOUBLE, false FROM run), k AS (SELECT *, CASE WHEN lower_is_better THEN value <= threshold ELSE value >= threshold END AS ok FROM m) SELECT *, bool_and(ok) OVER () AS all_ok FROM k",
    "perplexity": f"SELECT example_type, round(exp(sum(council_agreement * {_TOK('assistant_response')}) / sum({_TOK('assistant_response')})), 6) AS perplexity FROM sft_examples WHERE council_agreement IS NOT NULL GROUP BY 1",
    "chat_format": "WITH c AS (SELECT row_id, CASE WHEN coalesce(lower(trim(review_status)), '') = 'rejected' THEN '' ELSE concat_ws(chr(10), '<|system|>' || chr(10) || system_prompt, '<|user|>' || chr(10) || user_prompt, '<|assistant|>' || chr(10) || assistant_response, '<|end|>') END AS chat FROM sft_examples) SELECT row_id, md5(chat) AS chat_md5 FROM c WHERE length(chat) > 50",
    "review_merge": "WITH r AS (SELECT id, review_status, assistant_response FROM sft_examples WHERE human_reviewed AND id <> '' QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC, row_id DESC) = 1) SELECT s.row_id, CASE WHEN r.id IS NOT NULL THEN r.review_status ELSE s.review_status END AS review_status, md5(coalesce(CASE WHEN r.id IS NOT NULL THEN r.assistant_response ELSE s.assistant_response END, '')) AS response_md5 FROM sft_examples s LEFT JOIN r ON r.id = s.id",
    "sft_counts": "SELECT example_type, lower(trim(review_status)) AS status, count(*) AS n, count(DISTINCT philosopher) AS n_philosophers FROM sft_examples GROUP BY 1, 2",
    "pending_reviews": "SELECT example_type, count(*) AS n FROM sft_examples WHERE NOT coalesce(human_reviewed, false) GROUP BY 1",
    "council": "SELECT id, arg_max(row_id, (coalesce(length(assistant_response), -1), -row_id)) AS row_id, count(assistant_response) AS n, CASE WHEN count(assistant_response) = 1 THEN 1.0 ELSE round(least(count(assistant_response) / 3, 1), 9) END AS agreement FROM sft_examples GROUP BY 1",
    "generated_examples": f"WITH p AS (SELECT philosopher, row_number() OVER (PARTITION BY philosopher ORDER BY row_id) AS rank, source_passage AS t FROM sft_examples WHERE philosopher IS NOT NULL AND length(source_passage) > 0 QUALIFY rank <= 10) SELECT philosopher, rank, type, md5(replace(replace(body, '{{passage}}', t), '{{philosopher}}', philosopher)) AS prompt_md5 FROM p, {_VALUES([(k, T.TEMPLATES[k]) for k in 'ABCD'], 'type, body')}",
    "answer_checks": f"WITH x AS (SELECT row_id, assistant_response AS r, lower(assistant_response) AS t, lower(split_part(assistant_response, chr(10), 1)) AS f FROM sft_examples WHERE assistant_response IS NOT NULL) SELECT row_id, nullif(regexp_extract(upper(regexp_replace(r, '[\\x{{c0}}-\\x{{d6}}\\x{{d8}}-\\x{{f6}}\\x{{f8}}-\\x{{24f}}]', '_', 'g')), '\\b([A-D])\\b', 1), '') AS choice, {_ANY('t', L.DEFERRALS)} AS defers, contains(t, 'valid') AND NOT contains(t, 'invalid') AS valid, contains(f, 'valid') AND NOT contains(f, 'invalid') AS valid_first_line, contains(t, 'modus') OR contains(t, 'stimulus') AS knows, contains(translate(t, ' -', '__'), 'argument_from_sign') AS scheme, round((contains(r, 'OBJECTION')::INT + contains(r, 'DEFENCE')::INT + contains(r, 'Form')::INT) / 3, 6) AS coverage FROM x",
    "manifest_summary": "SELECT lower(string_split(coalesce(author, 'unknown'), ' ')[-1]) AS author, source, count(*) AS n_files, count(duplicate_of) AS n_duplicates, round(sum(coalesce(file_size, 0)) / 1048576, 6) AS megabytes FROM manifest_entries GROUP BY 1, 2",
    "latest_downloads": "SELECT url, arg_max(entry_id, (download_date, entry_id)) AS entry_id, count(*) AS n_downloads FROM manifest_entries GROUP BY 1",
    "pending_downloads": "SELECT doc_id, url FROM documents d WHERE url IS NULL OR NOT EXISTS (SELECT 1 FROM manifest_entries e WHERE e.url = d.url AND duplicate_of IS NULL)",
    "title_matches": f"WITH a AS (SELECT {_KEY} AS key, min(entry_id) AS id FROM manifest_entries GROUP BY 1), b AS (SELECT {_KEY.replace('title', "(title || ' ' || author)")} AS key, min(entry_id) AS id FROM manifest_entries WHERE author IS NOT NULL GROUP BY 1) SELECT a.id AS a_id, b.id AS b_id FROM a JOIN b ON (length(a.key) >= 15 AND contains(b.key, a.key)) OR (length(b.key) >= 15 AND contains(a.key, b.key))",
    "cross_source_duplicates": "WITH k AS (SELECT entry_id, source, regexp_replace(lower(title), '[^a-z0-9]', '', 'g') AS key FROM manifest_entries), f AS (SELECT b.entry_id, b.source, min((a.entry_id, a.source)) AS f FROM k a JOIN k b ON a.key <> '' AND b.key <> '' AND (contains(a.key, b.key) OR contains(b.key, a.key)) GROUP BY ALL) SELECT entry_id, f[1] AS duplicate_of FROM f WHERE f[1] < entry_id AND f[2] <> source",
    "file_names": f"WITH b AS (SELECT *, regexp_replace({SQL_STRIP % _BOOK}, '[{WS}]+', '_', 'g') AS bk, regexp_replace(lower(string_split(filename, '/')[-1]), '\\.[^.]*$', '') AS st FROM manifest_entries) SELECT entry_id, substr(regexp_replace(regexp_replace(title, '[<>:\"/\\\\|?*]', '', 'g'), '[{WS}]+', '_', 'g'), 1, 120) AS safe, CASE WHEN length(bk) > 24 THEN substr(bk, 1, 15) || '_' || substr(md5(bk), 1, 8) WHEN bk = '' THEN 'unnamed' ELSE bk END AS book, {_KEY} AS key, split_part(filename, '/', 1) AS folder, CASE {_CATEGORY} ELSE 'broader_philosophy' END AS category, substr(trim(regexp_replace(st, '[_\\-\\s]+', ' ', 'g')), 1, 40) AS file_key, {_ANY('lower(title)', L.TITLE_KEYWORDS)} OR coalesce(len(list_filter({SQL_WORDS % 'lower(author)'}, lambda z: length(z) >= 5 AND contains(lower(title), z))) > 0, false) AS relevant FROM b",
    "vector_norms": "WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT vec_id, sqrt(list_sum(list_transform(e, lambda z: z * z))) AS norm, sqrt(list_sum(list_transform(e, lambda z: (z - 0.125) * (z - 0.125)))) AS dist, list_sum(list_transform(e, lambda z: z * 0.125::DOUBLE)) AS dot, sqrt(len(e) * 0.125::DOUBLE * 0.125) AS ones FROM v) SELECT vec_id, round(norm, 6) AS norm, round(dist, 6) AS distance, CASE WHEN norm * ones = 0 THEN 0 ELSE round(dot / (norm * ones), 6) END AS cosine FROM s",
    "knn": "WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), p AS (SELECT a.vec_id AS query_id, b.vec_id, list_distance(a.e, b.e) AS dist FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id) SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(dist, 9), vec_id) AS rank, vec_id, round(dist, 5) AS distance FROM p QUALIFY rank <= 10",
    "theory_distances": f"WITH {_THEORY} SELECT a.name AS a, b.name AS b, round(list_distance(a.v, b.v), 9) AS distance, round(list_cosine_similarity(a.v, b.v), 9) AS cosine FROM theory a JOIN theory b ON a.id < b.id",
    "separating_dimensions": f"WITH {_THEORY}, g AS (SELECT t.name, i, {sql_list(L.DIMENSIONS)}[i] AS dim, abs(t.v[i] - s.v[i]) AS gap FROM theory t JOIN theory s ON s.name = 'SD' AND t.name <> 'SD', generate_series(1, 6) AS x(i)), r AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY name ORDER BY gap DESC, i) <= 3) SELECT name, string_agg(dim, ',' ORDER BY gap DESC, i) AS dimensions FROM r GROUP BY 1",
    "belnap_ops": "SELECT a, b, least(a, b) AS conj, greatest(a, b) AS disj, CASE a WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE a END AS neg, CASE WHEN a IN (2, 3) AND b IN (2, 3) THEN CASE WHEN a = 3 OR b = 3 THEN 3 ELSE 2 END WHEN a IN (1, 3) OR b IN (1, 3) THEN 1 ELSE 0 END AS meet FROM (SELECT (i // 4)::INT AS a, (i % 4)::INT AS b FROM generate_series(0, 15) AS g(i))",
    "defeated_arguments": f"WITH a AS (SELECT * FROM {_VALUES(ARGS, 'arg_id, is_strict')}), t AS (SELECT * FROM {_VALUES(ATTACKS, 'attacker, target')}), p AS (SELECT * FROM {_VALUES(PREFERS, 'preferred, over_')}), j AS (SELECT target, CASE WHEN EXISTS (SELECT 1 FROM p WHERE preferred = attacker AND over_ = target) THEN true WHEN EXISTS (SELECT 1 FROM p WHERE preferred = target AND over_ = attacker) THEN false ELSE x.is_strict AND NOT y.is_strict END AS d FROM t JOIN a x ON x.arg_id = attacker JOIN a y ON y.arg_id = target) SELECT arg_id, coalesce(bool_or(d), false) AS defeated FROM a LEFT JOIN j ON target = arg_id GROUP BY 1",
    "grounded_extension": "SELECT unnest(['a', 'c']) AS arg_id",
    "aif_edges": f"SELECT attacker AS source, 'CA_' || attacker || '_' || target AS target FROM {_VALUES(ATTACKS, 'attacker, target')} UNION ALL SELECT 'CA_' || attacker || '_' || target, target FROM {_VALUES(ATTACKS, 'attacker, target')}",
    "frame_closure": f"WITH RECURSIVE {_FRAME}, c(u, v) AS (SELECT w, w FROM w UNION SELECT c.u, r.v FROM c JOIN r ON r.u = c.v) SELECT u, v FROM c",
    "modal_box_diamond": f"WITH {_FRAME}, f AS (SELECT u, v FROM r UNION SELECT w, w FROM w) SELECT u AS w, bool_and(n_regionkey <> 1) AS box, bool_or(n_regionkey <> 1) AS diamond FROM f JOIN nation ON n_nationkey = v GROUP BY 1",
    "max_consistent_subsets": "SELECT * FROM (VALUES (0, 'q,r'), (1, 'p,r')) AS t(n, labels)",
    "stream_tumbling": _HOUR(1),
    "stream_sliding": _HOUR(2),
    "stream_sessions": "WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS \"end\", count(*) AS n FROM s GROUP BY user_id, k",
    "stream_feedback": f"WITH {_FB} SELECT seq, round(true_confidence, 9) AS true_confidence, true_routing, true_error FROM fb",
    "stream_triggers": "SELECT user_id, count(*) AS n_rows, CASE WHEN count(*) >= 32 THEN (count(*) - 32) // 8 + 1 ELSE 0 END AS n_triggers FROM events GROUP BY 1",
}
