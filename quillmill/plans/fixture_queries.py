"""Queries over literal fixtures and over rows made from the tables, for operators the tables do not feed directly."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmill.functions import scalars as S
from quillmill.functions import text as X
from quillmill.operators import cascade as V
from quillmill.operators import claims as K
from quillmill.operators import learner as N
from quillmill.operators import logic as G
from quillmill.operators import manifest as M
from quillmill.operators import sft as T
from quillmill.plans import engine_queries as E
from quillmill.plans import pipeline as P
from quillmill.plans.corpus_queries import md5
from quillmill.session import load
from quillmill.sources import files as FS


def aif_nodes(s, d):
    a, t, _ = E._graph(s)
    return G.aif(a, t)[0]


def scheme_instances(s, d):
    slots = F.create_map(*[x for k, v in (("case_1", "a clock"), ("case_2", "a mind"), ("property", "order"), ("respects", "parts"), ("sign", "smoke"), ("state", "fire")) for x in (F.lit(k), F.lit(v))])
    return P.instantiate(P.schemes(s).withColumn("bindings", slots)).select("scheme", F.array_join("premises", "; ").alias("premises"), "conclusion")


CLAIMS = [("c1", "soul"), ("c2", "not body"), ("c3", "time")]
THEORY_LITERALS = [("t1", "soul"), ("t1", "body"), ("t2", "not soul"), ("t3", "space")]


def context_verdicts(s, d):
    rows = G.context_verdicts(s.createDataFrame(CLAIMS, "claim string, literal string"), s.createDataFrame(THEORY_LITERALS, "theory string, literal string"))
    return rows.select("theory", F.array_join("entailed", ",").alias("entailed"), F.array_join("contradicted", ",").alias("contradicted"))


def soft_optimum(s, d):
    a = s.createDataFrame([("x", "p"), ("x", "q"), ("y", "p"), ("y", "r"), ("z", "q")], "assignment string, literal string")
    return G.soft_optimum(a, s.createDataFrame([("p", 1.0), ("q", 0.5), ("r", 2.0)], "literal string, weight double"))


def model_signals(s, d):
    e = F.transform("embedding", lambda x: x.cast("double"))
    p = F.transform(e, lambda x: F.abs(x))
    flat = S.signals_4160(e, F.slice(p, 1, 8), F.slice(p, 9, 4), F.array(F.lit(1.0)))
    return load(s, d, "embeddings").select("vec_id", F.round(S.hidden_similarity(e, 1.0), 6).alias("similarity"), F.round(S.entropy(F.slice(p, 1, 8)), 6).alias("entropy"), F.size(flat).cast("bigint").alias("n"), F.round(F.element_at(flat, 4145), 6).alias("mean_entropy"))


def bootstrap_questions(s, d):
    """40 : 30 : 30 mix of three kinds of questions in seeded order."""
    rows = load(s, d, "eval_items").select("item_id", "eval_set")
    kind = F.when(F.col("eval_set").isin("validity", "knowledge_mc"), "self").when(F.col("eval_set") == "routing", "oracle").otherwise("hybrid")
    ordered = T.seeded_order(rows.withColumn("kind", kind), "item_id")
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("kind").orderBy("order_key"))
    most = F.when(F.col("kind") == "self", 40).otherwise(30)
    return ordered.withColumn("n", n).filter(F.col("n") <= most).select("kind", F.col("n").cast("bigint").alias("n"), "item_id")


def page_texts(s, d):
    """Pages made of entries: three to a page in reading order, a page number and a header on each."""
    block = F.struct((F.col("entry_id") % 3 * 10).cast("double").alias("x"), (100 + F.col("entry_id") % 3 * 50).cast("double").alias("y"), "title")
    pages = load(s, d, "manifest_entries").groupBy(F.floor(F.col("entry_id") / 3).alias("page")).agg(F.collect_list(F.struct(block["x"].alias("x"), block["y"].alias("y"), F.col("title").alias("text"))).alias("blocks"))
    extra = F.array(F.struct(F.lit(0.0).alias("x"), F.lit(10.0).alias("y"), F.lit("Running title").alias("text")), F.struct(F.lit(0.0).alias("x"), F.lit(400.0).alias("y"), F.col("page").cast("string").alias("text")))
    return pages.select("page", FS.page_blocks(F.concat("blocks", extra), F.lit(800.0)).alias("text"))


def atom_feed(s, d):
    """An Atom feed per source made of its entries, parsed back."""
    entry = F.concat(F.lit("<entry><id>http://x/abs/"), F.col("entry_id").cast("string"), F.lit("</id><title>"), "title", F.lit("\n!</title><summary>s</summary><author><name>"), F.coalesce("author", F.lit("?")), F.lit("</name></author><category term='c'/></entry>"))
    feeds = load(s, d, "manifest_entries").groupBy("source").agg(F.concat(F.lit("<feed xmlns='http://www.w3.org/2005/Atom'>"), F.array_join(F.array_sort(F.collect_list(entry)), ""), F.lit("</feed>")).alias("xml"))
    return feeds.select(F.explode(FS.atom_entries(F.col("xml"))).alias("e")).select(F.col("e.id").cast("bigint").alias("entry_id"), F.col("e.title").alias("title"), F.array_join("e.authors", ";").alias("authors"))


def picked_files(s, d):
    """Of the files of each source the best: text, then djvu text, then pdf."""
    name = F.concat(F.split_part("filename", F.lit("/"), F.lit(2)), F.when(F.col("entry_id") % 4 == 0, ".pdf").when(F.col("entry_id") % 4 == 1, "_thumb.pdf").otherwise(""))
    files = load(s, d, "manifest_entries").select("source", F.struct(F.col("entry_id").alias("i"), name.alias("name"), F.coalesce("file_size", F.lit(0)).alias("size")).alias("f"))
    listed = files.groupBy("source").agg(F.transform(F.array_sort(F.collect_list("f")), lambda f: F.struct(f["name"].alias("name"), f["size"].alias("size"))).alias("files"))
    return listed.select("source", M.pick_file(F.col("files")).alias("name"))


def text_urls(s, d):
    formats = F.map_filter(F.create_map(F.lit("text/html"), F.lit("h"), F.lit("text/plain"), F.when(F.col("entry_id") % 3 == 0, F.concat("url", F.lit(".zip"))).otherwise(F.col("url")), F.lit("text/plain; charset=x"), F.when(F.col("entry_id") % 2 == 0, F.concat("url", F.lit("/x")))), lambda k, v: v.isNotNull())
    return load(s, d, "manifest_entries").select("entry_id", M.pick_text_url(formats).alias("picked"))


def tree_report(s, d):
    rows = load(s, d, "manifest_entries").select(F.lit("formal_logic").alias("category"), F.col("file_size").alias("length")).filter("length > 0")
    return P.tree_report(rows)


def prompts(s, d):
    rows = load(s, d, "sft_examples").select("row_id", X.code_prompt(F.pmod(F.col("row_id"), F.lit(6)), F.col("user_prompt"), F.col("assistant_response")).alias("p"), X.feedback_text(F.array("example_type"), F.array("id"), F.col("philosopher")).alias("f"))
    return rows.select("row_id", md5(F.col("p")).alias("prompt_md5"), "f")


def final_routes(s, d):
    rows = load(s, d, "sft_examples")
    return rows.select("row_id", V.final_route(F.coalesce("council_agreement", F.lit(0.5)), X.parse_request(F.col("assistant_response"))).alias("route"))


def claim_counters(s, d):
    """Per response: claims by method after routing."""
    found = K.extract_claims(load(s, d, "sft_examples"), "row_id", "assistant_response")
    bucket = K.route(F.col("claim_type"), F.lit(None).cast("string"))
    method = F.when(bucket == "vks_hit", "vks_cache").otherwise(bucket)
    return V.counters(found.select(F.col("row_id").alias("response_id"), method.alias("method"), (method == "soft_pass").alias("verified")))


def verified_answers(s, d):
    """The generate/verify loop with stubs in place of model and solver."""
    queries = load(s, d, "eval_items").select(F.col("item_id").alias("query_id"), F.col("q").alias("query"))
    generate = lambda xs: [x.split("\n---\n")[0] + ("" if x.endswith("---\n") else " again") for x in xs]
    verify = lambda xs: ["unsat" if len(x) % 3 == 0 else "sat" for x in xs]
    return V.generate_verify(queries, generate, verify).select("query_id", "status", "attempt")


def learner_predictions(s, d):
    cols = S.lite_signals(F.col("assistant_response"), F.col("w"))
    rows = load(s, d, "sft_examples").filter("assistant_response is not null").withColumn("w", X.lower_words(F.col("assistant_response"))).select("row_id", S.signal_vector(cols).alias("v"))
    return N.score(rows.withColumn("v", F.transform("v", lambda x: x.cast("double"))), "row_id", "v", N.init()).withColumn("confidence", F.round("confidence", 6))


def repaired_claims(s, d):
    rows = load(s, d, "eval_items").select(F.col("item_id").alias("claim_id"), F.col("q").alias("claim"), F.when(F.col("item_id") % 2 == 0, "refuted").otherwise("verified").alias("status"))
    return V.repair(rows, lambda xs: [x.split("\n---\n")[1] + "." for x in xs], lambda xs: ["unsat" if len(x) % 2 else "timeout" for x in xs]).select("claim_id", "status", "attempt", "strategy")


QUERIES = {f.__name__: f for f in (aif_nodes, scheme_instances, context_verdicts, soft_optimum, model_signals, bootstrap_questions, page_texts, atom_feed, picked_files, text_urls, tree_report, prompts, final_routes, claim_counters, verified_answers, learner_predictions, repaired_claims)}

_NAME = "(string_split(filename, '/')[2] || CASE entry_id % 4 WHEN 0 THEN '.pdf' WHEN 1 THEN '_thumb.pdf' ELSE '' END)"
ORACLE = {
    "aif_nodes": f"SELECT arg_id AS node_id, 'I' AS kind FROM {E._VALUES(E.ARGS, 'arg_id, s')} UNION ALL SELECT 'CA_' || attacker || '_' || target, 'CA' FROM {E._VALUES(E.ATTACKS, 'attacker, target')}",
    "scheme_instances": "SELECT * FROM (VALUES ('analogy', 'a clock has property order; a clock is similar to a mind in respects parts', 'a mind has property order'), ('sign', 'smoke is present; smoke usually means fire', 'fire holds')) AS t(scheme, premises, conclusion)",
    "context_verdicts": f"WITH c AS (SELECT * FROM {E._VALUES(CLAIMS, 'claim, literal')}), t AS (SELECT * FROM {E._VALUES(THEORY_LITERALS, 'theory, literal')}), e AS (SELECT theory, string_agg(DISTINCT claim, ',') AS entailed FROM t JOIN c USING (literal) GROUP BY 1), n AS (SELECT theory, string_agg(DISTINCT claim, ',') AS contradicted FROM t JOIN c ON c.literal = 'not ' || t.literal OR t.literal = 'not ' || c.literal GROUP BY 1) SELECT DISTINCT theory, entailed, contradicted FROM t LEFT JOIN e USING (theory) LEFT JOIN n USING (theory)",
    "soft_optimum": "SELECT 'y' AS assignment, 3.0::DOUBLE AS weight",
    "model_signals": "WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, list_transform(embedding::DOUBLE[], lambda z: abs(z)) AS p FROM embeddings) SELECT vec_id, round(greatest(0, 1 - abs(sqrt(list_sum(list_transform(e, lambda z: z * z))) - 1) / 1), 6) AS similarity, round(-list_sum(list_transform(p[1:8], lambda z: z * ln(z + 1e-10))), 6) AS entropy, 4160 AS n, round(list_avg(p[1:8]), 6) AS mean_entropy FROM v",
    "bootstrap_questions": "WITH k AS (SELECT item_id, CASE WHEN eval_set IN ('validity', 'knowledge_mc') THEN 'self' WHEN eval_set = 'routing' THEN 'oracle' ELSE 'hybrid' END AS kind, md5('42|' || item_id) AS o FROM eval_items) SELECT kind, row_number() OVER (PARTITION BY kind ORDER BY o) AS n, item_id FROM k QUALIFY n <= CASE kind WHEN 'self' THEN 40 ELSE 30 END",
    "page_texts": "SELECT entry_id // 3 AS page, string_agg(trim(title), chr(10) || chr(10) ORDER BY entry_id % 3) AS text FROM manifest_entries GROUP BY 1",
    "atom_feed": "SELECT entry_id, trim(title) || ' !' AS title, coalesce(author, '?') AS authors FROM manifest_entries",
    "picked_files": f"WITH f AS (SELECT source, entry_id, lower({_NAME}) AS l, {_NAME} AS name, coalesce(file_size, 0) AS size FROM manifest_entries), r AS (SELECT source, entry_id, name, CASE WHEN l LIKE '%.txt' AND size >= 1024 AND name NOT LIKE '%Metadata%' THEN 1 WHEN l LIKE '%djvu.txt' THEN 2 WHEN l LIKE '%.pdf' AND size >= 10240 AND l NOT LIKE '%thumb%' THEN 3 END AS k FROM f) SELECT source, arg_min(name, (k, entry_id)) FILTER (k IS NOT NULL) AS name FROM r GROUP BY 1",
    "text_urls": "SELECT entry_id, CASE WHEN entry_id % 3 <> 0 THEN url WHEN entry_id % 2 = 0 THEN url || '/x' END AS picked FROM manifest_entries",
    "tree_report": f"SELECT category, CASE WHEN category = 'formal_logic' THEN n ELSE 0 END AS n_files, CASE WHEN category = 'formal_logic' THEN b ELSE 0 END AS bytes FROM (SELECT unnest({E.sql_list(E.L.INDEX_CATEGORIES)}) AS category), (SELECT count(*) AS n, sum(file_size)::BIGINT AS b FROM manifest_entries WHERE file_size > 0)",
    "final_routes": "WITH x AS (SELECT row_id, CASE WHEN coalesce(council_agreement, 0.5) >= 0.85 THEN 'SELF' WHEN coalesce(council_agreement, 0.5) < 0.4 THEN 'ORACLE' ELSE 'HYBRID' END AS r, coalesce(regexp_matches(assistant_response, '\\[ORACLE_REQUEST:[^\\]]*\\]'), false) AS q FROM sft_examples) SELECT row_id, CASE WHEN r = 'SELF' AND q THEN 'HYBRID' ELSE r END AS route FROM x",
    "claim_counters": f"WITH {E._CLAIMS} SELECT row_id AS response_id, count(*) AS n_claims, count(*) FILTER (claim_type NOT IN ('formal', 'factual')) AS n_verified, 0 AS n_vks_cache, count(*) FILTER (claim_type = 'formal') AS n_z3, count(*) FILTER (claim_type = 'factual') AS n_corpus, 0 AS n_oracle, count(*) FILTER (claim_type NOT IN ('formal', 'factual')) AS n_soft_pass FROM typed GROUP BY 1",
    "verified_answers": "SELECT item_id AS query_id, CASE WHEN length(q) % 3 = 0 THEN 'verified' WHEN (length(q) + 6) % 3 = 0 THEN 'verified' ELSE 'refuted' END AS status, CASE WHEN length(q) % 3 = 0 THEN 1 ELSE 3 END AS attempt FROM eval_items",
    "repaired_claims": "SELECT item_id AS claim_id, CASE WHEN item_id % 2 = 1 THEN 'verified' ELSE 'verified' END AS status, CASE WHEN item_id % 2 = 1 THEN 0 WHEN length(q) % 2 = 0 THEN 1 ELSE 2 END AS attempt, CASE WHEN item_id % 2 = 1 THEN NULL WHEN length(q) % 2 = 0 THEN 're_state' ELSE 'decompose' END AS strategy FROM eval_items",
}
