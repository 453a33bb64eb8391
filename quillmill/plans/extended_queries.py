"""Queries over files and sinks, streams with stores, the query cascade, verifiers and argument trees, with oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmill.functions import lexicon as L
from quillmill.functions import scalars as S
from quillmill.functions import text as X
from quillmill.operators import cascade as V
from quillmill.operators import claims as K
from quillmill.operators import corpus as C
from quillmill.operators import feedback as B
from quillmill.operators import learner as N
from quillmill.operators import logic as G
from quillmill.operators import manifest as M
from quillmill.operators import sft as T
from quillmill.plans import corpus_queries as Q
from quillmill.plans import engine_queries as E
from quillmill.plans import pipeline as P
from quillmill.plans.corpus_queries import SQL_KEY, SQL_STRIP, SQL_TOKENS, SQL_WORDS, WS, docs, md5, sql_list
from quillmill.session import load, scratch_path
from quillmill.sources import files as FS
from quillmill.sources import sinks as K_
from quillmill.streaming import streams as ST


def entries(s, d):
    return load(s, d, "manifest_entries")


def items(s, d):
    return load(s, d, "eval_items")


# ---- files and sinks ------------------------------------------------------------------------------


def json_roundtrip(s, d):
    """Documents written as JSON lines and read with their schema."""
    path = scratch_path(s, "json")
    docs(s, d).select("doc_id", "lang", "text", "n_chars").write.json(path)
    back = FS.json_lines(s, path, "doc_id bigint, lang string, text string, n_chars bigint")
    return back.select("doc_id", "lang", "n_chars", md5(F.col("text")).alias("text_md5"))


def written_documents(s, d):
    """Documents partitioned by category, read back per category."""
    path = scratch_path(s, "documents")
    K_.write_documents(docs(s, d).withColumn("category", C.category_key(F.col("category"))), path)
    return s.read.parquet(path).groupBy("category").agg(F.count("*").alias("n_docs"), F.sum("n_chars").alias("n_chars"))


def written_training(s, d):
    path = scratch_path(s, "training")
    K_.write_training(Q._split(s, d), path)
    return s.read.schema("text string, split string").json(path).groupBy("split").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("n_chars"))


def written_examples(s, d):
    """Training examples by type; a subset is a filter on the written table."""
    path = scratch_path(s, "examples")
    K_.write_examples(load(s, d, "sft_examples"), path)
    return s.read.parquet(path).filter("example_type in ('A', 'B')").groupBy("example_type").agg(F.count("*").alias("n"), F.count("id").alias("with_id"))


def written_report(s, d):
    path = scratch_path(s, "report")
    K_.write_report(E.manifest_summary(s, d), path)
    return s.read.schema("author string, source string, n_files bigint, n_duplicates bigint").json(path)


def appended_records(s, d):
    """Records appended in two writes."""
    path = scratch_path(s, "append")
    K_.append(items(s, d).filter("item_id % 2 = 0").select("item_id", "topic"), path)
    K_.append(items(s, d).filter("item_id % 2 = 1").select("item_id", "topic"), path)
    return s.read.parquet(path)


def upserted_store(s, d):
    """Every third item changed, and as many new ones."""
    old = items(s, d).select("item_id", "topic")
    new = old.filter("item_id % 3 = 0").select("item_id", F.lit("changed").alias("topic")).union(old.filter("item_id % 3 = 1").select(F.col("item_id") + 10_000, F.lit("new")))
    return K_.upsert(old, new, "item_id")


def exported_results(s, d):
    rows = load(s, d, "sft_examples").select("row_id", F.col("council_agreement").alias("confidence"), (F.col("row_id") / 7e6).alias("cost"))
    return K_.rounded_results(rows)


def index_header(s, d):
    """Version, number of entries and categories of a written index."""
    path = scratch_path(s, "index")
    K_.write_index(docs(s, d).select("doc_id", C.category_key(F.col("category")).alias("category")), path)
    return K_.read_index(s, path)[1].select("version", "total", F.array_join("categories", ",").alias("categories"))


def index_search(s, d):
    """Keyword search over an index that was written and loaded again."""
    path = scratch_path(s, "index")
    K_.write_index(C.keywords(docs(s, d), ["doc_id"], "text").withColumn("category", F.lit("all")), path)
    asked = items(s, d).select(F.col("item_id").alias("query_id"), F.col("q").alias("query"))
    return C.keyword_search(K_.read_index(s, path)[0], ["doc_id"], asked)


def extraction_outcomes(s, d):
    """Texts, and files of a kind that is not read, by outcome."""
    files = docs(s, d).select(F.concat(F.lit("/raw/x/"), F.col("doc_id").cast("string")).alias("path"), F.lit("x").alias("category"), F.when(F.col("doc_id") % 5 == 0, ".djvu").otherwise(".txt").alias("suffix"), F.col("text").cast("binary").alias("content"))
    return FS.extraction_metrics(FS.extract(files))


def archive_hits(s, d):
    """A search answer per source, of which only texts are kept."""
    doc = F.struct(F.col("filename").alias("identifier"), "title", F.col("author").alias("creator"), F.when(F.col("entry_id") % 3 == 0, "audio").otherwise("texts").alias("mediatype"))
    answers = entries(s, d).groupBy("source").agg(F.to_json(F.struct(F.struct(F.collect_list(doc).alias("docs")).alias("response"))).alias("json"))
    return answers.select(F.inline(FS.archive_hits(F.col("json"))))


def search_items(s, d):
    """Items of the first three pages of paginated answers, made of a source's entries by month."""
    row = F.struct(F.col("entry_id").alias("id"), "title")
    pages = entries(s, d).groupBy(F.col("source").alias("query"), (F.col("entry_id") % 5 + 1).alias("page")).agg(F.to_json(F.struct(F.lit("next").alias("next"), F.array_sort(F.collect_list(row)).alias("results"))).alias("json"))
    return FS.search_pages(pages, "struct<id:bigint,title:string>").select("query", F.col("page").cast("bigint").alias("page"), F.col("item.id").alias("id"))


def relevant_hits(s, d):
    hits = entries(s, d).select("entry_id", "title", F.array("author").alias("authors"))
    return M.relevant_hits(hits, F.lit("Quilla Draumont")).select("entry_id")


def new_files(s, d):
    """Entries none of whose names is among the files with a size."""
    local = entries(s, d).filter("file_size is not null and entry_id % 2 = 0").select("filename")
    return M.new_files(entries(s, d).select("entry_id", "filename"), local).select("entry_id")


def first_hits(s, d):
    return M.first_of(entries(s, d).select("url", "entry_id", "title"), "url", ["entry_id"])


FOLDERS = {"draumont": "draumont", "quilla": "first_names", "ferrandole": "ferrandole"}


def author_folders(s, d):
    return entries(s, d).groupBy(M.author_folder(F.col("author"), FOLDERS).alias("folder")).agg(F.count("*").alias("n"))


def distinct_categories(s, d):
    return docs(s, d).agg(F.array_join(F.array_sort(F.collect_set(C.category_key(F.col("category")))), ",").alias("categories"))


# ---- streams --------------------------------------------------------------------------------------


def stream_first_urls(s, d):
    path = f"{d}/manifest_entries.parquet"
    stream = s.readStream.schema(s.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]").filter("url is not null")
    return ST.run_available(ST.first_urls(stream.withColumn("download_date", F.coalesce("download_date", F.lit("2000-01-01").cast("timestamp")).cast("timestamp"))).select("url"), "append", "urls")


def stream_read_through(s, d):
    """Claims looked up in a store that knows every second one; those it lacks are written back."""
    store, base = scratch_path(s, "store"), scratch_path(s, "through")
    items(s, d).filter("item_id % 2 = 0").select(F.col("item_id").alias("record_id"), F.col("q").alias("claim")).write.parquet(store)
    path = f"{d}/eval_items.parquet"
    stream = s.readStream.schema(s.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]").select("item_id", "q")

    def lookup(batch):
        known = batch.sparkSession.read.parquet(store).select("record_id").distinct()
        return batch.join(known, F.col("item_id") == F.col("record_id"), "left")

    ST.read_through(stream, lookup, lambda new: K_.append(new.select(F.col("item_id").alias("record_id"), F.col("q").alias("claim")), store), base)
    return s.read.parquet(store).select("record_id", F.length("claim").cast("bigint").alias("n"))


def stream_buffer_triggers(s, d):
    """Training starts by the length of a buffer of 64 rows."""
    fired = ST.triggers(ST.event_stream(s, f"{d}/events.parquet"), full=64)
    return ST.run_available(fired, "update", "triggers").groupBy("user_id").agg(F.max("n_rows").alias("n_rows"), F.max("n_triggers").alias("n_triggers"))


def online_learner(s, d):
    """A learner fed by the event stream, saved and loaded again: its updates, and whether its loss fell."""
    base = scratch_path(s, "learner")
    rows = ST.feedback(ST.event_stream(s, f"{d}/events.parquet")).select("seq", F.array(F.col("predicted_confidence"), F.coalesce(F.col("z3").cast("double"), F.lit(0.5)), F.coalesce(F.col("oracle").cast("double"), F.lit(0.5)), F.coalesce("magnitude", F.lit(0.5))).alias("features"), "true_confidence", "true_routing", "true_error")
    held = N.OnlineLearner(4)
    ST.online_learning(rows, held, "seq", base)
    loaded = N.OnlineLearner(4, seed=9).load(s, f"{base}/learner")
    same = all((loaded.params[k] == v).all() for k, v in held.params.items())
    few = max(1, len(held.losses) // 10)
    fell = sum(held.losses[-few:]) < sum(held.losses[:few])
    return s.createDataFrame([(loaded.updates, loaded.seen, bool(fell), bool(same))], "updates bigint, n_rows bigint, loss_fell boolean, restored boolean")


# ---- texts and scalars ----------------------------------------------------------------------------


def truncation_loss(s, d):
    """Tokens of each sequence kept and lost at the training length of 2,048."""
    n = X.token_estimate(F.col("text"))
    return docs(s, d).select("doc_id", F.least(n, F.lit(2048)).alias("kept"), F.greatest(n - 2048, F.lit(0)).alias("lost"))


def oracle_messages(s, d):
    rows = load(s, d, "sft_examples")
    return rows.select("row_id", md5(X.oracle_message(F.col("user_prompt"), F.when(F.col("row_id") % 3 > 0, F.col("assistant_response")), F.col("row_id") % 6)).alias("message_md5"))


def original_signals(s, d):
    rows = load(s, d, "sft_examples").filter("assistant_response is not null")
    return rows.select("row_id", *[F.round(c.cast("double"), 6).alias(n) for n, c in S.original_signals(F.col("assistant_response")).items()])


def belnap_predicates(s, d):
    return s.range(4).select(F.col("id").cast("int").alias("a")).select("a", *[c.alias(n) for n, c in S.belnap_predicates(F.col("a")).items()])


def example_checks(s, d):
    rows = load(s, d, "sft_examples")
    return rows.select("row_id", *[c.alias(n) for n, c in S.example_checks(F.col("example_type"), F.col("assistant_response")).items()])


def space_statistics(s, d):
    return G.space_stats(G.theory_table(s), L.DIMENSIONS)


# ---- store, verifiers, cascade --------------------------------------------------------------------


def axiom_records(s, d):
    return K.axioms(E._store(s, d)).select("record_id")


def seeded_chain(s, d):
    """The seed axioms chained in their order."""
    return K.hash_chain(K.axioms(K.seeded_store(s)), ["seq"], "own").select("n", "own", "chained")


def solver_portfolio(s, d):
    first = F.when(F.col("item_id") % 3 == 0, "unsat").when(F.col("item_id") % 3 == 1, "unknown").otherwise("timeout")
    second = F.when(F.col("item_id") % 4 == 0, "sat").when(F.col("item_id") % 4 == 1, "timeout")
    return items(s, d).select("item_id", V.portfolio(first, second).alias("verdict"))


def unsat_cores(s, d):
    out = F.concat(F.lit("unsat\ncore: [a"), F.col("item_id").cast("string"), F.lit(", b]"))
    status = F.when(F.col("item_id") % 2 == 0, "unsat").otherwise("sat")
    return items(s, d).select("item_id", F.array_join(V.unsat_core(out, status), "+").alias("core"))


def joined_subclaims(s, d):
    words = items(s, d).select(F.col("item_id").alias("claim_id"), F.posexplode(F.slice(F.split("q", " "), 1, 3)).alias("at", "claim"))
    return V.joined_subclaims(words.withColumn("status", F.when((F.col("claim_id") % 4 == 0) & (F.col("at") == 1), "timeout").otherwise("verified")))


def _verify(s, d):
    asked = items(s, d).filter("item_id % 3 = 0").select(F.col("item_id").alias("claim_id"), F.col("q").alias("claim"))
    store = E._store(s, d).withColumn("record_id", F.concat(F.lit("r"), F.col("record_id").cast("string")))
    encode = lambda xs: [f"```python\ns.add({len(x.split(chr(10) + '---' + chr(10))[0])})\n```" for x in xs]
    solve = lambda xs: ["unsat" if int(x.split("(")[1].split(")")[0]) % 2 else "timeout" for x in xs]
    return V.verify_formal(asked, store, encode, solve)


def formal_verdicts(s, d):
    """Claims encoded and solved by stand-ins: odd lengths are unsatisfiable."""
    return _verify(s, d)[0].select("claim_id", "status", "stored", F.col("code").startswith("from z3").alias("imports"))


def formal_records(s, d):
    return _verify(s, d)[1].select("record_id", "status", F.size("depends_on").cast("bigint").alias("n_lemmas"))


def factual_verdicts(s, d):
    claims = items(s, d).select(F.col("item_id").alias("claim_id"), F.col("q").alias("claim"))
    best = Q.corpus_verify(s, d).filter("score >= 20").select("claim_id", F.col("doc_id").alias("source"), F.col("score").alias("passage"))
    return V.verify_factual(claims, best).select("claim_id", "status", "artifact", "stored")


def _answers(s, d):
    queries = items(s, d).select(F.col("item_id").alias("query_id"), F.col("q").alias("query"))

    def generate(xs):
        return [f"done {len(x)} [CONFIDENCE: 0.9]" if x.startswith(("Join", "Answer again")) else x + (" [ORACLE_REQUEST: more]" if len(x) % 5 == 0 else "") for x in xs]

    judge = lambda df: {"confidence": F.when(F.length("query") % 3 == 0, 0.9).when(F.length("query") % 3 == 1, 0.6).otherwise(0.2), "error": F.length("query") % 5}
    return V.answer_queries(queries, generate, judge, lambda xs: [f"told {len(x)}" for x in xs])


def cascade_answers(s, d):
    """The whole query cascade with stand-ins for model, learner and oracle."""
    return _answers(s, d).select("query_id", "route", "passes", F.round("confidence", 6).alias("confidence"), (F.col("final") == F.col("initial")).alias("unchanged"))


def cascade_feedback(s, d):
    return V.cascade_feedback(_answers(s, d)).select("query_id", "oracle", F.round("magnitude", 6).alias("magnitude"))


def repair_statistics(s, d):
    from quillmill.plans import fixture_queries as X_

    return V.repair_stats(X_.repaired_claims(s, d))


# ---- training sets, checks, measures --------------------------------------------------------------


def template_examples(s, d):
    """Template rows made of the examples: types A to G in turn."""
    i = F.col("row_id")
    rows = load(s, d, "sft_examples").select(
        "row_id", F.substring(F.lit("ABCDEFG"), (i % 7).cast("int") + 1, F.lit(1)).alias("type"), F.coalesce("user_prompt", F.lit("?")).alias("user"), F.array(F.lit("one"), F.coalesce("philosopher", F.lit("-"))).alias("key_elements"), F.when(i % 2 == 0, "undercut").alias("attack_type"), F.col("philosopher").alias("target"),
        F.lit("text").alias("passage"), F.col("id").alias("source"), F.array(F.lit("Q1?"), F.lit("Q2?")).alias("questions"), F.when(i % 3 == 0, 0.5).alias("expected_confidence"), F.when(i % 3 == 0, "SELF").when(i % 3 == 1, "ORACLE").otherwise("HYBRID").alias("routing"), F.lit("why").alias("reason"),
        F.when(i % 4 == 0, "sketch").alias("sketch"), F.lit("first").alias("original_answer"), F.lit("second").alias("oracle_response"), F.lit("both").alias("integrated"),
    )
    return T.template_examples(rows).select("row_id", "type", md5(F.col("user")).alias("user_md5"), md5(F.col("assistant")).alias("assistant_md5"))


def corpus_checks(s, d):
    return P.corpus_checks(docs(s, d)).withColumn("value", F.round("value", 6))


def perplexity_gate(s, d):
    rows = load(s, d, "events").select(F.when(F.col("event_id") % 2 == 0, "base").otherwise("tuned").alias("model"), F.when(F.col("user_id") % 2 == 0, "domain").otherwise("general").alias("kind"), (F.col("value") / 50).alias("loss"), F.lit(1).alias("tokens"))
    return B.perplexity_gate(rows).select("kind", *[F.round(c, 6).alias(c) for c in ("base", "tuned", "change")], "ok")


def rubric_hits(s, d):
    rows = load(s, d, "sft_examples").filter("assistant_response is not null and source_passage is not null")
    return rows.select("row_id", S.rubric_hit(F.col("assistant_response"), F.col("source_passage")).alias("hit"))


def search_passages(s, d):
    """The best documents per question with their first 300 characters."""
    found = Q.keyword_search(s, d)
    texts = docs(s, d).select("doc_id", md5(F.substring("text", 1, 300)).alias("passage_md5"))
    return found.join(texts, "doc_id").select("query_id", "rank", "doc_id", "passage_md5")


# ---- arguments ------------------------------------------------------------------------------------


RULES = [("r1", True), ("r2", False), ("r3", True)]
TREES = [("a", "A", ["r1"]), ("b", "B", ["r2", "r9"]), ("c", "C", ["r1", "r3"]), ("d", "D", [])]
PARTS = [("c", "a"), ("c", "b"), ("d", "c")]
PREMISES = [("a", "p"), ("b", "q"), ("b", "p"), ("d", "z")]


def argument_trees(s, d):
    built = G.build_arguments(s.createDataFrame(TREES, "arg_id string, conclusion string, rule_ids array<string>"), s.createDataFrame(RULES, "rule_id string, is_strict boolean"))
    trees = G.argument_trees(built, s.createDataFrame(PARTS, "arg_id string, sub_id string"), s.createDataFrame(PREMISES, "arg_id string, premise string"))
    return trees.join(built.select("arg_id", "top_rule"), "arg_id").select("arg_id", "top_rule", F.array_join("premises", ",").alias("premises"), "is_strict")


LEFT = [("premise", 1, "conceivable"), ("premise", 2, "guarantee"), ("rule", 1, "to_possible"), ("conclusion", 1, "distinct")]
RIGHT = [("premise", 1, "conceivable_twin"), ("rule", 1, "to_possible"), ("rule", 2, "to_failure"), ("conclusion", 1, "not_physical")]


def structural_mapping(s, d):
    schema = "role string, at int, name string"
    return G.structural_mapping(s.createDataFrame(LEFT, schema), s.createDataFrame(RIGHT, schema))


QUERIES = {f.__name__: f for f in (json_roundtrip, written_documents, written_training, written_examples, written_report, appended_records, upserted_store, exported_results, index_header, index_search, extraction_outcomes, archive_hits, search_items, relevant_hits, new_files, first_hits, author_folders, distinct_categories, stream_first_urls, stream_read_through, stream_buffer_triggers, online_learner, truncation_loss, oracle_messages, original_signals, belnap_predicates, example_checks, space_statistics, axiom_records, seeded_chain, solver_portfolio, unsat_cores, joined_subclaims, formal_verdicts, formal_records, factual_verdicts, cascade_answers, cascade_feedback, repair_statistics, template_examples, corpus_checks, perplexity_gate, rubric_hits, search_passages, argument_trees, structural_mapping)}

# ---- oracle ---------------------------------------------------------------------------------------

_HYPHENS = r"regexp_replace(regexp_replace({}, '([\p{{L}}\p{{N}}_])-\n([\p{{L}}\p{{N}}_])', '\1\2', 'g'), '([\p{{L}}\p{{N}}_])- \n([\p{{L}}\p{{N}}_])', '\1\2', 'g')"
_SQUEEZE = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '\n{{4,}}', chr(10) || chr(10) || chr(10), 'g'), ' {{2,}}', ' ', 'g'), '\f', chr(10), 'g'), '[\x00-\x08\x0b\x0e-\x1f]', '', 'g')"
#: Columns l and s: lines of the hyphen-joined text and their stripped forms; then the lines that stay, and these reconnected.
_CLEAN = f"""h AS (SELECT doc_id, text AS raw, string_split({_HYPHENS.format('nfc_normalize(text)')}, chr(10)) AS l FROM documents),
st AS (SELECT *, list_transform(l, lambda x: {SQL_STRIP % 'x'}) AS s FROM h),
few AS (SELECT doc_id, unnest(s) AS line FROM st), often AS (SELECT doc_id, list(line) AS gone FROM (SELECT doc_id, line FROM few WHERE line <> '' AND length(line) < 100 GROUP BY 1, 2 HAVING count(*) > 3) GROUP BY 1),
kept AS (SELECT st.doc_id, raw, list_filter(s, lambda x: gone IS NULL OR NOT list_contains(gone, x)) AS s FROM st LEFT JOIN often USING (doc_id)),
cleaned AS (SELECT doc_id, raw, {SQL_STRIP % _SQUEEZE.format("regexp_replace(replace(array_to_string(s, chr(10)), chr(10), chr(10) || chr(1)), '([^.!?:;" + chr(92) + "n" + chr(92) + "x01])" + chr(92) + "n" + chr(92) + "x01([" + chr(92) + "p{Ll}(" + chr(34) + "''])', '" + chr(92) + "1 " + chr(92) + "2', 'g').replace(chr(1), '')")} AS t FROM kept)"""
_BOOKED = SQL_STRIP % (
    "regexp_replace(regexp_replace(regexp_replace(replace(replace("
    f"regexp_replace(regexp_replace(regexp_replace(replace(replace(text, chr(160), ' '), chr(8203), ''), '\\n{{4,}}', chr(10) || chr(10) || chr(10), 'g'), '\\n[{WS}]*\\d{{1,4}}[{WS}]*\\n', chr(10), 'g'), '\\n[{WS}]*(?:doi|DOI|https?://doi\\.org)[^\\n]*\\n', chr(10), 'g')"
    ", '–', '-'), '—', ' - '), '([a-z])-\\n([a-z])', '\\1\\2', 'g'), '([a-z])-\\n([a-z])', '\\1\\2', 'g'), '  +', ' ', 'g')"
).replace("{{", "{").replace("}}", "}")
_PASSAGES = f"""s AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?])[{WS}]+', '\\1' || chr(1), 'g'), chr(1)) AS l FROM documents WHERE text IS NOT NULL),
sized AS (SELECT doc_id, l, list_transform(l, lambda x: len({SQL_WORDS % 'x'})) AS n FROM s),
sums AS (SELECT doc_id, l, list_transform(range(0, len(l) + 1), lambda k: coalesce(list_sum(n[1:k]), 0)::BIGINT) AS t FROM sized),
cut(doc_id, a, b) AS (
  SELECT doc_id, 0::BIGINT, greatest(1, len(list_filter(t, lambda x: x <= t[1] + 128)) - 1) FROM sums
  UNION ALL
  SELECT doc_id, a2, greatest(b + 1, len(list_filter(t, lambda x: x <= t[a2 + 1] + 128)) - 1) FROM (SELECT cut.doc_id, b, t, greatest(a, len(list_filter(t, lambda x: x < t[b + 1] - 16))) AS a2 FROM cut JOIN sums USING (doc_id) WHERE b < len(l))),
pass AS (SELECT doc_id, a, b, {SQL_STRIP % "array_to_string(l[a + 1:b], ' ')"} AS p FROM cut JOIN sums USING (doc_id))"""
_WORK = " ".join(f"WHEN contains(st, '{k}') THEN CASE WHEN o <> '' THEN '{v}, ' || o ELSE '{v}' END" for k, v in L.WORKS.items())
_FOLDERED = E.SQL_PATH
_PARTS = "string_split(lower(path), '/')"
_INDEXED = " ".join(f"WHEN list_contains({_PARTS}, '{c}') THEN '{c}'" for c in L.INDEX_CATEGORIES)
_ITEMS3 = "(SELECT *, length(q) AS n FROM eval_items WHERE item_id % 3 = 0)"
ORACLE = {
    "json_roundtrip": "SELECT doc_id, lang, n_chars, md5(text) AS text_md5 FROM documents",
    "written_documents": f"SELECT {SQL_KEY} AS category, count(*) AS n_docs, sum(n_chars)::BIGINT AS n_chars FROM documents GROUP BY 1",
    "written_training": f"SELECT split, count(*) AS n, sum(length(text))::BIGINT AS n_chars FROM {Q._CUT} GROUP BY 1",
    "written_examples": "SELECT example_type, count(*) AS n, count(id) AS with_id FROM sft_examples WHERE example_type IN ('A', 'B') GROUP BY 1",
    "written_report": "SELECT lower(string_split(coalesce(author, 'unknown'), ' ')[-1]) AS author, source, count(*) AS n_files, count(duplicate_of) AS n_duplicates FROM manifest_entries GROUP BY 1, 2",
    "appended_records": "SELECT item_id, topic FROM eval_items",
    "upserted_store": "SELECT item_id, CASE WHEN item_id % 3 = 0 THEN 'changed' ELSE topic END AS topic FROM eval_items UNION ALL SELECT item_id + 10000, 'new' FROM eval_items WHERE item_id % 3 = 1",
    "exported_results": "SELECT row_id, round_even(council_agreement, 3) AS confidence, round_even(row_id / 7e6, 6) AS cost FROM sft_examples",
    "index_header": f"SELECT '1.0' AS version, count(*) AS total, string_agg(DISTINCT {SQL_KEY}, ',' ORDER BY {SQL_KEY}) AS categories FROM documents",
    "index_search": Q.ORACLE["keyword_search"],
    "extraction_outcomes": f"SELECT CASE WHEN doc_id % 5 = 0 OR text IS NULL THEN 'unsupported' WHEN length({_BOOKED}) < 100 THEN 'too_short' ELSE 'ok' END AS outcome, count(*) AS n FROM documents GROUP BY 1",
    "archive_hits": "SELECT filename AS identifier, title, author AS creator FROM manifest_entries WHERE entry_id % 3 <> 0",
    "search_items": "SELECT source AS query, entry_id % 5 + 1 AS page, entry_id AS id FROM manifest_entries WHERE entry_id % 5 < 3",
    "relevant_hits": f"SELECT entry_id FROM manifest_entries WHERE coalesce(contains(lower(author), 'quilla') OR contains(lower(author), 'draumont'), false) OR coalesce({E._ANY('lower(title)', L.TITLE_KEYWORDS)} OR contains(lower(title), 'quilla') OR contains(lower(title), 'draumont'), false)",
    "new_files": "WITH k AS (SELECT *, substr(trim(regexp_replace(regexp_replace(regexp_replace(lower(string_split(filename, '/')[-1]), '\\.[^.]*$', ''), '\\s*-\\s*libgen\\.\\w+$', ''), '[_\\-\\s]+', ' ', 'g')), 1, 40) AS k FROM manifest_entries) SELECT entry_id FROM k WHERE k IS NULL OR k NOT IN (SELECT k FROM k WHERE k IS NOT NULL AND file_size IS NOT NULL AND entry_id % 2 = 0)",
    "first_hits": "SELECT url, min(entry_id) AS entry_id, arg_min(title, entry_id) AS title FROM manifest_entries GROUP BY 1",
    "author_folders": "SELECT " + "CASE " + " ".join(f"WHEN contains(lower(author), '{k}') THEN '{v}'" for k, v in FOLDERS.items()) + " ELSE 'other' END AS folder, count(*) AS n FROM manifest_entries GROUP BY 1",
    "distinct_categories": f"SELECT string_agg(DISTINCT {SQL_KEY}, ',' ORDER BY {SQL_KEY}) AS categories FROM documents",
    "stream_first_urls": "SELECT DISTINCT url FROM manifest_entries WHERE url IS NOT NULL",
    "stream_read_through": "SELECT item_id AS record_id, length(q) AS n FROM eval_items",
    "stream_buffer_triggers": "SELECT user_id, count(*) AS n_rows, CASE WHEN count(*) < 32 THEN 0 WHEN count(*) <= 64 THEN (count(*) - 32) // 8 + 1 ELSE 5 + count(*) - 64 END AS n_triggers FROM events GROUP BY 1",
    "online_learner": "SELECT (count(*) - 32) // 8 + 1 AS updates, count(*) AS n_rows, true AS loss_fell, true AS restored FROM events",
    "truncation_loss": f"SELECT doc_id, least({SQL_TOKENS}, 2048) AS kept, greatest({SQL_TOKENS} - 2048, 0) AS lost FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)",
    "oracle_messages": "SELECT row_id, md5(CASE WHEN row_id % 3 > 0 AND coalesce(assistant_response, '') <> '' THEN 'CONTEXT:' || chr(10) || assistant_response || chr(10) || chr(10) || 'QUESTION:' || chr(10) || user_prompt ELSE user_prompt END || CASE row_id % 6 WHEN 1 THEN chr(10) || chr(10) || 'NOTE: this was marked as a factual gap issue.' WHEN 2 THEN chr(10) || chr(10) || 'NOTE: this was marked as a reasoning error issue.' WHEN 3 THEN chr(10) || chr(10) || 'NOTE: this was marked as a formalization error issue.' WHEN 4 THEN chr(10) || chr(10) || 'NOTE: this was marked as a scope exceeded issue.' ELSE '' END) AS message_md5 FROM sft_examples",
    "original_signals": f"WITH x AS (SELECT row_id, lower(assistant_response) AS t, {SQL_WORDS % 'lower(assistant_response)'} AS w FROM sft_examples WHERE assistant_response IS NOT NULL) SELECT row_id, ({E._PRESENT('t', L.ORIGINAL_HEDGES)})::DOUBLE AS hedges, round(CASE WHEN len(w) >= 20 THEN 1 - len(list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))))::DOUBLE / (len(w) - 3) ELSE 0 END, 6) AS repetition, len(w)::DOUBLE AS words FROM x",
    "belnap_predicates": "SELECT a::INT AS a, a IN (2, 3) AS is_true, a IN (1, 3) AS is_false, a = 3 AS is_both, a = 0 AS is_neither FROM range(4) AS t(a)",
    "example_checks": "SELECT row_id, coalesce(example_type = 'A' AND contains(lower(assistant_response), 'valid') AND contains(lower(assistant_response), 'premise') AND contains(lower(assistant_response), 'conclusion'), false) AS reconstructs, coalesce(example_type = 'B' AND contains(lower(assistant_response), 'objection') AND contains(lower(assistant_response), 'defense'), false) AS objects, true AS ok FROM sft_examples",
    "space_statistics": f"SELECT {len(L.THEORIES)} AS theories, {len(L.DIMENSIONS)} AS dimensions, '{', '.join(L.DIMENSIONS)}' AS names",
    "axiom_records": "SELECT item_id AS record_id FROM eval_items WHERE item_id % 4 = 0 AND item_id % 5 <> 0 AND item_id % 7 <> 0 AND item_id % 3 <> 0",
    "seeded_chain": f"WITH RECURSIVE r AS (SELECT i, substr(sha256(c || '||' || 'verified'), 1, 16) AS own FROM (VALUES {', '.join(f'({i}, {E._Q(c)})' for i, (_, c, st, t, _p) in enumerate((x for x in K.SEEDS if x[2] == 'verified' and x[3] == 1), 1))}) AS t(i, c)), ch(n, own, chained) AS (SELECT 1, own, substr(sha256('|' || own), 1, 16) FROM r WHERE i = 1 UNION ALL SELECT n + 1, r.own, substr(sha256(chained || '|' || r.own), 1, 16) FROM ch JOIN r ON r.i = n + 1) SELECT n::BIGINT AS n, own, chained FROM ch",
    "solver_portfolio": "SELECT item_id, CASE WHEN item_id % 4 > 1 THEN CASE item_id % 3 WHEN 0 THEN 'unsat' WHEN 1 THEN 'unknown' ELSE 'timeout' END WHEN item_id % 3 = 0 THEN 'unsat' WHEN item_id % 4 = 0 THEN 'sat' ELSE 'timeout' END AS verdict FROM eval_items",
    "unsat_cores": "SELECT item_id, CASE WHEN item_id % 2 = 0 THEN 'a' || item_id || '+b' ELSE '' END AS core FROM eval_items",
    "joined_subclaims": "SELECT item_id AS claim_id, array_to_string(string_split(q, ' ')[1:3], ' AND ') AS claim, CASE WHEN item_id % 4 = 0 THEN 'timeout' ELSE 'verified' END AS status FROM eval_items WHERE q IS NOT NULL",
    "formal_verdicts": f"SELECT item_id AS claim_id, CASE WHEN n % 2 = 1 THEN 'verified' ELSE 'timeout' END AS status, n % 2 = 1 AS stored, true AS imports FROM {_ITEMS3}",
    "formal_records": f"SELECT 'claim_' || substr(sha256(q), 1, 12) AS record_id, 'verified' AS status, 0::BIGINT AS n_lemmas FROM {_ITEMS3} WHERE n % 2 = 1",
    "factual_verdicts": f"SELECT item_id AS claim_id, CASE WHEN doc_id IS NULL THEN 'not_formalizable' ELSE 'verified' END AS status, coalesce('corpus:' || doc_id || ':' || score, 'no_corpus_match') AS artifact, doc_id IS NOT NULL AS stored FROM eval_items LEFT JOIN (SELECT * FROM ({Q.ORACLE['corpus_verify']}) WHERE score >= 20) ON claim_id = item_id",
    "cascade_answers": "WITH x AS (SELECT item_id, CASE length(q) % 3 WHEN 0 THEN 0.9 WHEN 1 THEN 0.6 ELSE 0.2 END::DOUBLE AS c, length(q) % 5 = 0 AS asks FROM eval_items), r AS (SELECT *, CASE WHEN c >= 0.85 THEN CASE WHEN asks THEN 'HYBRID' ELSE 'SELF' END WHEN c < 0.4 THEN 'ORACLE' ELSE 'HYBRID' END AS route FROM x) SELECT item_id AS query_id, route, CASE WHEN route = 'SELF' THEN 1 ELSE 2 END AS passes, 0.9::DOUBLE AS confidence, route = 'SELF' AS unchanged FROM r",
    "argument_trees": "SELECT * FROM (VALUES ('a', 'r1', 'p', true), ('b', 'r2', 'p,q', false), ('c', 'r3', 'p,q', false), ('d', NULL, 'p,q,z', false)) AS t(arg_id, top_rule, premises, is_strict)",
    "structural_mapping": f"WITH a AS (SELECT * FROM {E._VALUES(LEFT, 'role, at_, name')}), b AS (SELECT * FROM {E._VALUES(RIGHT, 'role, at_, name')}) SELECT coalesce(a.role, b.role) AS role, coalesce(a.at_, b.at_) AS at, a.name AS source, b.name AS target FROM a FULL JOIN b ON a.role = b.role AND a.at_ = b.at_",
    "repair_statistics": "SELECT count(*) FILTER (item_id % 2 = 0) AS attempted, count(*) FILTER (item_id % 2 = 0) AS succeeded, 0::BIGINT AS failed FROM eval_items",
    "template_examples": f"""WITH r AS (SELECT *, 'ABCDEFG'[(row_id % 7 + 1)::INT] AS type, coalesce(user_prompt, '?') AS u, CASE row_id % 3 WHEN 0 THEN 'SELF' WHEN 1 THEN 'ORACLE' ELSE 'HYBRID' END AS routing FROM sft_examples)
SELECT row_id, type, md5(CASE type WHEN 'D' THEN {E._Q("Read this passage from Descartes (")} || coalesce(id, 'N/A') || {E._Q('):' + chr(10) * 2 + '"text"' + chr(10) * 2 + 'Q1?' + chr(10) + 'Q2?')} WHEN 'G' THEN {E._Q(T.INTEGRATION_REQUEST % ('first', 'second'))} ELSE u END) AS user_md5,
md5(CASE type WHEN 'A' THEN printf({E._Q(T.PENDING_RESPONSES['A'])}, '  - one' || chr(10) || '  - ' || coalesce(philosopher, '-')) WHEN 'B' THEN printf({E._Q(T.PENDING_RESPONSES['B'])}, CASE WHEN row_id % 2 = 0 THEN 'undercut' ELSE 'N/A' END, coalesce(philosopher, 'N/A')) WHEN 'C' THEN {E._Q(T.PENDING_RESPONSES['C'])} WHEN 'D' THEN {E._Q(T.PENDING_RESPONSES['D'])}
WHEN 'E' THEN CASE WHEN row_id % 4 = 0 THEN 'sketch' ELSE printf({E._Q(T.PENDING_RESPONSES['E'])}, CASE WHEN row_id % 3 = 0 THEN '0.5' ELSE 'N/A' END, routing, 'why', '0.5') END
WHEN 'F' THEN CASE routing WHEN 'SELF' THEN printf({E._Q(T.PENDING_RESPONSES['SELF'])}, 'why') WHEN 'ORACLE' THEN printf({E._Q(T.PENDING_RESPONSES['ORACLE'])}, 'why', u) ELSE printf({E._Q(T.PENDING_RESPONSES['HYBRID'])}, 'why', u) END ELSE 'both' END) AS assistant_md5 FROM r""",
    "corpus_checks": f"WITH t AS (SELECT coalesce(text, '') AS text, {SQL_KEY} AS k FROM documents), v AS (SELECT 'documents' AS \"check\", count(*)::DOUBLE AS value, 50.0 AS threshold FROM t UNION ALL SELECT 'tokens', sum({SQL_TOKENS}), 1 FROM t UNION ALL SELECT 'diacritics', count(*) FILTER (regexp_matches(text, '[éèêëàâùûüîïôöçñ]')), 1 FROM t UNION ALL SELECT 'content', avg((length({SQL_STRIP % 'text'}) >= 50)::INT), 0.9 FROM t " + " ".join(f"UNION ALL SELECT 'category {c}', count(*) FILTER (k = '{c}'), 1 FROM t" for c in L.MIXING_TARGETS) + ") SELECT \"check\", round(value, 6) AS value, threshold::DOUBLE AS threshold, value >= threshold AS ok FROM v",
    "perplexity_gate": "WITH p AS (SELECT event_id % 2 AS m, CASE WHEN user_id % 2 = 0 THEN 'domain' ELSE 'general' END AS kind, exp(sum(value / 50) / count(*)) AS p FROM events GROUP BY 1, 2), b AS (SELECT kind, max(p) FILTER (m = 0) AS base, max(p) FILTER (m = 1) AS tuned FROM p GROUP BY 1) SELECT kind, round(base, 6) AS base, round(tuned, 6) AS tuned, round((tuned - base) / base, 6) AS change, CASE WHEN kind = 'domain' THEN tuned < base ELSE (tuned - base) / base <= 0.1 END AS ok FROM b",
    "rubric_hits": f"SELECT row_id, len(list_filter(w, lambda x: length(x) > 3 AND contains(lower(assistant_response), x))) >= 0.4 * len(w) AS hit FROM (SELECT row_id, assistant_response, {SQL_WORDS % 'lower(source_passage)'} AS w FROM sft_examples WHERE assistant_response IS NOT NULL AND source_passage IS NOT NULL)",
    "search_passages": f"SELECT query_id, rank, doc_id, md5(substr(text, 1, 300)) AS passage_md5 FROM ({Q.ORACLE['keyword_search']}) JOIN documents USING (doc_id)",
    # for queries of other modules
    "source_citations": f"WITH p AS (SELECT entry_id, {_FOLDERED} AS path FROM manifest_entries), x AS (SELECT *, regexp_replace(lower(string_split(path, '/')[-1]), '\\.[^.]*$', '') AS st FROM p), y AS (SELECT *, regexp_extract(st, '(first|second|third|fourth|fifth|sixth|[ivx]+|[1-6])', 1) AS o, replace(replace(st, '-', ' '), '_', ' ') AS plain, coalesce(list_filter({_PARTS}, lambda z: list_contains({sql_list(L.INDEX_CATEGORIES)}, z))[1], 'unknown') AS c FROM x) SELECT entry_id, CASE {_WORK} WHEN contains(lower(path), 'sep') THEN 'SEP: ' || array_to_string(list_transform(string_split(plain, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') WHEN contains(lower(path), 'arxiv') THEN 'arXiv: ' || st ELSE c || ': ' || plain END AS citation, CASE {_INDEXED} WHEN list_contains({_PARTS}, 'sep') THEN 'philosophy_of_mind' WHEN list_contains({_PARTS}, 'arxiv') THEN 'cross_disciplinary' ELSE 'unknown' END AS category FROM y",
    "prompts": "SELECT row_id, md5(CASE row_id % 6 WHEN 1 THEN 'Check the facts.' || chr(10) || 'Question: ' || coalesce(user_prompt, 'null') || chr(10) || 'Draft: ' || coalesce(substr(assistant_response, 1, 500), 'null') WHEN 2 THEN 'Check the reasoning.' || chr(10) || 'Question: ' || coalesce(user_prompt, 'null') || chr(10) || 'Draft: ' || coalesce(substr(assistant_response, 1, 500), 'null') WHEN 3 THEN 'Check the formalization.' || chr(10) || 'Question: ' || coalesce(user_prompt, 'null') || chr(10) || 'Draft: ' || coalesce(substr(assistant_response, 1, 500), 'null') WHEN 4 THEN 'Answer the question.' || chr(10) || 'Question: ' || coalesce(user_prompt, 'null') ELSE 'Review the draft.' || chr(10) || 'Question: ' || coalesce(user_prompt, 'null') || chr(10) || 'Draft: ' || coalesce(substr(assistant_response, 1, 500), 'null') END) AS prompt_md5, concat_ws(chr(10), '- ' || example_type, 'Unsat core: ' || id, 'Suggestion: ' || philosopher) AS f FROM sft_examples",
    "nudged_latest": f"WITH {E._FB}, m AS (SELECT max(seq) AS last FROM fb), x AS (SELECT CASE WHEN seq = last THEN greatest(0.0, least(1.0, true_confidence - 0.3)) ELSE true_confidence END AS c, CASE WHEN seq = last THEN 3 ELSE true_error END AS e FROM fb, m) SELECT count(*) AS n_formal, round(sum(round(c, 6)), 4) AS total FROM x WHERE e = 3",
    "html_to_text": f"WITH x AS (SELECT doc_id, {SQL_STRIP % "'t' || chr(10) || chr(10) || '## ' || source || chr(10) || chr(10) || replace(regexp_replace(text, '[<>&]', ' ', 'g'), chr(13), '')"} AS t FROM documents) SELECT doc_id, length(t) AS n, md5(t) AS text_md5 FROM x",
    "clean_documents": f"WITH {_CLEAN} SELECT doc_id, length(t) AS n_clean, md5(t) AS text_md5 FROM cleaned",
    "book_clean": f"SELECT doc_id, md5({_BOOKED}) AS text_md5 FROM documents",
    "split_sequences": f"WITH RECURSIVE {Q._FOLDED} SELECT doc_id, chunk_idx, {SQL_TOKENS} AS tokens, md5(text) AS text_md5 FROM seqs",
    "passage_chunks": f"WITH RECURSIVE {_PASSAGES} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY b) - 1 AS chunk_index, md5(p) AS passage_md5 FROM pass WHERE length(p) > 50",
}
