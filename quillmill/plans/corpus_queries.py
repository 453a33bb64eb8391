"""Queries over the corpus and their oracle SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from quillmill.functions import lexicon as L
from quillmill.functions import text as X
from quillmill.operators import corpus as C
from quillmill.operators import dedup as D
from quillmill.plans import pipeline as P
from quillmill.session import broadcast_if_small, load

DOCS = "documents"


def docs(spark, d):
    return load(spark, d, DOCS)


def md5(c):
    return F.md5(c.cast("binary"))


def sql_list(items):
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in items) + "]"


WS = X.WS
SQL_WORDS = f"list_filter(string_split_regex(%s, '[{WS}]+'), lambda x: x <> '')"
SQL_STRIP = f"regexp_replace(%s, '^[{WS}]+|[{WS}]+$', '', 'g')"
SQL_TOKENS = f"floor(len({SQL_WORDS % 'text'}) * 1.3::DOUBLE)::BIGINT"
SQL_KEY = "replace(replace(lower(trim(category)), ' ', '_'), '-', '_')"
# RE2 has no lookbehind: the splits after . ! ? put a sentinel there first
SQL_SENTENCES = f"string_split(regexp_replace(%s, '([.!?])[{WS}]+', '\\1' || chr(1), 'g'), chr(1))"
SQL_DENSITY = f"CASE WHEN len({SQL_WORDS % 'lower(text)'}) < 100 THEN 0.0 ELSE list_sum([(length(lower(text)) - length(replace(lower(text), p, ''))) // length(p) for p in {sql_list(L.ARGUMENT_PHRASES)}])::DOUBLE / len({SQL_WORDS % 'lower(text)'}) * 1000 END"
SQL_FIRST = f"({SQL_KEY} IN ({', '.join(repr(c) for c in L.PRIORITY_CATEGORIES)}))"
SQL_OUTCOME = f"""CASE WHEN coalesce(length(text), 0) < 500 AND NOT (coalesce({SQL_FIRST}, false) AND coalesce(length(text), 0) >= 200) THEN 'too_short' WHEN coalesce({SQL_FIRST}, false) THEN 'priority'
 WHEN ({SQL_DENSITY}) >= CASE WHEN coalesce(contains(lower(source), 'neuroscience'), false) THEN 1.0 ELSE 2.0 END THEN 'dense' ELSE 'sparse' END"""


def doc_token_stats(s, d):
    return docs(s, d).select("doc_id", F.length("text").alias("n_code_points"), X.word_count(F.col("text")).cast("bigint").alias("n_words"), X.token_estimate(F.col("text")).alias("tokens"))


def category_breakdown(s, d):
    return C.breakdown(docs(s, d).withColumn("category", C.category_key(F.col("category"))), "category").withColumn("share", F.round("share", 9))


def source_breakdown(s, d):
    return C.breakdown(docs(s, d), "source").withColumn("share", F.round("share", 9))


def mixing_ratio_check(s, d):
    return C.mixing_check(docs(s, d)).withColumn("actual", F.round("actual", 9))


def repeated_lines(s, d):
    return C.repeated_lines(docs(s, d), 1)


def strip_headers(s, d):
    return docs(s, d).select("doc_id", md5(X.strip_repeated_lines(F.col("text"), 1)).alias("text_md5"))


def dehyphenate(s, d):
    return docs(s, d).select("doc_id", md5(X.dehyphenate(F.col("text"))).alias("text_md5"))


def nfc_text(s, d):
    return docs(s, d).select("doc_id", md5(X.nfc(F.col("text"))).alias("text_md5"))


def reconnect_paragraphs(s, d):
    return docs(s, d).select("doc_id", md5(X.reconnect(F.col("text"))).alias("text_md5"))


def squeeze_text(s, d):
    return docs(s, d).select("doc_id", md5(X.squeeze(F.col("text"))).alias("text_md5"))


def clean_documents(s, d):
    return docs(s, d).select("doc_id", X.clean(F.col("text")).alias("t")).select("doc_id", F.length("t").alias("n_clean"), md5(F.col("t")).alias("text_md5"))


def book_clean(s, d):
    return docs(s, d).select("doc_id", md5(X.book_clean(F.col("text"))).alias("text_md5"))


def diacritics_check(s, d):
    return docs(s, d).groupBy("source").agg(F.max(F.coalesce(F.col("text").rlike("[éèêëàâçîïôùûüäöß]"), F.lit(False))).alias("has_diacritics"))


def argument_density(s, d):
    return docs(s, d).select("doc_id", F.round(X.argument_density(F.col("text"), L.ARGUMENT_PHRASES), 6).alias("density"))


def quality_outcomes(s, d):
    return docs(s, d).select("doc_id", C.quality_outcome(F.col("text"), C.category_key(F.col("category")), F.col("source")).alias("outcome"))


def quality_report(s, d):
    """Flagship: exact copies removed, documents judged, tokens by category and outcome."""
    kept = D.exact_dedup(docs(s, d)).withColumn("outcome", C.quality_outcome(F.col("text"), C.category_key(F.col("category")), F.col("source")))
    return kept.groupBy(C.category_key(F.col("category")).alias("category"), "outcome").agg(F.count("*").alias("n_docs"), F.sum(X.token_estimate(F.col("text"))).alias("tokens"))


def pipeline_counters(s, d):
    raw = docs(s, d)
    unique = D.exact_dedup(raw)
    outcome = C.quality_outcome(F.col("text"), C.category_key(F.col("category")), F.col("source"))
    step = lambda df, name, n: df.agg(F.count("*").alias("n_docs")).select(F.lit(n).alias("step"), F.lit(name).alias("stage"), "n_docs")
    return step(raw, "input", 1).union(step(unique, "after_dedup", 2)).union(step(unique.filter(outcome.isin("priority", "dense")), "after_filter", 3))


def corpus_counters(s, d):
    """Documents left after each stage of `corpus_phases`: cleaned, near duplicates removed, filtered, split."""
    done, _ = P.run_phases(P.corpus_phases(), {"raw": docs(s, d)})
    stages = list(enumerate(("raw", "clean", "dedup", "filter", "split"), 1))
    counts = [done[x].select("doc_id").agg(F.countDistinct("doc_id").alias("n_docs")).select(F.lit(n).alias("step"), F.lit(x).alias("stage"), "n_docs") for n, x in stages if x in done]
    return reduce(lambda a, b: a.union(b), counts)


def exact_dedup(s, d):
    return D.exact_groups(docs(s, d))


def shingle_counts(s, d):
    return docs(s, d).select("doc_id", F.size(D.shingles(F.col("text"))).cast("bigint").alias("n_shingles"))


def minhash_signatures(s, d):
    return D.signatures(docs(s, d), "md5").select("doc_id", F.explode(F.arrays_zip(F.sequence(F.lit(1), F.lit(D.PERMUTATIONS)).alias("i"), F.col("signature").alias("m"))).alias("z")).groupBy("doc_id").agg(F.sum(F.col("z.m") % 1000003 * F.col("z.i")).alias("signature_sum"), F.min("z.m").alias("least"))


def near_duplicates(s, d):
    return D.near_duplicates(docs(s, d), "md5").select("doc_id", "class_id")


def dedup_survivors(s, d):
    raw = docs(s, d)
    return D.survivors(raw, D.near_duplicates(raw, "md5"))


def split_sequences(s, d):
    return C.split_sequences(docs(s, d), SEQUENCE_TOKENS).select("doc_id", F.col("chunk_idx").cast("bigint").alias("chunk_idx"), "tokens", md5(F.col("text")).alias("text_md5"))


#: Tokens of a sequence in these queries.
SEQUENCE_TOKENS = 400


def _split(s, d):
    return C.train_val(C.split_sequences(docs(s, d), SEQUENCE_TOKENS), ["doc_id", "chunk_idx"])


def train_val_split(s, d):
    return _split(s, d).select("doc_id", F.col("chunk_idx").cast("bigint").alias("chunk_idx"), "split")


def dataset_card(s, d):
    return C.dataset_card(_split(s, d))


def train_categories(s, d):
    return C.train_categories(_split(s, d))


def sentence_split(s, d):
    each = docs(s, d).select("doc_id", X.sentences(F.col("text")).alias("l")).filter("l is not null")
    return each.select("doc_id", F.size("l").cast("bigint").alias("n_sentences"), F.array_max(F.transform("l", lambda x: F.length(x))).alias("longest"))


def passage_chunks(s, d):
    return C.passages(docs(s, d), 128, 16).select("doc_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), md5(F.col("passage")).alias("passage_md5"))


def document_keywords(s, d):
    return C.keywords(docs(s, d), ["doc_id"], "text")


def keyword_search(s, d):
    queries = load(s, d, "eval_items").select(F.col("item_id").alias("query_id"), F.col("q").alias("query"))
    return C.keyword_search(C.keywords(docs(s, d), ["doc_id"], "text"), ["doc_id"], queries)


def _matches(s, d):
    claims = load(s, d, "eval_items").select(F.col("item_id").alias("claim_id"), F.col("q").alias("claim"))
    return C.corpus_matches(docs(s, d), ["doc_id"], "text", claims, best=True)


def corpus_verify(s, d):
    return C.best_match(_matches(s, d), ["doc_id"])


def passage_mining(s, d):
    """Paragraphs of more than 200 characters that mention a name of the query set, the first 50 per name. The texts are
    the examples' prompts with their passages, as the documents name nobody."""
    from pyspark.sql import Window

    rows = load(s, d, "sft_examples")
    names = rows.select(F.col("philosopher").alias("name")).filter("name is not null").distinct()
    first = F.split_part("name", F.lit(" "), F.lit(-1))
    texts = rows.select(F.col("row_id").alias("doc_id"), F.concat_ws(" ", "user_prompt", "source_passage").alias("text"))
    words = texts.select("doc_id", F.posexplode(F.split("text", "\n\n")).alias("pos", "passage")).filter(F.length("passage") > 200).select("doc_id", "pos", "passage", F.explode(F.array_distinct(F.regexp_extract_all("passage", F.lit(r"([A-Z][a-z]+)"), F.lit(1)))).alias("last"))
    found = words.join(broadcast_if_small(names.select("name", first.alias("last"))), "last").filter(F.col("passage").contains(F.col("name")))
    rank = F.row_number().over(Window.partitionBy("name").orderBy("doc_id", "pos"))
    return found.withColumn("rank", rank).filter("rank <= 50").select("name", F.col("rank").cast("bigint").alias("rank"), "doc_id", F.col("pos").cast("bigint").alias("pos"))


QUERIES = {f.__name__: f for f in (doc_token_stats, category_breakdown, source_breakdown, mixing_ratio_check, repeated_lines, strip_headers, dehyphenate, nfc_text, reconnect_paragraphs, squeeze_text, clean_documents, book_clean, diacritics_check, argument_density, quality_outcomes, quality_report, pipeline_counters, corpus_counters, exact_dedup, shingle_counts, minhash_signatures, near_duplicates, dedup_survivors, split_sequences, train_val_split, dataset_card, train_categories, sentence_split, passage_chunks, document_keywords, keyword_search, corpus_verify, passage_mining)}

_LINES = "string_split(text, chr(10))"
_STRIPPED = f"list_transform({_LINES}, lambda l: {SQL_STRIP % 'l'})"
_CATEGORY_SHARE = "round(tokens / greatest(sum(tokens) OVER (), 1), 9) AS share"
_UNIQUE = "(SELECT * FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1)"
# greedy chunks of paragraphs: a running fold per document
_FOLDED = f"""p AS (SELECT doc_id, category, unnest(l) AS p, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, category, CASE WHEN {SQL_TOKENS} > {SEQUENCE_TOKENS} THEN string_split(text, chr(10) || chr(10)) ELSE [text] END AS l FROM documents WHERE length({SQL_STRIP % 'text'}) >= 50)),
n AS (SELECT *, {SQL_TOKENS.replace('text', 'p')} AS t FROM p),
fold(doc_id, i, chunk, used) AS (SELECT doc_id, i, 0, t FROM n WHERE i = 1 UNION ALL SELECT n.doc_id, n.i, fold.chunk + (used + t > {SEQUENCE_TOKENS})::INT, CASE WHEN used + t > {SEQUENCE_TOKENS} THEN t ELSE used + t END FROM fold JOIN n ON n.doc_id = fold.doc_id AND n.i = fold.i + 1),
seqs AS (SELECT doc_id, any_value(category) AS category, chunk::BIGINT AS chunk_idx, string_agg(p, chr(10) || chr(10) ORDER BY i) AS text FROM fold JOIN n USING (doc_id, i) GROUP BY doc_id, chunk)"""
_SEQUENCES = f"(WITH RECURSIVE {_FOLDED} SELECT doc_id, category, chunk_idx, text, {SQL_TOKENS} AS tokens FROM seqs)"
_MARKED = f"(SELECT *, md5('42|' || doc_id || '|' || chunk_idx) AS m, count(*) OVER () AS n FROM {_SEQUENCES})"
_CUT = f"(SELECT *, CASE WHEN row_number() OVER (ORDER BY m, doc_id) <= floor(n * 0.95::DOUBLE) THEN 'train' ELSE 'val' END AS split FROM {_MARKED})"
_A, _B = D.permutations()
_PERM = "(VALUES " + ", ".join(f"({i + 1}, {a}, {b})" for i, (a, b) in enumerate(zip(_A.tolist(), _B.tolist()))) + ") AS perm(i, a, b)"
_SHINGLED = f"""w AS (SELECT doc_id, text, {SQL_WORDS % 'lower(text)'} AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 4)) AS i FROM w WHERE len(w) >= 5))"""
_SIGS = f"""{_SHINGLED},
hashed AS (SELECT doc_id, ('0x' || substr(md5(g), 1, 8))::BIGINT AS h FROM sh),
sig AS (SELECT doc_id, i, min((a * h + b) % {D.PRIME}) AS m FROM hashed, {_PERM} GROUP BY doc_id, i)"""
_TOKENS14 = "list_filter(regexp_extract_all(regexp_replace(lower(text), '[\\x{c0}-\\x{d6}\\x{d8}-\\x{f6}\\x{f8}-\\x{24f}]', '_', 'g'), '\\b([a-z][a-z''\\-]*[a-z]|[a-z])\\b', 1), lambda x: length(x) > 2 AND NOT list_contains(" + sql_list(L.STOPWORDS) + ", x))"
_KEYWORDS = f"""kw AS (SELECT doc_id, unnest(t) AS keyword, generate_subscripts(t, 1) AS pos FROM (SELECT doc_id, {_TOKENS14} AS t FROM documents)),
scored AS (SELECT doc_id, keyword, count(*) * CASE WHEN list_contains({sql_list(L.DOMAIN_TERMS)}, keyword) THEN 3 ELSE 1 END AS score, min(pos) AS first FROM kw GROUP BY doc_id, keyword),
ranked AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, first) AS rank, keyword, score FROM scored QUALIFY rank <= 30)"""
_CLASSES = f"""WITH RECURSIVE {_SIGS},
firsts AS (SELECT min(doc_id) AS doc_id, text FROM documents GROUP BY text),
bands AS (SELECT doc_id, (i - 1) // 8 AS band, string_agg(m, ',' ORDER BY i) AS key FROM sig SEMI JOIN firsts USING (doc_id) GROUP BY 1, 2),
cand AS (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM bands x JOIN bands y ON x.band = y.band AND x.key = y.key AND x.doc_id < y.doc_id),
links AS (SELECT a, b FROM cand JOIN sig s ON s.doc_id = a JOIN sig t ON t.doc_id = b AND t.i = s.i GROUP BY a, b HAVING sum((s.m = t.m)::INT) / 128.0 > 0.8),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(id, c) AS (SELECT doc_id, doc_id FROM firsts UNION SELECT reach.id, both_ways.b FROM reach JOIN both_ways ON reach.c = both_ways.a),
low AS (SELECT id, min(c) AS class_id FROM reach GROUP BY id),
classes AS (SELECT d.doc_id, low.class_id, length(d.text) AS n FROM documents d JOIN firsts f ON f.text = d.text JOIN low ON low.id = f.doc_id)"""
_SQUEEZED = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\n{4,}', chr(10) || chr(10) || chr(10), 'g'), ' {2,}', ' ', 'g'), '\f', chr(10), 'g'), '[\x00-\x08\x0b\x0e-\x1f]', '', 'g')"
ORACLE = {
    "doc_token_stats": f"SELECT doc_id, length(text) AS n_code_points, len({SQL_WORDS % 'text'}) AS n_words, {SQL_TOKENS} AS tokens FROM documents",
    "category_breakdown": f"SELECT category, n_docs, tokens, {_CATEGORY_SHARE} FROM (SELECT {SQL_KEY} AS category, count(*) AS n_docs, sum({SQL_TOKENS})::BIGINT AS tokens FROM documents GROUP BY 1)",
    "source_breakdown": f"SELECT source, n_docs, tokens, {_CATEGORY_SHARE} FROM (SELECT source, count(*) AS n_docs, sum({SQL_TOKENS})::BIGINT AS tokens FROM documents GROUP BY 1)",
    "mixing_ratio_check": f"SELECT category, target, round(coalesce(share, 0), 9) AS actual, abs(coalesce(share, 0) - target) <= 0.05 AS ok FROM (VALUES {', '.join(f'({k!r}, {v}::DOUBLE)' for k, v in L.MIXING_TARGETS.items())}) AS t(category, target) LEFT JOIN (SELECT category, tokens / sum(tokens) OVER () AS share FROM (SELECT {SQL_KEY} AS category, sum({SQL_TOKENS}) AS tokens FROM documents GROUP BY 1)) USING (category)",
    "repeated_lines": f"SELECT doc_id, line, count(*) AS n FROM (SELECT doc_id, unnest({_STRIPPED}) AS line FROM documents) WHERE line <> '' GROUP BY 1, 2 HAVING count(*) > 1",
    "strip_headers": f"SELECT doc_id, md5(array_to_string(list_filter(l, lambda x: length({SQL_STRIP % 'x'}) = 0 OR length({SQL_STRIP % 'x'}) >= 100 OR len(list_filter(s, lambda y: y = {SQL_STRIP % 'x'})) <= 1), chr(10))) AS text_md5 FROM (SELECT doc_id, {_LINES} AS l, {_STRIPPED} AS s FROM documents)",
    "dehyphenate": "SELECT doc_id, md5(regexp_replace(regexp_replace(text, '([\\p{L}\\p{N}_])-\\n([\\p{L}\\p{N}_])', '\\1\\2', 'g'), '([\\p{L}\\p{N}_])- \\n([\\p{L}\\p{N}_])', '\\1\\2', 'g')) AS text_md5 FROM documents",
    "nfc_text": "SELECT doc_id, md5(nfc_normalize(text)) AS text_md5 FROM documents",
    "reconnect_paragraphs": f"SELECT doc_id, md5(regexp_replace(replace(array_to_string({_STRIPPED}, chr(10)), chr(10), chr(10) || chr(1)), '([^.!?:;\\n\\x01])\\n\\x01([\\p{{Ll}}(\"''])', '\\1 \\2', 'g').replace(chr(1), '')) AS text_md5 FROM documents",
    "squeeze_text": f"SELECT doc_id, md5({SQL_STRIP % _SQUEEZED}) AS text_md5 FROM documents",
    "diacritics_check": "SELECT source, max(coalesce(regexp_matches(text, '[éèêëàâçîïôùûüäöß]'), false)) AS has_diacritics FROM documents GROUP BY 1",
    "argument_density": f"SELECT doc_id, round({SQL_DENSITY}, 6) AS density FROM documents",
    "quality_outcomes": f"SELECT doc_id, {SQL_OUTCOME} AS outcome FROM documents",
    "quality_report": f"SELECT {SQL_KEY} AS category, {SQL_OUTCOME} AS outcome, count(*) AS n_docs, sum({SQL_TOKENS})::BIGINT AS tokens FROM {_UNIQUE} GROUP BY ALL",
    "pipeline_counters": f"SELECT 1 AS step, 'input' AS stage, count(*) AS n_docs FROM documents UNION ALL SELECT 2, 'after_dedup', count(*) FROM {_UNIQUE} UNION ALL SELECT 3, 'after_filter', count(*) FROM {_UNIQUE} WHERE ({SQL_OUTCOME}) IN ('priority', 'dense')",
    "exact_dedup": "SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first_id FROM documents",
    "shingle_counts": f"WITH {_SHINGLED} SELECT documents.doc_id, count(g) AS n_shingles FROM documents LEFT JOIN sh USING (doc_id) GROUP BY 1",
    "minhash_signatures": f"WITH {_SIGS} SELECT doc_id, sum(m % 1000003 * i)::BIGINT AS signature_sum, min(m) AS least FROM sig GROUP BY doc_id UNION ALL SELECT doc_id, ({D.EMPTY} % 1000003 * 8256)::BIGINT, {D.EMPTY} FROM documents ANTI JOIN sig USING (doc_id)",
    "near_duplicates": f"{_CLASSES} SELECT doc_id, class_id FROM classes",
    "dedup_survivors": f"{_CLASSES} SELECT class_id, doc_id FROM classes QUALIFY row_number() OVER (PARTITION BY class_id ORDER BY n DESC, doc_id) = 1",
    "train_val_split": f"SELECT doc_id, chunk_idx, split FROM {_CUT}",
    "dataset_card": f"SELECT count(*) FILTER (split = 'train') AS train_sequences, count(*) FILTER (split = 'val') AS val_sequences, sum(tokens) FILTER (split = 'train')::BIGINT AS train_tokens, sum(tokens) FILTER (split = 'val')::BIGINT AS val_tokens, sum(tokens)::BIGINT AS total_tokens FROM {_CUT}",
    "train_categories": f"SELECT category, count(*) AS n FROM {_CUT} WHERE split = 'train' GROUP BY 1",
    "sentence_split": f"SELECT doc_id, len(l) AS n_sentences, list_max(list_transform(l, lambda x: length(x))) AS longest FROM (SELECT doc_id, {SQL_SENTENCES % 'text'} AS l FROM documents)",
    "document_keywords": f"WITH {_KEYWORDS} SELECT * FROM ranked",
    "keyword_search": f"""WITH {_KEYWORDS},
terms AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(q), '\\b([a-z]+)\\b', 1)) AS keyword FROM eval_items),
found AS (SELECT query_id, doc_id, sum(1 + list_contains({sql_list(L.DOMAIN_TERMS)}, keyword)::INT)::BIGINT AS score FROM terms JOIN ranked USING (keyword) WHERE NOT list_contains({sql_list(L.STOPWORDS)}, keyword) GROUP BY 1, 2)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM found QUALIFY rank <= 5""",
    "corpus_verify": f"""WITH kw AS (SELECT item_id AS claim_id, unnest(list_filter(string_split_regex(lower(q), '[{WS}]+'), lambda x: length(x) > 2 AND NOT list_contains({sql_list(L.VERIFIER_STOP)}, x))) AS k FROM eval_items),
hits AS (SELECT claim_id, doc_id, count(*) AS score FROM kw JOIN documents ON contains(lower(text), k) GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT claim_id, doc_id, score FROM hits QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY score DESC, doc_id) = 1""",
    "passage_mining": "WITH names AS (SELECT DISTINCT philosopher AS name FROM sft_examples WHERE philosopher IS NOT NULL), p AS (SELECT doc_id, unnest(l) AS passage, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT row_id AS doc_id, string_split(concat_ws(' ', user_prompt, source_passage), chr(10) || chr(10)) AS l FROM sft_examples)) SELECT name, row_number() OVER (PARTITION BY name ORDER BY doc_id, pos) AS rank, doc_id, pos FROM p JOIN names ON contains(passage, name) WHERE length(passage) > 200 QUALIFY rank <= 50",
}
