"""Operators against brute force, hand-worked rows and edge cases."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from quillmill.functions import scalars as S
from quillmill.operators import cascade, claims, corpus, dedup, feedback, learner, logic, manifest
from quillmill.plans import pipeline
from quillmill.sources import files


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def test_near_duplicates_brute_force(spark):
    rng = random.Random(3)
    base = [" ".join(rng.choice("alpha beta gamma delta mind body soul cause".split()) + str(rng.randint(0, 60)) for _ in range(80)) for _ in range(12)]
    rows = []
    for i, t in enumerate(base):
        rows += [(10 * i + 1, t), (10 * i + 2, t), (10 * i + 3, t + " tail"), (10 * i + 4, t.replace(t.split()[40], "changed", 1))]
    rows += [(900, None), (901, ""), (902, "a b"), (903, "a b"), (904, None)]
    got = {r.doc_id: r.class_id for r in dedup.near_duplicates(docs(spark, rows)).collect()}
    signed = {i: dedup.signature(t) for i, t in rows}
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    text = dict(rows)
    for a, b in itertools.combinations(parent, 2):
        same = text[a] is not None and text[a] == text[b]
        bands = any(signed[a][8 * k : 8 * k + 8] == signed[b][8 * k : 8 * k + 8] for k in range(16)) and signed[a][0] != dedup.EMPTY
        if same or bands and sum(x == y for x, y in zip(signed[a], signed[b])) / 128 > 0.8:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    assert got == {i: find(i) for i in parent}
    assert got[900] == 900 and got[904] == 904 and got[903] == 902


def _classes(ids, pairs):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("rounds,block,split", [(3, 4000, 4000), (1, 40, 10_000), (1, 40, 50)])
def test_hot_mixed_bucket(spark, rounds, block, split):
    """All documents share a band but most are unlike: pivots, blocks and split buckets find the same classes as all pairs."""
    rng = random.Random(2)
    rows, n = [], 0
    for _ in range(60):
        base = [rng.randint(0, 10**6) for _ in range(128)]
        for _ in range(rng.choice([1, 1, 1, 2, 5])):
            s = [x if rng.random() > 0.1 else rng.randint(0, 10**6) for x in base]
            s[:8] = range(8)
            rows.append((n, s))
            n += 1
    got = dedup.near_links(spark.createDataFrame(rows, "doc_id bigint, signature array<bigint>"), rounds=rounds, block=block, split=split).collect()
    near = [(a, b) for (a, s), (b, t) in itertools.combinations(rows, 2) if sum(x == y for x, y in zip(s, t)) / 128 > 0.8]
    assert near and {(r.a, r.b) for r in got} <= set(near)
    assert _classes(range(n), [(r.a, r.b) for r in got]) == _classes(range(n), near)


def test_near_duplicates_recall(spark):
    """Pairs of distinct texts with exact Jaccard 0.85 or more on five words end in one class."""
    from quillmill.session import load

    rows = load(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text").filter("text is not null")
    found = {r.doc_id: r.class_id for r in dedup.near_duplicates(rows).collect()}
    sets = {}
    for r in rows.collect():
        w = r.text.lower().split()
        sets[r.doc_id] = {" ".join(w[i : i + 5]) for i in range(len(w) - 4)}
    where = {}
    for i, s in sets.items():
        for g in s:
            where.setdefault(g, []).append(i)
    pairs = {p for ids in where.values() if len(ids) < 60 for p in itertools.combinations(ids, 2)}
    alike = [(a, b) for a, b in pairs if len(sets[a] & sets[b]) >= 0.85 * len(sets[a] | sets[b])]
    assert alike and sum(found[a] == found[b] for a, b in alike) >= 0.95 * len(alike)


def test_components_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101)], "a bigint, b bigint")
    got = {r.id: r.class_id for r in dedup.components(links).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100}


def test_survivors(spark):
    rows = docs(spark, [(1, "aa"), (2, "aaa"), (3, "bbb"), (4, None)])
    classes = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 4)], "doc_id bigint, class_id bigint")
    assert sorted(r.doc_id for r in dedup.survivors(rows, classes).collect()) == [2, 4]


def test_chunk_bounds():
    assert corpus.chunk_bounds([3, 3, 3, 3], 6, 0) == [(0, 2), (2, 4)]
    assert corpus.chunk_bounds([3, 3, 3, 3], 6, 3) == [(0, 2), (1, 3), (2, 4)]
    assert corpus.chunk_bounds([9, 1, 9], 5, 1) == [(0, 1), (1, 2), (1, 3)]  # a long sentence is a chunk, shared ones come before
    assert corpus.chunk_bounds([], 5, 1) == []
    long, short = " ".join(["word"] * 12) + ".", "Short one here is now, of nine words all."
    assert corpus.sentence_chunks(f"{long} {short} {long}", 21, 9) == [f"{long} {short}", f"{short} {long}"]
    assert corpus.sentence_chunks(None) == corpus.sentence_chunks("") == corpus.sentence_chunks("Too short.") == []
    rng = random.Random(5)
    for _ in range(50):
        sizes = [rng.randint(0, 9) for _ in range(rng.randint(1, 30))]
        bounds = corpus.chunk_bounds(sizes, 15, 4)
        assert bounds[0][0] == 0 and bounds[-1][1] == len(sizes)
        for (a, b), (c, e) in zip(bounds, bounds[1:]):
            assert a <= c <= b < e and sum(sizes[c:b]) <= 4
        assert all(sum(sizes[a:b]) <= 15 or b - max(a, p) == 1 for (a, b), p in zip(bounds, [0, *(b for _, b in bounds)]))


def test_paragraph_chunks(spark):
    text = "a b c\n\nd e\n\n" + "w " * 30 + "\n\nf"
    rows = spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, text string")
    got = {r.id: r.c for r in rows.select("id", corpus.paragraph_chunks(F.col("text"), 6).alias("c")).collect()}
    assert got == {1: ["a b c\n\nd e", "w " * 30, "f"], 2: None, 3: [""]}


def test_train_val_exact(spark):
    rows = spark.range(1000).selectExpr("id as doc_id")
    got = corpus.train_val(rows, ["doc_id"], 0.95)
    assert got.filter("split = 'train'").count() == 950 and got.count() == 1000
    for share, n in ((0.0, 0), (1.0, 1000)):
        assert corpus.train_val(rows, ["doc_id"], share).filter("split = 'train'").count() == n
    assert corpus.train_val(rows.limit(0), ["doc_id"]).count() == 0


def test_shared_dir_on_cluster():
    from types import SimpleNamespace

    from quillmill import session

    far = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None))
    with pytest.raises(ValueError):
        session.shared_dir(far)


def test_empty_tables(spark):
    none = docs(spark, [])
    assert dedup.near_duplicates(none).count() == 0
    assert corpus.repeated_lines(none).count() == 0


def test_paragraph_chunks(spark):
    t = "\n\n".join(["w " * 10, "w " * 10, "w " * 100, "w " * 5])
    got = spark.createDataFrame([(t,)], "t string").select(corpus.paragraph_chunks(F.col("t"), 30).alias("c")).first().c
    assert "\n\n".join(got) == t and [len(x.split()) for x in got] == [20, 100, 5]


def test_sentence_chunks():
    t = " ".join(f"Sentence number {i} has words." for i in range(60))
    got = corpus.sentence_chunks(t, 50, 10)
    assert all(len(c.split()) <= 60 for c in got) and got[0].split()[-5:] == got[1].split()[:10][-5:]
    assert corpus.sentence_chunks(None) == [] and corpus.sentence_chunks("tiny") == []


def test_train_val_counts(spark):
    rows = spark.range(1000).select(F.col("id").alias("k"))
    for n in (1, 4, 16):
        got = corpus.train_val(rows.repartition(n), ["k"])
        assert {r.split: r["count"] for r in got.groupBy("split").count().collect()} == {"train": 950, "val": 50}


def test_containments(spark):
    rng = random.Random(1)
    keys = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 14))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(keys)), "id bigint, key string")
    got = {(r.a_id, r.b_id) for r in manifest.containments(df, df).collect()}
    assert got == {(i, j) for i, a in enumerate(keys) for j, b in enumerate(keys) if a in b}


def test_store_lookup(spark):
    words = "mind body soul cause thought space time form".split()
    rng = random.Random(5)
    stored = [(i, i, " ".join(rng.sample(words, rng.randint(2, 8)))) for i in range(40)]
    asked = [(i, " ".join(rng.sample(words, rng.randint(1, 8)))) for i in range(40)] + [(99, None)]
    got = {r.q: r.record_id for r in claims.store_lookup(spark.createDataFrame(asked, "q bigint, claim string"), "q", spark.createDataFrame(stored, "record_id bigint, seq bigint, claim_text string")).collect()}
    for q, c in asked:
        want = None
        if c is not None:
            want = next((i for i, _, t in stored if t == c), None)
            if want is None:
                a = set(c.split())
                want = next((i for i, _, t in stored if len(a & set(t.split())) / len(a | set(t.split())) > 0.75), None)
        assert got[q] == want, (q, c)


def test_invalidate_cycle(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5)], "record_id bigint, used_by bigint")
    start = spark.createDataFrame([(1,)], "record_id bigint")
    assert sorted(r.record_id for r in claims.invalidate(edges, start).collect()) == [1, 2, 3]


@pytest.mark.parametrize("attacks,want", [([("a", "b"), ("b", "c")], {"a", "c"}), ([("a", "b"), ("b", "a")], {"c"}), ([], {"a", "b", "c"})])
def test_grounded(spark, attacks, want):
    args = spark.createDataFrame([("a",), ("b",), ("c",)], "arg_id string")
    assert {r.arg_id for r in logic.grounded(args, spark.createDataFrame(attacks, "attacker string, target string")).collect()} == want


def test_calibration(spark):
    rows = spark.createDataFrame([(0.95, True), (0.95, False)], "c double, ok boolean")
    assert feedback.calibration_error(rows, "c", "ok").first().ece == pytest.approx(0.4)


def test_convergence_empty(spark):
    rows = spark.createDataFrame([], "seq bigint, predicted_confidence double, true_confidence double, predicted_routing string, true_routing int")
    assert feedback.convergence(rows, "seq").count() == 0


def test_html():
    assert files.page_text("<h1>T</h1><p>a<b>b</b><nav>x<p></nav>c") == "## T\n\nab\n\nc"
    assert files.page_text("<head>x</head><li>y</li>", "book") == "- y"
    assert files.page_text(None) is None


def test_page_blocks(spark):
    blocks = [(0.0, 10.0, "Head"), (0.0, 300.0, "Body"), (5.0, 200.0, "First"), (0.0, 780.0, "note"), (0.0, 790.0, "12"), (0.0, 400.0, "17"), (0.0, 410.0, "doi:1")]
    row = spark.createDataFrame([(blocks, 800.0)], "b array<struct<x:double,y:double,text:string>>, h double").select(files.page_blocks(F.col("b"), F.col("h")).alias("t")).first()
    assert row.t == "First\n\nBody\n\n[FOOTNOTE: note]"


def test_extract_tree(spark, tmp_path):
    (tmp_path / "cat").mkdir()
    (tmp_path / "cat" / "a.txt").write_text("word " * 40)
    (tmp_path / "cat" / "b.html").write_text("<p>" + "word " * 40 + "</p>")
    (tmp_path / "cat" / "c.bin").write_bytes(b"x")
    got = files.extract(files.raw_tree(spark, f"file://{tmp_path}"))
    assert {r.outcome: r.n for r in files.extraction_metrics(got).collect()} == {"ok": 2, "unsupported": 1}
    assert {r.category for r in got.collect()} == {"cat"}


def test_fetch_retry():
    from quillmill.sources.fetch import get_with_retry

    answers, waits = iter([(429, b""), (500, b""), (200, b"ok")]), []
    assert get_with_retry(lambda u: next(answers), "u", sleep=waits.append) == (200, b"ok") and waits == [5, 2]


def test_generate_verify(spark):
    queries = spark.createDataFrame([(1, "good"), (2, "bad")], "query_id bigint, query string")
    got = cascade.generate_verify(queries, lambda xs: [x.split("\n")[0] for x in xs], lambda xs: ["unsat" if x == "good" else "sat" for x in xs])
    assert {r.query_id: (r.status, r.attempt) for r in got.collect()} == {1: ("verified", 1), 2: ("refuted", 3)}


def test_learner(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.normal(size=(64, 11))
    y = (x[:, 0] > 0).astype(int)
    p = learner.init()
    losses = [learner.train_step(p, x, y.astype(float), y, y, 0.1) for _ in range(200)]
    assert losses[-1] < 0.5 * losses[0]
    rows = spark.createDataFrame([([float(v) for v in x[0]],), (None,)], "f array<double>").select(learner.predict(F.col("f"), p).alias("o")).collect()
    assert rows[0].o.routing in learner.ROUTES and (rows[1].o is None or rows[1].o.routing is None)


def test_corpus_verify_two_keywords(spark, tmp_path):
    from quillmill.plans import catalog

    texts = ["Doubt is a method.", "Doubt needs a thinker.", "A thinker with doubt and cause.", None]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts, 1)], "doc_id bigint, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    claims = [(1, "the thinker and doubt"), (2, "doubt alone"), (3, "cause of doubt thinker"), (4, None)]
    spark.createDataFrame(claims, "item_id bigint, q string").write.parquet(f"{tmp_path}/eval_items.parquet")
    got = catalog.QUERIES["corpus_verify"](spark, str(tmp_path)).collect()
    assert {r.claim_id: (r.doc_id, r.score) for r in got} == {1: (2, 2), 3: (3, 3)} and len(got) == 2


def test_corpus_counters(spark, tmp_path):
    from quillmill.plans import catalog

    body = " ".join(f"therefore the mind{i} is one" for i in range(60))
    texts = [body, body.replace(" is", "  is"), body + " again", "cogito therefore sum " * 60, "short"]
    rows = [(i, t, "descartes_primary", "s") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string, category string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.stage: r.n_docs for r in catalog.QUERIES["corpus_counters"](spark, str(tmp_path)).collect()}
    assert got == {"raw": 5, "clean": 5, "dedup": 3, "filter": 2, "split": 2}


def test_phases(spark):
    assert pipeline.parse_phases("1-4") == [1, 2, 3, 4] and pipeline.parse_phases("3") == [3] and pipeline.parse_phases("corpus") == [1, 2, 3, 4]
    raw = spark.createDataFrame([(i, f"cogito therefore mind{i} " * 60, "descartes_primary", "s") for i in range(5)], "doc_id bigint, text string, category string, source string")
    done, ok = pipeline.run_phases(pipeline.corpus_phases(), {"raw": raw})
    assert all(ok.values()) and done["split"].count() == 5


def test_knn_brute_force(spark):
    rng = random.Random(2)
    vecs = [(i, [rng.random() for _ in range(4)]) for i in range(50)]
    rows = spark.createDataFrame(vecs, "vec_id bigint, embedding array<double>")
    got = {(r.query_id, r.rank): r.vec_id for r in logic.nearest(rows.filter("vec_id % 10 = 0").withColumnRenamed("vec_id", "query_id"), rows, 3).collect()}
    for q, v in vecs[::10]:
        want = sorted((sum((a - b) ** 2 for a, b in zip(v, w)), i) for i, w in vecs if i != q)[:3]
        assert [got[q, k] for k in (1, 2, 3)] == [i for _, i in want]


def test_pick_file(spark):
    fs = [("a_Metadata.txt", 5000), ("x_djvu.txt", 10), ("b.pdf", 20000)]
    row = spark.createDataFrame([(fs,)], "f array<struct<name:string,size:bigint>>").select(manifest.pick_file(F.col("f")).alias("n")).first()
    assert row.n == "x_djvu.txt"


def test_verdict_order(spark):
    got = spark.createDataFrame([("unsat",), ("sat",), ("timeout",), ("?",)], "o string").select(S.verdict_status(F.col("o")).alias("s")).collect()
    assert [r.s for r in got] == ["verified", "refuted", "timeout", "not_formalizable"]


# ---- one hot key of 10,000 rows each ---------------------------------------------------------------


def test_hot_words_in_lemmas(spark):
    rows = [(i, f"the mind {['is', 'was', 'holds'][i % 3]} here", i % 4 + 1, "verified") for i in range(2000)] + [(5000, None, 1, "verified"), (5001, "the mind", 1, "refuted")]
    store = spark.createDataFrame(rows, "record_id bigint, claim_text string, tier int, status string")
    asked = spark.range(10_000).selectExpr("id as claim_id", "if(id = 7, null, 'The MIND is what it is') as claim")
    got = claims.lemma_candidates(asked, "claim_id", store, block=300).filter("claim_id in (3, 7)").orderBy("claim_id", "rank").collect()
    brute = sorted((t, -len({"the", "mind", "is", "what", "it"} & set(c.split())), i) for i, c, t, st in rows if st == "verified" and c)
    assert [(r.claim_id, r.rank, r.record_id, r.shared) for r in got] == [(3, k + 1, i, -n) for k, (_, n, i) in enumerate(brute[:5])]
    assert claims.lemma_candidates(asked.limit(0), "claim_id", store).count() == claims.lemma_candidates(asked, "claim_id", store.limit(0)).count() == 0


def test_hot_chain(spark):
    import hashlib

    records = spark.range(10_000).selectExpr("id as seq", "if(id = 50, null, concat('h', id % 7)) as own", "if(id % 10 = 0, 'b', 'a') as c")
    got = {(r.chain, r.n): r.chained for r in claims.hash_chain(records, ["seq"], "own", "c").collect()}
    last, n = "", 0
    for i in range(10_000):
        if i % 10 == 0:
            n += 1
            own = None if i == 50 else f"h{i % 7}"
            want = None if own is None else hashlib.sha256(f"{last}|{own}".encode()).hexdigest()[:16]
            assert got["b", n] == want
            last = want or ""
    assert len(got) == 10_000


def test_hot_vectors(spark):
    """A third of all vectors are copies, and queries come in several blocks."""
    import numpy as np

    rng = np.random.default_rng(1)
    m = rng.normal(size=(3000, 8))
    m[::3] = m[0]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)] + [(9999, None)], "vec_id bigint, embedding array<double>")
    asked = rows.filter("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")
    got = {}
    for r in logic.nearest(asked, rows, 5, block=7).collect():
        got.setdefault(r.query_id, {})[r.rank] = r.vec_id
    for q in range(0, 3000, 100):
        d = np.round(np.sqrt(((m - m[q]) ** 2).sum(1)), 9)
        best = [i for _, i in sorted((x, i) for i, x in enumerate(d) if i != q)[:5]]
        assert [got[q][k] for k in range(1, 6)] == best
    assert logic.nearest(asked.limit(0), rows, 5).count() == 0


def test_hot_titles(spark):
    rows = [(i, f"The Common Nature of Item {i % 300}", f"s{i % 3}") for i in range(1500)] + [(9000, "On", "s9"), (9001, "Nature", "s8"), (9002, "", "s1"), (9003, None, "s1")]
    entries = spark.createDataFrame(rows, "entry_id bigint, title string, source string")
    got = {r.entry_id: r.duplicate_of for r in manifest.cross_source_duplicates(entries).collect()}
    key = {i: "".join(c for c in (t or "").lower() if c.isalnum()) for i, t, _ in rows}
    first = {}
    for i, t, src in rows:
        if key[i]:
            first.setdefault(key[i], (i, src))
    for i, _, src in [rows[k] for k in (0, 5, 299, 300, 777, 1499, 1500, 1501, 1502)]:
        best = min((f for k, f in first.items() if key[i] and (k in key[i] or key[i] in k)), default=None)
        assert got.get(i) == (best[0] if best and best[0] < i and best[1] != src else None)


def test_nudge_keeps_null_order(spark):
    rows = spark.createDataFrame([(1, 0.5, 2), (3, 0.5, 2), (None, 0.5, 2)], "seq int, true_confidence double, true_error int")
    got = {r.seq: round(r.true_confidence, 3) for r in feedback.nudge_latest(rows, "seq", F.lit("accept")).collect()}
    assert got == {1: 0.5, 3: 0.6, None: 0.5}


def test_matches_in_blocks(spark):
    rows = docs(spark, [(i, f"the soul and the body of number {i % 7} stand apart") for i in range(40)] + [(99, None)])
    asked = spark.createDataFrame([(k, f"soul body number {k}") for k in range(9)] + [(50, None)], "claim_id bigint, claim string")
    whole = sorted(map(tuple, corpus.corpus_matches(rows, ["doc_id"], "text", asked).collect()))
    parts = sorted(map(tuple, corpus.corpus_matches(rows, ["doc_id"], "text", asked, block=2).collect()))
    assert whole == parts and len({x[0] for x in whole}) == 9
    best = {r.claim_id: (r.doc_id, r.score) for r in corpus.best_match(corpus.corpus_matches(rows, ["doc_id"], "text", asked, best=True, block=2), ["doc_id"]).collect()}
    assert best[3] == (0, 3) and corpus.corpus_matches(rows, ["doc_id"], "text", asked.limit(0)).count() == 0


# ---- cascade, arguments, training sets -------------------------------------------------------------


def test_cascade(spark):
    queries = spark.createDataFrame([(1, "easy"), (2, "hard one"), (3, "asks"), (4, None)], "query_id bigint, query string")

    def generate(xs):
        return ["joined [CONFIDENCE: 0.7]" if x.startswith(("Join", "Answer")) else x.upper() + (" [ORACLE_REQUEST: who]" if x == "asks" else "") for x in xs]

    judge = lambda df: {"confidence": F.when(F.col("query") == "hard one", 0.1).otherwise(0.9), "error": F.lit(1)}
    got = {r.query_id: r for r in cascade.answer_queries(queries, generate, judge, lambda xs: ["SOUL" for _ in xs]).collect()}
    assert (got[1].route, got[1].final, got[1].passes, got[1].confidence) == ("SELF", "EASY", 1, 0.9)
    assert (got[2].route, got[2].final, got[2].passes, got[2].confidence) == ("ORACLE", "joined", 2, 0.7) and "hard one" in got[2].oracle_query
    assert (got[3].route, got[3].oracle_query) == ("HYBRID", "who") and got[4].final is None
    rows = cascade.cascade_feedback(spark.createDataFrame([tuple(got[k]) for k in (2, 3)], "query_id bigint, query string, initial string, route string, oracle_query string, oracle_response string, final string, confidence double, passes int")).collect()
    assert [(r.query_id, r.oracle) for r in rows] == [(2, False), (3, False)]
    assert cascade.answer_queries(queries.limit(0), generate, judge, lambda xs: xs).count() == 0


def test_argument_cycle(spark):
    built = logic.build_arguments(spark.createDataFrame([("a", "A", ["r"]), ("b", "B", ["x"])], "arg_id string, conclusion string, rule_ids array<string>"), spark.createDataFrame([("r", False)], "rule_id string, is_strict boolean"))
    parts = spark.createDataFrame([("a", "b"), ("b", "a")], "arg_id string, sub_id string")
    got = {r.arg_id: (r.premises, r.is_strict) for r in logic.argument_trees(built, parts, spark.createDataFrame([("b", "p")], "arg_id string, premise string")).collect()}
    assert got == {"a": (["p"], False), "b": (["p"], False)}


def test_legacy_triggers(spark, tmp_path):
    from quillmill.streaming import streams

    spark.range(50).selectExpr("cast(1 as bigint) as user_id", "id").write.parquet(str(tmp_path / "e"))
    stream = lambda: spark.readStream.schema("user_id bigint, id bigint").parquet(str(tmp_path / "e"))
    last = lambda df: df.agg(F.max("n_triggers")).first()[0]
    assert last(streams.run_available(streams.triggers(stream()), "update", "t")) == 3
    assert last(streams.run_available(streams.triggers(stream(), full=40), "update", "t")) == 2 + 10
