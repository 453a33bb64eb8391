"""The training-data operators on small tables: brute force, invariants, held-out accuracy and edge cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmill.llm import leakage, mixing, ml, packing, pairs, reading, residue, scans, splitting, tokens
from quillmill.llm.blank import is_blank
from quillmill.session import load

SF = "/root/testdata/sf0.001"


# ---- 1 ------------------------------------------------------------------------------------------


def _cards(spark):
    return spark.createDataFrame([(1, 20, 5, 16), (2, None, None, None), (3, 0, 4, 0)], "card_id int, max_seq_length int, overlap_tokens int, pack_capacity int")


def test_split(spark):
    text = "\n\n".join(" ".join(f"w{i}s{j}" for i in range(9)) + "." for j in range(8))
    rows = [(1, text, 1), (2, text, 2), (3, None, 1), (4, "", 1), (5, text, 99), (6, "x" * 5000, 1), (1, text, 1), (7, "a " * 4000, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, card_id int").withColumn("_tokens", F.lit(7)).withColumn("piece_no", F.lit(1))
    got = splitting.split_oversized(docs, _cards(spark), with_text=True).collect()
    pieces = [r for r in got if r.doc_id == 1]
    assert len(pieces) == 2 * pieces[0].n_pieces  # the row is there twice
    ordered = sorted({(r.piece_no, r.piece_text) for r in pieces})
    seen = []
    for no, t in ordered:
        words = t.split()
        assert 13 * len(words) // 10 <= 20
        new = words[4:] if no else words  # 5 tokens are 4 words
        if no:
            assert words[:4] == seen[-4:]
        seen += new
    assert seen == text.split() and all(t.endswith(".") for _, t in ordered)
    assert {r.doc_id for r in got if not r.is_split} == {2, 3, 4, 5, 6}
    assert all(r.token_estimate <= 20 for r in got if r.doc_id == 7)
    assert sorted(r.doc_id for r in splitting.oversized_documents(docs, _cards(spark)).collect()) == [1, 7]
    assert splitting.split_oversized(docs.limit(0), _cards(spark)).count() == 0


# ---- 2 ------------------------------------------------------------------------------------------


def test_mixing(spark):
    docs = spark.createDataFrame([(i, "w " * 100, c) for i in range(400) for c in [["Big Topic", "small-topic", None, "other"][min(3, i % 40) if i % 40 < 3 else 0]]], "doc_id bigint, text string, category string")
    man = spark.createDataFrame([(1, 20000, 3, (0.5, 0.3, None, 0.2)), (2, 1000, None, (0.0, 0.0, None, None)), (3, 500, 2, (None, None, None, None))], "manifest_id int, target_tokens bigint, max_repeats int, mixing_ratio struct<big_topic:double,small_topic:double,unused:double,absent:double>")
    plan = {(r.manifest_id, r.category): r for r in mixing.mix_plan(docs, man).collect()}
    assert plan[1, "small_topic"].short and plan[1, "absent"].short and not plan[1, "big_topic"].short and (1, "unused") not in plan
    assert plan[2, "big_topic"].share is None and plan[2, "big_topic"].rate == 0.0
    sample = mixing.mix_sample(docs, man).collect()
    assert max(r.copies for r in sample) <= 3 and all(r.copies == 3 for r in sample if r.category == "small_topic")
    reached = sum(r.copies * r.token_estimate for r in sample if r.category == "big_topic")
    assert abs(reached - 10000) < 2500
    assert mixing.emit_copies(mixing.mix_sample(docs, man)).count() == sum(r.copies for r in sample)
    assert mixing.mix_sample(docs.limit(0), man).count() == 0


# ---- 3 ------------------------------------------------------------------------------------------

PROMPT = "Which premise would a critic of Ada Bell attack first, given that the mind shapes every doubt? Answer the critic."


@pytest.mark.parametrize("prompt,response,want", [
    (PROMPT, None, "empty"), (PROMPT, "", "empty"), (PROMPT, " ​\n", "empty"), (PROMPT, "N/A", "empty"), (PROMPT, "Answer:", "empty"), (PROMPT, "[no response]", "empty"), (PROMPT, "—", "empty"),
    (PROMPT, PROMPT.upper(), "copied"), (PROMPT, "Q: " + PROMPT, "copied"), (PROMPT, PROMPT[:-30], "copied"), (PROMPT, PROMPT + "\n" + PROMPT, "copied"), (PROMPT, PROMPT + "\n\nThe step from doubt to mind is the weak one, since nothing in it is shown; a rival can grant it all and still hold that it fails.", None),
    (PROMPT, "I'm sorry, but I can't help with that. Is there anything else?", "refusal"), (PROMPT, "Declined.", "refusal"), ("Warum gilt das, und was folgt nicht daraus?", "Dabei kann ich leider nicht helfen.", "refusal"),
    (PROMPT, "La mémoire du corps ne détruit pas une distinction réelle, et il faut donc admettre que le doute est une cause.", "language"),
    (PROMPT + " Please answer in French.", "La mémoire du corps ne détruit pas une distinction réelle, et il faut donc admettre que le doute est une cause.", None),
    (PROMPT, "The first premise is weak. The critic will say that the mind does not shape eve", "truncated"), (PROMPT, "The first premise is weak and the critic will,", "truncated"), (PROMPT, "The premise is weak because of the…", "truncated"),
    (PROMPT, "Yes, it does.", None), (PROMPT, "The author refuses to answer, and rightly so: the mind shapes the doubt.", None), (PROMPT, "I cannot accept the premise that the mind shapes doubt. It is false.", None), (PROMPT, "It fails, for the step is bad.\n\nVerdict: undecided", None), (PROMPT, "It follows.\n[CONFIDENCE: 0.62]", None), (PROMPT, "So it goes.\n∀x (Fx → Gx), Fa ⊢ Ga", None), (None, "A full answer.", None),
])
def test_judge(prompt, response, want):
    assert pairs.judge(prompt, response, False, False, frozenset()) == want


def test_shortened_brute_force(spark):
    rng = random.Random(4)
    texts = {"".join(rng.choice("ab") for _ in range(rng.randint(1, 9))) for _ in range(120)}
    df = spark.createDataFrame([(t,) for t in texts] * 2 + [(None,), ("",)], "response string")
    got = {r.response for r in pairs.shortened(df.repartition(5), 1).collect()}
    assert got == {t for t in texts if any(u != t and u.startswith(t) for u in texts)}


def test_common_prefix_and_subsequence():
    rng = random.Random(3)
    for _ in range(200):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randint(0, 12))) for _ in range(2))
        n = pairs.common_prefix(a, b)
        assert a[:n] == b[:n] and (n == min(len(a), len(b)) or a[n] != b[n])
        row = [0] * (len(a) + 1)
        for w in b:
            row = _lcs_row(row, a, w)
        assert pairs.common_subsequence(list(a), list(b)) == row[-1]


def _lcs_row(row, a, w):
    out = [0]
    for j, v in enumerate(a, 1):
        out.append(row[j - 1] + 1 if w == v else max(row[j], out[-1]))
    return out


def test_steps_decide(spark):
    """Planted cuts: what only the sorted neighbours or only the lengths can show is found by them."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    full = [" ".join(word() for _ in range(30)).capitalize() + f" as Prof. x{i} said (see p. {i}) of the mind. Then it ends." for i in range(60)]
    rows, want = [], {}
    for i, t in enumerate(full):
        rows.append((i, "What of minds?", t, None))
        cut = {0: t[: t.index("Prof.") + 5], 1: t[: t.index(")") + 1], 2: t[: t.index(" Then")]}[i % 3]  # an abbreviation, a bracket, a sentence end
        rows.append((100 + i, "What of minds?", cut, None))
        if i % 3 < 2:
            want[100 + i] = ("truncated", "prefix")
    for i in range(60):  # texts of one length that end in a bracket, without their full versions
        head = f"Of mind {i} " + " ".join(word() for _ in range(60))
        rows.append((200 + i, "What of minds?", head[:240] + " (as it)", None))
        want[200 + i] = ("truncated", "length")
    made = spark.createDataFrame(rows, "row_id bigint, user_prompt string, assistant_response string, source_passage string")
    got = {r.row_id: (r.defect, r.step) for r in pairs.defects(made).collect()}
    assert got == want


def test_long_refusal():
    reason = " My guidelines do not permit me to help with requests on such topics, and I am sorry for that." * 20
    assert pairs.refuses("I cannot answer this question." + reason) and pairs.refuses("Thank you for asking. " * 40 + "I must decline to answer this request." + reason)
    assert not pairs.refuses("The mind is one, and the body is many; from this it follows that the doubt is real. " * 20 + "I will not say that more is shown.")
    prompt = " ".join(f"w{i}" for i in range(30_000))
    assert pairs.copies_prompt(prompt, prompt[:-500])


def test_ending_statistics_copies(spark):
    cut = "The reply is long enough to be an answer, and then it says that the proof of the"
    copied = "A long answer that comes to the point\nand then stops within what it has said about minds"
    label = [f"Answer number {i} " + "word " * (i % 400) + "\nVerdict: valid" for i in range(2000)]
    rows = spark.createDataFrame(list(enumerate([copied] * 900 + [cut] * 100 + label)), "row_id bigint, assistant_response string")
    endings, spikes = pairs.ending_statistics(rows)
    assert endings == {"Verdict: valid"} and not spikes
    assert pairs.judge("What of minds?", copied, False, False, endings) == "truncated"


def test_spikes_all(spark, monkeypatch):
    monkeypatch.setattr(pairs, "SPIKE_ROWS", 2)
    monkeypatch.setattr(pairs, "SPIKE_FACTOR", 2)
    texts = [f"{k}{'x' * (n - 1)}" for n in range(50, 50 + 3 * 1100, 3) for k in (1, 2)]
    rows = spark.createDataFrame(list(enumerate(texts)), "row_id bigint, assistant_response string")
    assert len(pairs.ending_statistics(rows)[1]) == 1100


def test_pairs_tables(spark):
    rows = load(spark, SF, "sft_examples")
    got = pairs.defects_found(rows).collect()
    assert got and {r.defect for r in got} <= {"empty", "truncated", "refusal", "copied", "language"}
    held = {r.row_id for r in residue.residue_found(rows).collect()}
    assert not held & {r.row_id for r in got}
    assert pairs.defects_found(rows.limit(0)).count() == 0


# ---- 4 ------------------------------------------------------------------------------------------


def test_edits():
    assert scans._edits("cvery", "every") == (1, 0) and scans._edits("siipport", "support") == (1, 0) and scans._edits("liypothesis", "hypothesis") == (1, 0)
    assert scans._edits("describes", "describe")[1] > 0


def test_repair_parts(spark):
    clean = [r[0] for r in load(spark, "/root/testdata/sf0.01", "sft_examples").filter("length(source_passage) > 300 and source_passage not like '%\n%'").select("source_passage").limit(400).collect()]
    texts = [t.split(" In 1")[0] for t in clean]
    known = {}
    for t in texts:
        for w in map(scans.bare, t.split()):
            known[w] = known.get(w, 0) + 1
    model = scans.train_lines(texts[::2])
    worker = scans.Repairer(known, model, scans.train_joins(texts[::2], known))
    jx, jy = scans.synthetic_joins(texts[1::2], known, seed=10)
    assert ((scans.train_joins(texts[::2], known).predict(jx) > 0) == (jy > 0)).mean() > 0.97  # held out
    assert worker.repair(["A well-\nknown thought of the con-\nscious mind is the self-\nsame one."], {})[0][0].count("-") in (0, 1)
    page = "The argument depends on the con-\nscious habit of every mind and\n\n212 ON THE QUIET MEMORY\n\nit shows that the proof is cvery\nbit as | strong as the reply. It\nis p r o p e r l y so."
    text, kinds = worker.repair([page], {"cvery": "every"})[0]
    assert kinds == ["hyphenation", "misread", "header", "page_number"]
    assert text == "The argument depends on the conscious habit of every mind and it shows that the proof is every bit as strong as the reply. It is properly so."
    assert worker.repair([None, "", "Plain text, in 1688."], {}) == [(None, []), ("", []), ("Plain text, in 1688.", [])]
    heading = "OF DOUBT AND CAUSE\n\nThe mind is one. In 1704 the point was made in 3 places."
    assert worker.repair([heading], {})[0][1] == []
    x, y = scans.synthetic_lines(texts[1::2], seed=9)
    assert ((model.predict(x) > 0) == (y > 0)).mean() > 0.95  # held out


def test_repair_tables(spark):
    rows = load(spark, SF, "sft_examples")
    whole = {r.row_id: (r.clean_passage, tuple(r.noise)) for r in scans.repair_passages(rows).collect()}
    assert len(whole) == rows.count()
    assert scans.noise_found(rows.limit(0)).count() == 0


def test_repair_joined_equal(spark, monkeypatch):
    """The corrections joined through the filter give what a repair with all of them at hand gives, on all rows."""
    fixes = [("cvery", "every"), ("rnind", "mind"), ("ob.iect", "object"), ("fiuid", "fluid"), ("well-kn0wn", "well-known")]
    monkeypatch.setattr(scans, "corrections", lambda counts: spark.createDataFrame(fixes, "bad string, good string"))
    texts = ["the ‘cvery’ word", "*rnind* and —cvery—", "«rnind»", "so cvery!", "an ob.iect here", "the ﬁuid part", "a well-kn0wn man", "the cve-\nry end of it", "c v e r y", "cvery, rnind.", "CVERY", None, ""]
    made = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 2)], "row_id bigint, source_passage string")
    rows = made.unionByName(load(spark, SF, "sft_examples").selectExpr("row_id + 1000 as row_id", "source_passage"))
    joined = sorted((r.row_id, r.clean_passage or "", r.clean_passage is None, tuple(r.noise)) for r in scans.repair_passages(rows).collect())
    monkeypatch.undo()
    counts = scans.word_counts(rows)
    total = counts.agg(F.sum("n")).first()[0]
    known = {r.word: r.n for r in counts.filter(F.col("n") >= max(scans.KNOWN_ROWS, scans.KNOWN_SHARE * total)).collect()}
    sample = scans.clean_sample(rows)
    worker = scans.Repairer(known, scans.train_lines(sample), scans.train_joins(sample, known))
    given = rows.collect()
    plain = sorted((r.row_id, t or "", t is None, tuple(k)) for r, (t, k) in zip(given, worker.repair([r.source_passage for r in given], dict(fixes))))
    assert joined == plain and len({i for i, _, _, k in joined if i < 11 and "misread" in k}) == 11


def test_candidates_prefix(spark):
    """The prefix filter loses no pair that a few confusions explain, and joins few rows."""
    rng = random.Random(6)
    words = sorted({"".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(3, 11))) for _ in range(1200)})
    inverse = {}
    for b, g in scans.CONFUSIONS:
        inverse.setdefault(g, []).append(b)
    made = {}
    for w in words[::3]:
        d = w
        for _ in range(rng.choice((1, 1, 2))):
            spots = [(i, g) for g in inverse for i in range(len(d)) if d.startswith(g, i)]
            i, g = rng.choice(spots or [(0, "")])
            d = d[:i] + rng.choice(inverse.get(g, [""])) + d[i + len(g) :]
        if d != w and d not in words:
            made[d] = w
    known = spark.createDataFrame([(w, 1000) for w in words], "word string, n bigint")
    suspects = spark.createDataFrame([(w, 1) for w in made], "word string, n bigint")
    few = {(r.bad, r.good) for r in scans.candidates(suspects, known).collect()}
    whole = {(r.bad, r.good) for r in scans.candidates(suspects, known, prefix=99).collect()}
    assert few <= whole
    reach = {(b, g) for b, g in whole if made[b] == g}
    assert len(reach & few) >= 0.995 * len(reach)
    assert len(few) < 0.05 * len(made) * len(words)


def test_learned_confusion(spark):
    """A confusion outside the list is learned where many words show it, and endings of words are not."""
    rng = random.Random(1)
    words = sorted({"".join(rng.choice("abdgkmprtvx") + rng.choice("aeou") for _ in range(rng.randint(3, 5))) for _ in range(300)})
    bad = [w.replace("x", "j", 1) for w in words if "x" in w[1:-1]]
    ends = [w + "t" for w in words[:80]]
    counts = spark.createDataFrame([(w, 4000) for w in words] + [(w, 2) for w in bad + ends], "word string, n bigint")
    got = {r.bad: r.good for r in scans.corrections(counts).collect()}
    assert sum(got.get(b) == w for b, w in zip(bad, [w for w in words if "x" in w[1:-1]])) >= 0.9 * len(bad)
    assert not set(ends) & set(got)


def test_repair_copied_passage(spark):
    plain = load(spark, "/root/testdata/sf0.01", "sft_examples").filter("length(source_passage) > 200 and source_passage rlike '\\\\bevery\\\\b'").select("source_passage").distinct().limit(300).collect()
    texts = [r[0] for r in plain] + ["The mind in cvery case is one, and of this there is no doubt at all."] * (len(plain) // 2)
    rows = spark.createDataFrame(list(enumerate(texts)), "row_id bigint, source_passage string")
    counts = {r.word: r.n for r in scans.word_counts(rows.select("row_id", "source_passage")).collect()}
    assert counts["cvery"] == 1
    got = {r.row_id: (r.clean_passage, r.noise) for r in scans.repair_passages(rows).collect()}
    assert len(got) == len(texts) and all("in every case" in got[i][0] and got[i][1] == ["misread"] for i in range(len(plain), len(texts)))


# ---- 5 ------------------------------------------------------------------------------------------


def test_residue(spark):
    rows = load(spark, SF, "sft_examples")
    tables = residue.train_tables(*residue.prose_sample(rows))
    given = ["See {{author}} on this.", "The view of [INSERT NAME] is clear.", "Lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod.", "404 Not Found", "The page could not be found. Return to the home page.", "Please enable JavaScript to view this page.", "P1 [STRICT]: The set {p, q} is consistent. [CONFIDENCE: 0.62]", "An error in the report is not a report not found.", None, "", "null"]
    got = [k for k, _ in residue.classify(given, tables)]
    assert got == ["placeholder", "placeholder", "filler", "error_page", "error_page", "script_notice", None, None, None, None, None]
    assert residue.residue_found(rows.limit(0)).count() == 0
    assert residue.clean_examples(rows).count() + residue.residue_found(rows).count() == rows.count()


def test_slots_located(spark):
    """The model finds slots it was not trained on, in its windows; the syntax check runs on these only."""
    rows = load(spark, SF, "sft_examples")
    tables = residue.train_tables(*residue.prose_sample(rows))
    prose = [r[0] for r in rows.select("source_passage").filter("length(source_passage) between 100 and 1500").collect()]
    rng, made = random.Random(77), []
    for t in prose[:200]:
        w = t.split(" ")
        w.insert(rng.randrange(len(w)), rng.choice(["{{who}}", "[INSERT WORK HERE]", "${where}", "<<Place>>", "[[when]]", "__VOLUME__", "TBD", "%(city)s", "[Your reply]", "XXXX"]))
        made.append(" ".join(w))
    kinds = [k for k, _ in residue.classify(made, tables)]
    assert sum(k == "placeholder" for k in kinds) >= 0.97 * len(made)
    windows = residue.slot_windows(prose, tables)
    assert sum(len(w) for _, w in windows) < 0.25 * sum(map(len, prose))
    two = residue.slot_windows(["x" * 9, "", "see {{a}}" + " word" * 100 + " or {{b}}."], tables)
    assert [k for k, w in two if residue.has_slot(w)] == [2, 2]  # apart, each in a window of its own


def test_prose_sample_bounds(spark):
    rows = spark.range(3000).selectExpr("cast(id % 1000 as bigint) as row_id", "'p' as user_prompt", "repeat('x', cast(if(id % 2 = 0, 30000, 10) as int)) as source_passage", "concat('r', id) as assistant_response")
    prose, responses = residue.prose_sample(rows, 100)
    assert 60 <= len(responses) <= 100 and max(map(len, prose)) <= 20_000
    assert residue.prose_sample(rows, 100) == (prose, responses)


def test_prose_of_all_rows(spark):
    """Natural prose is learned from every row and from long texts too, however the rows are divided."""
    told = "The archive is no longer here."
    rows = load(spark, SF, "sft_examples").select("row_id", "user_prompt", "source_passage", "assistant_response")
    late = spark.createDataFrame([(10**9, None, ("\n" * 7 + told) * 1000, told)], rows.schema)  # over 20,000 characters
    assert [r.residue for r in residue.residue(rows.unionByName(late)).filter("row_id = 1000000000").collect()] == [None]
    short = spark.createDataFrame([(10**9, None, "No.", told)], rows.schema)
    assert [r.residue for r in residue.residue(rows.unionByName(short)).filter("row_id = 1000000000").collect()] == ["error_page"]
    many = rows.unionByName(late).unionByName(spark.range(5000).selectExpr("id + 2000000 as row_id", "concat('q', id, ' why?') as user_prompt", "null as source_passage", "concat('z', id, ' is so.') as assistant_response"))
    given = many.collect()
    one = residue.train_tables([x for r in given for x in (r.user_prompt, r.source_passage) if x], [r.assistant_response for r in given if r.assistant_response])
    for a, b in zip(residue.corpus_tables(many.repartition(3)), one, strict=True):
        assert all(np.array_equal(x, y) for x, y in zip(a, b, strict=True))


def test_repeated_word():
    tables = residue.train_tables(["The content of the mind is a content of thought."] * 50, [])
    given = ["content " * 9, "12345, " * 8 + "12345", "No. No. No.", "content content content content contents of it"]
    assert [k for k, _ in residue.classify(given, tables)][:3] == ["filler", "filler", None] and not residue._REPEATED.fullmatch(given[3])


def test_gram_counts(monkeypatch):
    """Counts by place are those of a count text by text, also where they are added up in between, and prose does not fall on class n-grams."""
    rng = random.Random(3)
    texts = ["".join(rng.choices("abcd é", k=rng.randint(0, 60))) for _ in range(300)]
    tags = ml.class_tags([texts[:5]])
    whole = ml.GramCounts(tags).add(texts).parts()
    size = sum(len(t.encode()) + len(ml.GAP) for t in texts)
    assert all(n.sum() == size for _, n in whole[: ml.ORDERS])
    assert dict(zip(*np.unique(np.concatenate([ml.fold(t) for t in texts]), return_counts=True)))[ord("a")] in whole[0][1]
    monkeypatch.setattr(ml, "PIECE", 64)
    monkeypatch.setattr(ml, "HELD", 100)
    split = ml.GramCounts(tags).add(texts).parts()
    rest = ml.merged(ml.GramCounts(tags).add(texts[:100]).parts(), ml.GramCounts(tags).add(texts[100:]).parts())
    for got in (split, rest):
        assert all(np.array_equal(x, y) for a, b in zip(got, whole, strict=True) for x, y in zip(a, b, strict=True))


def test_blank():
    assert is_blank(None) and is_blank("...") and is_blank("\xa0") and not is_blank("No.") and not is_blank("__NAME__") and not is_blank("x" * 100)


# ---- 6 ------------------------------------------------------------------------------------------


def test_histogram():
    rng = random.Random(8)
    for _ in range(30):
        capacity = rng.randint(5, 60)
        hist = {rng.randint(1, capacity): rng.randint(1, 300) for _ in range(rng.randint(1, 15))}
        packed = packing.pack_histogram(list(hist.items()), capacity)
        total = {}
        for n, p in packed:
            assert sum(k * v for k, v in p.items()) <= capacity and n > 0
            for k, v in p.items():
                total[k] = total.get(k, 0) + n * v
        assert total == hist


def _worst_fit(items, capacity):
    """Item by item: longest first, into the pack with the most room, else a new one."""
    rooms = []
    for x in sorted(items, reverse=True):
        best = max(rooms, default=0)
        if best >= x:
            rooms.remove(best)
            rooms.append(best - x)
        else:
            rooms.append(capacity - x)
    return sorted(rooms)


def test_shortest_pack_first():
    assert sorted(tuple(sorted(p.items())) for _, p in packing.pack_histogram([(7, 1), (5, 1), (3, 1)], 10)) == [((3, 1), (5, 1)), ((7, 1),)]
    rng = random.Random(2)
    for _ in range(40):
        capacity = rng.randint(5, 60)
        hist = {rng.randint(1, capacity): rng.randint(1, 60) for _ in range(rng.randint(1, 15))}
        rooms = sorted(capacity - sum(k * v for k, v in p.items()) for n, p in packing.pack_histogram(list(hist.items()), capacity) for _ in range(n))
        assert rooms == _worst_fit([k for k, n in hist.items() for _ in range(n)], capacity)


def test_packing_hot_length(spark, monkeypatch):
    monkeypatch.setattr(packing, "SALT_ROWS", 50)
    docs = spark.range(3000).selectExpr("id as doc_id", "repeat('word ', cast(if(id % 3 = 0, 5, id % 14) as int)) as text", "1 as card_id")
    got = packing.pack_documents(docs, _cards(spark)).collect()
    used = {}
    for r in got:
        used[r.container_no] = used.get(r.container_no, 0) + r.n_tokens
    assert len(got) == 3000 and max(used.values()) <= 16 and set(used) == set(range(len(used)))
    lengths = {}
    for r in got:
        lengths[r.n_tokens] = lengths.get(r.n_tokens, 0) + 1
    assert len(used) == sum(n for n, _ in packing.pack_histogram([(k, n) for k, n in lengths.items() if k], 16))


def test_packing(spark):
    rng = random.Random(6)
    rows = [(i, "word " * rng.choice([1, 3, 3, 3, 3, 7, 40]), rng.choice([1, 1, 2, 3])) for i in range(400)] + [(900, None, 1), (901, "", 1), (5, "word word", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, card_id int").withColumn("capacity", F.lit(1))
    got = packing.pack_documents(docs, _cards(spark)).collect()
    used = {}
    for r in got:
        if r.card_id == 1:
            used[r.container_no] = used.get(r.container_no, 0) + r.n_tokens
        else:
            assert r.container_no is None
    assert max(used.values()) <= 16 and sum(used.values()) > 0.9 * 16 * len(used)
    assert len({(r.doc_id, r.part_no) for r in got if r.doc_id != 5}) == len([r for r in got if r.doc_id != 5]) and {r.doc_id for r in got} == {r[0] for r in rows}
    assert packing.pack_documents(docs.limit(0), _cards(spark)).count() == 0


# ---- 7 ------------------------------------------------------------------------------------------


def test_leaks(spark):
    rng = random.Random(12)
    vocab = [f"{a}{b}" for a in "bcdfgklmnprst" for b in ("an", "el", "or", "um", "iv")]
    q = [[rng.choice(vocab) for _ in range(50)] for _ in range(4)]
    noise = lambda n: [rng.choice("the a mind body of and".split()) for _ in range(n)]
    edited = [w if i % 8 else "changed" for i, w in enumerate(q[1])]
    docs = [
        (1, " ".join(noise(50) + q[0] + noise(50))), (2, " ".join(noise(30) + edited + noise(5)).upper()), (3, " ".join(noise(9) + q[2][:14] + noise(40) + q[2][30:42] + noise(9))), (4, " ".join(q[3][:12] + noise(40))),
        (5, None), (6, ""), (7, " ".join(q[0]).replace(" ", "\n")), (8, " ".join(noise(400))), (1, " ".join(noise(50) + q[0] + noise(50))),
        (9, "-\n".join([" ".join(q[0])[:40], " ".join(q[0])[40:]])),
    ]
    items = spark.createDataFrame([(i + 1, " ".join(x)) for i, x in enumerate(q)] + [(9, None), (10, "too short")], "item_id bigint, q string")
    got = {(r.doc_id, r.item_id) for r in leakage.leaks_found(spark.createDataFrame(docs, "doc_id bigint, text string"), items).collect()}
    assert got == {(1, 1), (2, 2), (3, 3), (7, 1), (9, 1)}
    assert leakage.leaks(spark.createDataFrame(docs, "doc_id bigint, text string").limit(0), items).count() == 0
    assert leakage.leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), items.limit(0)).count() == 0


def test_alignment_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(20):
        a, b = rng.integers(0, 4, 8), rng.integers(0, 4, 11)
        h = np.zeros((9, 12), int)
        for i in range(1, 9):
            for j in range(1, 12):
                h[i, j] = max(0, h[i - 1, j - 1] + (leakage.MATCH if a[i - 1] == b[j - 1] else leakage.EDIT), h[i - 1, j] + leakage.EDIT, h[i, j - 1] + leakage.EDIT)
        assert leakage.align(a, b)[0] == h.max()


def test_leak_two_stretches_bridged(spark):
    rng = random.Random(4)
    item = [f"w{i}" for i in range(59)]
    noise = lambda n: [f"z{rng.randint(0, 10**9)}" for _ in range(n)]
    docs, q = [], [(1, " ".join(item))]
    for gap in range(1, 12):  # item words left out between two exact stretches of 24 words
        docs.append(noise(20) + item[:24] + item[24 + gap : 48 + gap] + noise(20))
    for gap in range(5, 9):  # two wrong words in each
        a, b = item[:24], item[24 + gap : 48 + gap]
        a[5] = a[17] = b[6] = b[15] = "x"
        docs.append(noise(20) + a + b + noise(20))
    rows = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id bigint, text string")
    got = {r.doc_id for r in leakage.leaks_found(rows, spark.createDataFrame(q, "item_id bigint, q string")).collect()}
    assert got == set(range(len(docs)))


def test_leak_edit_share():
    for n, wrong in ((12, (4, 8)), (18, (4, 8, 13)), (24, (4, 9, 14, 19))):
        a = np.arange(1, n + 1)
        b = a.copy()
        b[list(wrong)] = 0
        assert leakage.covered(a, b) == (n, n - len(wrong), 1)


def test_leak_hot_and_shared(spark):
    """A passage in a third of all documents, items that all share their words, and repeated rows and items."""
    rng = random.Random(5)
    item = [f"w{i}" for i in range(50)]
    docs = [(i, " ".join([f"n{rng.randint(0, 10**6)}" for _ in range(30)] + (item[10:35] if i % 3 == 0 else []) + ["end"])) for i in range(600)]
    items = spark.createDataFrame([(k, " ".join(item) + f" x{k}") for k in range(40)] + [(0, " ".join(item) + " x0")], "item_id bigint, q string")
    rows = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = leakage.leaks_found(rows, items).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(i, k) for i in range(0, 600, 3) for k in range(40)} and len(got) == 200 * 40
    twice = leakage.leaks(rows.filter("doc_id = 3").union(rows.filter("doc_id = 3")), items.limit(1)).collect()
    assert len(twice) == 2


def test_leak_long_item(spark):
    rng = random.Random(9)
    item = [f"w{rng.randint(0, 10**7)}" for _ in range(6000)]
    drifted = [w for i, w in enumerate(item[:4000]) if i % 9] + [w for w in item[4000:]]
    docs = [(1, " ".join(["start"] * 50 + drifted)), (2, " ".join(item[:2300])), (3, " ".join(item[:500] + ["z"] * 400 + item[500:3000]))]
    rows, items = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id bigint, q string")
    assert {(r.doc_id) for r in leakage.leaks_found(rows, items).collect()} == {1, 3}


def test_hash_words():
    given = ["con-\nscious a\xadb -\n c", "", "x –  \r\n\n y", "“Quo” can’t 5-\n6 é-\né", "A\u00a0B\u2003C\u3000D"]
    h, first = tokens.hash_words(given)
    words = [h[first[k] : first[k + 1]].tolist() for k in range(5)]
    assert [len(w) for w in words] == [3, 0, 2, 6, 4]
    assert words[0] == [tokens.hash_words([w])[0][0] for w in ("conscious", "ab", "c")] and words[3][5] == tokens.hash_words(["éé"])[0][0]


# ---- 8 ------------------------------------------------------------------------------------------


def test_reading(spark):
    docs, labels = load(spark, "/root/testdata/sf0.01", "documents"), load(spark, "/root/testdata/sf0.01", "reading_labels")
    model = reading.train(docs, labels)
    assert model.scores["within_one"] > 0.95 and model.scores["mean_error"] < 0.8  # sources held out; few labels here
    extra = spark.createDataFrame([(-1, None, "s"), (-2, "", "s"), (-3, "short text", "s"), (-4, "Die Seele ist nicht der Leib und das Denken gilt. " * 20, "s")], "doc_id bigint, text string, source string")
    got = reading.reading_levels(extra, labels).collect()
    assert got == []
    easy = spark.createDataFrame([(1, "The quiet stone is not every room. We keep a word. " * 10, "s")], "doc_id bigint, text string, source string")
    assert [r.reading_level for r in reading.reading_levels(easy, labels.limit(0)).collect()] == [3]


# ---- learners -----------------------------------------------------------------------------------


def test_boosting():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 4))
    y = np.where(x[:, 0] > 0, 2.0, 0.0) + x[:, 1] * (x[:, 2] > 0)
    model = ml.GradientBoosting(trees=80, depth=3).fit(x[:400], y[:400])
    assert ((model.predict(x[400:]) - y[400:]) ** 2).mean() < 0.2 * y.var()
    label = (x[:, 0] + x[:, 1] > 0).astype(float)
    model = ml.GradientBoosting(trees=60, depth=3, loss="logistic").fit(x[:400], label[:400])
    assert ((model.predict(x[400:]) > 0) == (label[400:] > 0)).mean() > 0.9
    assert ml.GradientBoosting().fit(np.zeros((0, 2)), np.zeros(0)).predict(np.zeros((1, 2))).shape == (1,)
