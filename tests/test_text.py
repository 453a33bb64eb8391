"""Hand-worked rows for the text and scalar functions."""

import pytest
from pyspark.sql import functions as F

from quillmill.functions import lexicon as L
from quillmill.functions import scalars as S
from quillmill.functions import text as X


def one(spark, fn, *values):
    names = [f"c{i}" for i in range(len(values))]
    schema = ", ".join(f"{n} {'string' if v is None or isinstance(v, str) else 'double' if isinstance(v, float) else 'boolean' if isinstance(v, bool) else 'bigint'}" for n, v in zip(names, values))
    return spark.createDataFrame([tuple(values)], schema).select(fn(*map(F.col, names)).alias("x")).first().x


@pytest.mark.parametrize("fn,text,want", [
    (X.dehyphenate, "con-\nsciousness", "consciousness"),
    (X.dehyphenate, "a-\nb-\nc", "ab-\nc"),
    (X.reconnect, "The mind\nis distinct.\nBody", "The mind is distinct.\nBody"),
    (X.reconnect, "End.\nand more", "End.\nand more"),
    (X.reconnect, "a\n\nb", "a\n\nb"),
    (X.book_clean, "x\n1\n2\ny", "x\n2\ny"),
    (X.token_estimate, "a b c d e f g h i j", 13),
    (X.token_estimate, "a b c", 3),
    (X.token_estimate, None, 0),
    (X.parse_confidence, "ok [CONFIDENCE: 0.7] [ORACLE_REQUEST: why\nso]", 0.7),
    (X.parse_confidence, "[CONFIDENCE: 1.2.3]", None),
    (X.parse_request, "ok [CONFIDENCE: 0.7] [ORACLE_REQUEST: why\nso]", "why\nso"),
    (X.drop_tags, "ok [CONFIDENCE: 0.7] [ORACLE_REQUEST: why\nso]", "ok"),
    (X.normalise_claim, "  The  Mind ", "the mind"),
    (X.nfc, "é", "é"),
    (X.squeeze, "a\n\n\n\n\nb  c\x0cd\x01 ", "a\n\n\nb c\nd"),
    (X.strip_fences, "```python\nx\n```", "from z3 import *\nx"),
])
def test_text(spark, fn, text, want):
    assert one(spark, fn, text) == want


def test_repeated_lines(spark):
    t = "Journal\na\nJournal\nb\n Journal\nc\nJournal"
    assert one(spark, X.strip_repeated_lines, t) == "a\nb\nc"
    assert one(spark, X.strip_repeated_lines, "Journal\nJournal\nJournal") == "Journal\nJournal\nJournal"
    long = "x" * 100
    assert one(spark, X.strip_repeated_lines, "\n".join([long] * 4)) == "\n".join([long] * 4)
    assert one(spark, X.strip_repeated_lines, None) is None


def test_density(spark):
    t = "therefore " * 3 + "word " * 97
    assert one(spark, lambda c: X.argument_density(c, ["therefore", "I argue"]), t) == pytest.approx(30.0)
    assert one(spark, lambda c: X.argument_density(c, ["word"]), "word " * 99) == 0.0


@pytest.mark.parametrize("values,want", [((True, False, None, None), 0.6), ((True, False, 0.5, None), 3.75 / 6.5), ((None, None, None, False), 0.3), ((None, None, None, None), 0.5)])
def test_true_confidence(spark, values, want):
    z, o, m, u = values
    row = spark.createDataFrame([(z, o, m, u)], "z boolean, o boolean, m double, u boolean").select(S.true_confidence(F.col("z"), F.col("o"), F.col("m"), F.col("u")).alias("x")).first()
    assert row.x == pytest.approx(want)


@pytest.mark.parametrize("values,want", [((False, None, None), 3), ((None, False, 0.8), 1), ((None, False, None), 2), ((None, None, 0.9), 4), ((True, True, 0.1), 0)])
def test_true_error(spark, values, want):
    row = spark.createDataFrame([values], "z boolean, o boolean, m double").select(S.true_error(F.col("z"), F.col("o"), F.col("m")).alias("x")).first()
    assert row.x == want


@pytest.mark.parametrize("c,want", [(0.85, 0), (0.84, 2), (0.4, 2), (0.39, 1)])
def test_routing(spark, c, want):
    assert one(spark, S.true_routing, c) == want


def test_claims(spark):
    s = "The argument is valid and the premises are necessary."
    kind = one(spark, S.claim_type, s)
    assert kind == "formal"
    assert one(spark, lambda c: S.claim_confidence(c, S.claim_type(c)), s) == pytest.approx(0.8)
    assert one(spark, S.claim_type, "It is S5.") == "interpretive"  # patterns with capitals never match


def test_belnap(spark):
    rows = spark.createDataFrame([(0, 1), (3, 2)], "a int, b int").select(S.belnap_and(F.col("a"), F.col("b")).alias("x"), S.belnap_not(F.col("a")).alias("n")).collect()
    assert [(r.x, r.n) for r in rows] == [(0, 0), (2, 3)]


def test_agreement(spark):
    assert one(spark, S.agreement, "the", "a mind") == 0.5
    assert one(spark, S.equivalent, "the", "the") is False
    assert one(spark, S.agreement, "mind body", "mind soul") == pytest.approx(1 / 3)


def test_theory_distance(spark):
    a, b = L.THEORIES["IIT"], L.THEORIES["GWT"]
    row = spark.createDataFrame([(a, b)], "a array<double>, b array<double>").select(S.distance(F.col("a"), F.col("b")).alias("d"), S.cosine(F.col("a"), F.array_repeat(F.lit(0.0), 6)).alias("c")).first()
    assert row.d == pytest.approx(0.4225**0.5) and row.c == 0.0


def test_fill_slots(spark):
    got = spark.range(1).select(X.fill_slots(F.lit("{a} has {b}"), F.create_map(F.lit("a"), F.lit("x"), F.lit("b"), F.lit("y"))).alias("t")).first().t
    assert got == "x has y"


def test_citations(spark):
    assert one(spark, S.source_citation, "raw/descartes_primary/meditation_second.txt") == "Meditations on First Philosophy, i"  # the roman class matches inside words
    assert one(spark, S.source_citation, "raw/sep/dualism-mind.html").startswith("SEP: ")
    assert one(spark, S.index_category, "a/arxiv/x.pdf") == "cross_disciplinary"
    assert one(spark, S.book_filename, "[Series 3] A Book: Part (1999 ed.)") == "A_Book_Part"
