"""The pN_ queries and, where SQL can express them, their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmill.llm import leakage, mixing, packing, pairs, reading, residue, scans, splitting
from quillmill.llm.common import WORD, word_count
from quillmill.session import load, materialize

Query = Callable[[SparkSession, str], DataFrame]


def _p1_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.oversized_documents(load(spark, d, "documents"), load(spark, d, "dataset_card"))


def _p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_oversized(load(spark, d, "documents"), load(spark, d, "dataset_card"), with_text=True)


def _p1_report(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_report(load(spark, d, "documents"), load(spark, d, "dataset_card"))


def _p1_limits(spark: SparkSession, d: str) -> DataFrame:
    """Per document cut: its words, pieces over the limit, pieces that do not begin with the words shared with the one before, and whether all words are there."""
    docs, cards = load(spark, d, "documents"), load(spark, d, "dataset_card")
    pieces = splitting.split_oversized(docs, cards, with_text=True).filter("is_split").withColumn("w", F.regexp_extract_all("piece_text", F.lit(WORD), F.lit(0)))
    most = F.floor((10 * F.col("max_seq_length") + 9) / 13)
    shared = F.least(F.ceil(10 * F.greatest(F.coalesce("overlap_tokens", F.lit(0)), F.lit(0)) / 13), F.floor(most / 2)).cast("int")
    each = pieces.join(F.broadcast(cards.select("card_id", "max_seq_length", shared.alias("shared"))), "card_id")  # one row per card
    before = F.lag("w").over(Window.partitionBy("doc_id").orderBy("piece_no"))
    each = each.withColumn("misfit", F.coalesce(F.slice("w", 1, F.col("shared")) != F.slice(before, F.greatest(F.size(before) - F.col("shared") + 1, F.lit(1)), F.col("shared")), F.lit(False)))
    per = each.groupBy("doc_id").agg(F.sum((F.floor(F.size("w") * 13 / 10) > F.col("max_seq_length")).cast("bigint")).alias("n_over"), F.sum(F.col("misfit").cast("bigint")).alias("n_misfit"), (F.sum(F.size("w")) - F.max("shared") * (F.count("*") - 1)).alias("_w"))
    return per.join(docs.select("doc_id", word_count(F.col("text")).cast("bigint").alias("n_words")), "doc_id").select("doc_id", "n_words", "n_over", "n_misfit", (F.col("_w") == F.col("n_words")).alias("covered"))


def _p2_found(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_plan(load(spark, d, "documents"), load(spark, d, "manifest")).filter("short").select("manifest_id", "category")


def _p2_sample(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_sample(load(spark, d, "documents"), load(spark, d, "manifest"))


def _p2_report(spark: SparkSession, d: str) -> DataFrame:
    report = mixing.mix_report(load(spark, d, "documents"), load(spark, d, "manifest"), load(spark, d, "dataset_card"))
    return report.withColumns({c: F.round(c, 6) for c in ("share", "wanted_tokens", "rate", "actual_share")})


def _p3_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.defects_found(load(spark, d, "sft_examples"))


def _p3_by_status(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "sft_examples")
    found = pairs.defects_found(rows)
    status = F.lower(F.trim("review_status")).alias("review_status")
    return found.join(rows.select("row_id", status), "row_id").groupBy("defect", "review_status").agg(F.countDistinct("row_id").alias("n_rows"))


def _p3_by_step(spark: SparkSession, d: str) -> DataFrame:
    return pairs.defects(load(spark, d, "sft_examples")).groupBy("defect", "step").agg(F.count("*").alias("n_rows"))


def _p4_found(spark: SparkSession, d: str) -> DataFrame:
    return scans.noise_found(load(spark, d, "sft_examples"))


def _p4_repaired(spark: SparkSession, d: str) -> DataFrame:
    return scans.repair_passages(load(spark, d, "sft_examples"))


def _p5_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue_found(load(spark, d, "sft_examples"))


def _p5_coverage(spark: SparkSession, d: str) -> DataFrame:
    rows = residue.residue(load(spark, d, "sft_examples"))
    return rows.groupBy(F.coalesce("residue", F.lit("none")).alias("residue")).agg(F.count("*").alias("n_rows"), F.round(F.avg("coverage"), 4).alias("mean_coverage"))


def _p5_by_step(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue(load(spark, d, "sft_examples")).filter("residue is not null").groupBy("residue", "step").agg(F.count("*").alias("n_rows"))


def _p6_pack(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(load(spark, d, "documents"), load(spark, d, "dataset_card"))


def _p6_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.packing_report(load(spark, d, "documents"), load(spark, d, "dataset_card"))


def _p6_limits(spark: SparkSession, d: str) -> DataFrame:
    """Per card: documents packed, containers over the capacity, and documents cut although they fit whole."""
    docs, cards = load(spark, d, "documents"), load(spark, d, "dataset_card")
    caps = F.broadcast(cards.select("card_id", "pack_capacity"))  # one row per card
    packed = materialize(packing.pack_documents(docs, cards).filter("container_no is not null"), "packed")
    over = packed.groupBy("card_id", "container_no").agg(F.sum("n_tokens").alias("n")).join(caps, "card_id").groupBy("card_id").agg(F.sum((F.col("n") > F.col("pack_capacity")).cast("bigint")).alias("n_over"))
    whole = packed.groupBy("card_id", "doc_id").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("parts")).join(caps, "card_id")
    per = whole.groupBy("card_id").agg(F.count("*").alias("n_docs"), F.sum(((F.col("parts") > 1) & (F.col("n") <= F.col("pack_capacity"))).cast("bigint")).alias("n_cut"))
    return per.join(over, "card_id").select("card_id", "n_docs", "n_over", "n_cut")


def _p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks_found(load(spark, d, "documents"), load(spark, d, "eval_items"))


def _p7_report(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leak_report(load(spark, d, "documents"), load(spark, d, "eval_items"))


def _p8_found(spark: SparkSession, d: str) -> DataFrame:
    return reading.levels_found(load(spark, d, "documents"), load(spark, d, "reading_labels"))


def _p8_profile(spark: SparkSession, d: str) -> DataFrame:
    return reading.level_profile(load(spark, d, "documents"), load(spark, d, "reading_labels"))


def _p8_scores(spark: SparkSession, d: str) -> DataFrame:
    return reading.held_out_scores(load(spark, d, "documents"), load(spark, d, "reading_labels"))


QUERIES: dict[str, Query] = {
    "p1_found": _p1_found,
    "p1_pieces": _p1_pieces,
    "p1_report": _p1_report,
    "p1_limits": _p1_limits,
    "p2_found": _p2_found,
    "p2_sample": _p2_sample,
    "p2_report": _p2_report,
    "p3_found": _p3_found,
    "p3_by_status": _p3_by_status,
    "p3_by_step": _p3_by_step,
    "p4_found": _p4_found,
    "p4_repaired": _p4_repaired,
    "p5_found": _p5_found,
    "p5_coverage": _p5_coverage,
    "p5_by_step": _p5_by_step,
    "p6_pack": _p6_pack,
    "p6_report": _p6_report,
    "p6_limits": _p6_limits,
    "p7_found": _p7_found,
    "p7_report": _p7_report,
    "p8_found": _p8_found,
    "p8_profile": _p8_profile,
    "p8_scores": _p8_scores,
}

#: Queries that are timed.
HEADLINE = ["p1_found", "p2_sample", "p3_found", "p4_found", "p5_found", "p6_pack", "p7_found", "p8_found"]

_TOKENS = "(13 * len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\r\\n\\f]+'))) // 10"
_FIELDS = ("philosophy_of_mind", "neuroscience", "broader_philosophy", "cognitive_science", "cross_disciplinary", "descartes_primary", "rationalist_tradition", "descartes_scholarship", "formal_logic", "contemporary_responses")
_CARD_FIELDS = ("broader_philosophy", "philosophy_of_mind", "rationalist_tradition", "neuroscience", "descartes_primary", "descartes_scholarship")
_TARGETS = " UNION ALL ".join(
    f"SELECT manifest_id, target_tokens, max_repeats, '{f}' AS category, mixing_ratio.{f} AS ratio, {' + '.join(f'coalesce(mixing_ratio.{g}, 0.0)' for g in _FIELDS)} AS total FROM manifest WHERE mixing_ratio.{f} IS NOT NULL"
    for f in _FIELDS
)
_PLAN = f"""
docs AS (SELECT doc_id, replace(replace(lower(trim(category)), ' ', '_'), '-', '_') AS k, {_TOKENS} AS t FROM documents),
have AS (SELECT k, sum(t)::BIGINT AS tokens, count(*) AS docs FROM docs GROUP BY k),
plan AS (SELECT manifest_id::BIGINT AS manifest_id, category, ratio / total AS share, ratio / total * target_tokens AS wanted, max_repeats, coalesce(tokens, 0) AS tokens
         FROM ({_TARGETS}) LEFT JOIN have ON k = category),
rated AS (SELECT *, max_repeats * tokens < wanted AS short, CASE WHEN tokens > 0 AND wanted > 0 THEN least(wanted / tokens, max_repeats::DOUBLE) ELSE 0.0 END AS rate FROM plan),
drawn AS (SELECT manifest_id, category, doc_id, t, (floor(rate) + CASE WHEN ('0x' || substr(md5('42|' || manifest_id || '|' || doc_id), 1, 8))::BIGINT / 4294967296.0 < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT AS copies
          FROM docs JOIN rated ON k = category WHERE rate > 0)
"""
ORACLE: dict[str, str] = {
    "p1_found": f"SELECT DISTINCT doc_id FROM (SELECT doc_id, card_id, {_TOKENS} AS t FROM documents) JOIN dataset_card USING (card_id) WHERE max_seq_length >= 2 AND t > max_seq_length",
    "p1_limits": f"SELECT doc_id, n AS n_words, 0::BIGINT AS n_over, 0::BIGINT AS n_misfit, true AS covered FROM (SELECT doc_id, card_id, len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\r\\n\\f]+')) AS n, {_TOKENS} AS t FROM documents) JOIN dataset_card USING (card_id) WHERE max_seq_length >= 2 AND t > max_seq_length",
    "p6_limits": "SELECT card_id::BIGINT AS card_id, count(*) AS n_docs, 0::BIGINT AS n_over, 0::BIGINT AS n_cut FROM documents JOIN dataset_card USING (card_id) WHERE pack_capacity >= 1 GROUP BY 1",
    "p2_found": f"WITH {_PLAN} SELECT manifest_id, category FROM rated WHERE short",
    "p2_sample": f"WITH {_PLAN} SELECT manifest_id, category, doc_id, copies, t AS token_estimate FROM drawn WHERE copies > 0",
    "p2_report": f"""WITH {_PLAN},
got AS (SELECT manifest_id, category, sum(copies * t)::BIGINT AS actual_tokens, count(*) AS docs_used, sum(copies)::BIGINT AS copies_used FROM drawn WHERE copies > 0 GROUP BY ALL),
cards AS ({' UNION ALL '.join(f"SELECT '{f}' AS category, sum(category_distribution.{f})::BIGINT AS card_count FROM dataset_card" for f in _CARD_FIELDS)}),
rows AS (SELECT manifest_id, category, share, wanted, tokens, rate, short, coalesce(actual_tokens, 0) AS actual_tokens, coalesce(docs_used, 0) AS docs_used, coalesce(copies_used, 0) AS copies_used FROM rated LEFT JOIN got USING (manifest_id, category))
SELECT manifest_id, category, round(share, 6) AS share, round(wanted, 6) AS wanted_tokens, tokens AS available_tokens, round(rate, 6) AS rate, short, actual_tokens, docs_used, copies_used,
       round(actual_tokens / sum(actual_tokens) OVER (PARTITION BY manifest_id), 6) AS actual_share, card_count
FROM rows LEFT JOIN cards USING (category)""",
}
