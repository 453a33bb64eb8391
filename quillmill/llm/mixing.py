"""Problem 2: mix categories of documents to target shares with capped repetition.

Tokens are aggregated per category, each (manifest, category) gets a repetition rate, and a
document is emitted floor(rate) times plus one more if a hash-seeded draw falls below the fraction.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.llm.common import token_estimate
from quillmill.session import broadcast_if_small, materialize

SEED = 42


def category_key(category: Column) -> Column:
    """Trimmed, lower case, spaces and hyphens read as underscores."""
    return F.regexp_replace(F.lower(F.regexp_replace(category, r"\A\s+|\s+\z", "")), "[ -]", "_")


def _targets(manifests: DataFrame) -> DataFrame:
    """(manifest_id, category, share, target_tokens, max_repeats) for each ratio that is not null."""
    fields = [f.name for f in manifests.schema["mixing_ratio"].dataType.fields]
    ratio = {f: F.col(f"mixing_ratio.{f}") for f in fields}
    total = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in ratio.values()])
    entries = F.array(*[F.struct(F.lit(f).alias("category"), c.cast("double").alias("ratio")) for f, c in ratio.items()])
    return (
        manifests.select("manifest_id", "target_tokens", "max_repeats", total.alias("_total"), F.explode(entries).alias("_e"))
        .filter(F.col("_e.ratio").isNotNull())
        .select(F.col("manifest_id").cast("bigint").alias("manifest_id"), F.col("_e.category").alias("category"), F.try_divide(F.col("_e.ratio"), F.col("_total")).alias("share"), F.col("target_tokens").cast("bigint").alias("target_tokens"), F.col("max_repeats").cast("bigint").alias("max_repeats"))
    )


def mix_plan(documents: DataFrame, manifests: DataFrame) -> DataFrame:
    """One row per manifest and named category: share, wanted and available tokens, repetition rate.

    `rate` is the wanted tokens over the available ones, at most `max_repeats`; it is 0 for a category
    without tokens or a share that is not positive. `short` marks a category whose documents, each
    used `max_repeats` times, stay below the wanted tokens. Null ratios are left out, a manifest whose
    ratios add up to 0 has null shares; null `max_repeats` or `target_tokens` give rate 0, not short.
    """
    have = documents.select(category_key(F.col("category")).alias("_key"), token_estimate(F.col("text")).alias("_t")).groupBy("_key").agg(F.sum("_t").alias("_tokens"), F.count("*").alias("_docs"))
    plan = _targets(manifests).join(have, F.col("category") == F.col("_key"), "left").drop("_key")
    wanted = F.col("share") * F.col("target_tokens")
    tokens = F.coalesce("_tokens", F.lit(0)).cast("bigint")
    rate = F.when((tokens > 0) & (wanted > 0), F.least(wanted / tokens, F.col("max_repeats").cast("double")))
    return plan.select(
        "manifest_id", "category", "share", "target_tokens", "max_repeats", wanted.alias("wanted_tokens"), tokens.alias("available_tokens"),
        F.coalesce("_docs", F.lit(0)).cast("bigint").alias("available_docs"),
        F.coalesce(F.when(F.col("max_repeats").isNotNull(), rate), F.lit(0.0)).alias("rate"),
        F.coalesce(F.col("max_repeats") * tokens < wanted, F.lit(False)).alias("short"),
    )


def draw(seed: int, *keys: Column) -> Column:
    """A uniform draw in [0, 1) that depends on the seed and the keys only."""
    text = F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def mix_sample(documents: DataFrame, manifests: DataFrame, seed: int = SEED) -> DataFrame:
    """The mixes: (manifest_id, category, doc_id, copies, token_estimate), for documents used at least once.

    The draw depends on seed, manifest and doc_id, so rows repeated with one doc_id are drawn alike.
    Documents of no named category are left out. The plan (a row per manifest and ratio) is made once and broadcast only
    after it was counted.
    """
    return _draw_sample(documents, materialize(mix_plan(documents, manifests), "plan"), seed)


def _draw_sample(documents: DataFrame, whole_plan: DataFrame, seed: int) -> DataFrame:
    plan = broadcast_if_small(whole_plan.filter(F.col("rate") > 0).select("manifest_id", "category", "rate"))
    docs = documents.select("doc_id", category_key(F.col("category")).alias("_key"), token_estimate(F.col("text")).alias("token_estimate"))
    used = docs.join(plan, F.col("_key") == F.col("category"))
    whole = F.floor("rate").cast("bigint")
    extra = (draw(seed, F.col("manifest_id"), F.col("doc_id")) < F.col("rate") - whole).cast("bigint")
    return used.select("manifest_id", "category", "doc_id", (whole + extra).alias("copies"), "token_estimate").filter(F.col("copies") > 0)


def emit_copies(sample: DataFrame) -> DataFrame:
    """One row per copy, numbered from 1."""
    return sample.withColumn("copy_no", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))


def mix_report(documents: DataFrame, manifests: DataFrame, cards: DataFrame | None = None, seed: int = SEED) -> DataFrame:
    """Per manifest and category: target share and tokens, those reached, documents and copies used,
    and the count of that category summed over `dataset_card.category_distribution` (null if no card has it)."""
    plan = materialize(mix_plan(documents, manifests), "plan")
    got = _draw_sample(documents, plan, seed).groupBy(F.col("manifest_id").alias("_m"), F.col("category").alias("_c")).agg(
        F.sum(F.col("copies") * F.col("token_estimate")).alias("_got"), F.sum("copies").alias("_copies"), F.count("*").alias("_docs")
    )
    joined = plan.join(got, (F.col("manifest_id") == F.col("_m")) & (F.col("category") == F.col("_c")), "left")
    zero = F.lit(0).cast("bigint")
    rows = joined.select("manifest_id", "category", "share", "wanted_tokens", "available_tokens", "rate", "short", F.coalesce("_got", zero).alias("actual_tokens"), F.coalesce("_docs", zero).alias("docs_used"), F.coalesce("_copies", zero).alias("copies_used"))
    totals = rows.groupBy(F.col("manifest_id").alias("_m")).agg(F.sum("actual_tokens").alias("_all"))
    rows = rows.join(broadcast_if_small(totals), F.col("manifest_id") == F.col("_m")).drop("_m").withColumn("actual_share", F.try_divide(F.col("actual_tokens").cast("double"), F.col("_all"))).drop("_all")
    if cards is None:
        return rows
    fields = [f.name for f in cards.schema["category_distribution"].dataType.fields]
    counts = cards.select(F.explode(F.array(*[F.struct(F.lit(f).alias("c"), F.col(f"category_distribution.{f}").alias("n")) for f in fields])).alias("_e")).groupBy(F.col("_e.c").alias("_c")).agg(F.sum("_e.n").alias("card_count"))
    return rows.join(broadcast_if_small(counts), F.col("category") == F.col("_c"), "left").drop("_c")
