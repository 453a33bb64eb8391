"""Conversation-style training sets: formatting, review merge, council, templates and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.functions import text as X


def messages(rows: DataFrame) -> Column:
    """system, user and assistant messages; a null part is left out."""
    part = lambda role, c: F.when(F.col(c).isNotNull(), F.struct(F.lit(role).alias("role"), F.col(c).alias("content")))
    return F.array_compact(F.array(part("system", "system_prompt"), part("user", "user_prompt"), part("assistant", "assistant_response")))


def status_key(status: Column) -> Column:
    return F.lower(F.trim(status))


def chat_format(rows: DataFrame, least: int = 50) -> DataFrame:
    """(row_id, chat): chat texts longer than `least` characters; rejected examples are left out."""
    chat = X.chat_text(messages(rows), status_key(F.col("review_status")) == "rejected")
    return rows.select("row_id", chat.alias("chat")).filter(F.length("chat") > least)


def review_merge(rows: DataFrame, reviewed: DataFrame) -> DataFrame:
    """Rows with status and response of the last review of their id; an empty or null id matches nothing."""
    last = reviewed.filter("id <> ''").groupBy(F.col("id").alias("_id")).agg(F.max_by(F.struct("review_status", "assistant_response"), F.struct("ingested_at", "row_id")).alias("_r"))
    got = F.col("_id").isNotNull()
    return rows.join(last, F.col("id") == F.col("_id"), "left").withColumn("review_status", F.when(got, F.col("_r.review_status")).otherwise(F.col("review_status"))).withColumn("assistant_response", F.when(got, F.col("_r.assistant_response")).otherwise(F.col("assistant_response"))).drop("_id", "_r")


def council(rows: DataFrame, key: str) -> DataFrame:
    """(key, row_id, n, agreement): the longest response per key (the first among equals), agreement min(n / 3, 1), 1 for one."""
    n = F.count("assistant_response")
    return rows.groupBy(key).agg(F.max_by("row_id", F.struct(F.length("assistant_response"), -F.col("row_id"))).alias("row_id"), n.alias("n")).withColumn("agreement", F.when(F.col("n") == 1, 1.0).otherwise(F.least(F.col("n") / 3.0, F.lit(1.0))))


def pending(rows: DataFrame) -> DataFrame:
    return rows.filter(~F.coalesce("human_reviewed", F.lit(False)))


#: Bodies of the seven example types; {..} are filled from the row.
TEMPLATES = {
    "A": "Reconstruct the argument: {passage}",
    "B": "Attack the claim of {philosopher} by an undercutter: {passage}",
    "C": "Name the scheme used by {philosopher}: {passage}",
    "D": "Read the passage by {philosopher} and answer: {passage}",
    "E": "State how sure you are: {passage}",
    "F": "Decide who should answer: {passage}",
    "G": "Join both answers: {passage}",
}


def generate(rows: DataFrame, types: tuple[str, ...] = tuple(TEMPLATES)) -> DataFrame:
    """(philosopher, type, rank, prompt): each passage with each type's template filled."""
    picked = F.array(*[F.struct(F.lit(t).alias("type"), F.lit(TEMPLATES[t]).alias("body")) for t in types])
    each = rows.select("philosopher", "rank", "passage", F.explode(picked).alias("t"))
    slots = F.create_map(F.lit("passage"), F.col("passage"), F.lit("philosopher"), F.col("philosopher"))
    return each.select("philosopher", "rank", F.col("t.type").alias("type"), X.fill_slots(F.col("t.body"), slots).alias("prompt"))


def first_passages(rows: DataFrame, top: int = 10) -> DataFrame:
    """(philosopher, rank, passage): up to `top` passages per philosopher in row order."""
    w = Window.partitionBy("philosopher").orderBy("row_id")
    usable = rows.filter(F.col("philosopher").isNotNull() & (F.length("source_passage") > 0))
    return usable.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top).select("philosopher", "rank", F.col("source_passage").alias("passage"))


def seeded_order(rows: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Rows with a hash of seed and key to order by."""
    return rows.withColumn("order_key", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")).cast("binary")))


#: What stands for a response until a model writes it, by type, and the routing answers of type F.
PENDING_RESPONSES = {
    "A": "[PLACEHOLDER — LLM council should generate full response]\nKey elements to cover:\n%s\n\n[CONFIDENCE: 0.85]",
    "B": "[PLACEHOLDER — LLM council should generate]\nAttack type: %s\nTarget: %s\n\n[CONFIDENCE: 0.80]",
    "C": "[PLACEHOLDER — LLM council should generate]\n\n[CONFIDENCE: 0.70]",
    "D": "[PLACEHOLDER — LLM council should generate]\n\n[CONFIDENCE: 0.80]",
    "E": "[PLACEHOLDER — expected confidence: %s]\nRouting: %s\nReason: %s\n\n[CONFIDENCE: %s]",
    "SELF": "I can handle this directly with my Cartesian expertise and formal reasoning capabilities.\n\n[Reason: %s]\n\n[CONFIDENCE: 0.90]",
    "ORACLE": "This question goes beyond my specialized training in Cartesian philosophy and formal reasoning. I need broader knowledge.\n\n[Reason: %s]\n\n[ORACLE_REQUEST: %s]\n\n[CONFIDENCE: 0.35]",
    "HYBRID": "I can partially address this with my formal expertise, but need oracle consultation for the broader context.\n\n[Reason: %s]\n\n[ORACLE_REQUEST: Provide context for: %s]\n\n[CONFIDENCE: 0.55]",
}


#: Fixed value: the request of type G.
INTEGRATION_REQUEST = "You previously answered a question and requested oracle consultation. Integrate the oracle's response with your own expertise.\n\nYOUR INITIAL ANSWER:\n%s\n\nORACLE RESPONSE:\n%s\n\nProduce your final integrated answer. Update your confidence score."


def template_examples(rows: DataFrame, written: Column | None = None) -> DataFrame:
    """(row_id, type, user, assistant) of template rows of the types A to G.

    Columns used: row_id, type, user, key_elements, attack_type, target, passage, source, questions, expected_confidence,
    routing, reason, sketch, original_answer, oracle_response, integrated. `written` is a model's response where there is
    one; type E prefers its sketch, F answers by its routing (any other than SELF and ORACLE is HYBRID) and G by the
    joined answer. Nulls read N/A where the type names a field.
    """
    na = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("N/A"))
    kind = F.col("type")
    user = F.when(kind == "D", F.concat(F.lit("Read this passage from Descartes ("), na("source"), F.lit('):\n\n"'), na("passage"), F.lit('"\n\n'), F.array_join(F.coalesce("questions", F.array()), "\n")))
    user = user.when(kind == "G", F.format_string(INTEGRATION_REQUEST, na("original_answer"), na("oracle_response"))).otherwise(F.col("user"))
    form = lambda key, *values: F.format_string(PENDING_RESPONSES[key], *values)
    elements = F.array_join(F.transform(F.coalesce("key_elements", F.array()), lambda x: F.concat(F.lit("  - "), x)), "\n")
    pending_ = F.when(kind == "A", form("A", elements)).when(kind == "B", form("B", na("attack_type"), na("target"))).when(kind == "C", F.lit(PENDING_RESPONSES["C"])).when(kind == "D", F.lit(PENDING_RESPONSES["D"]))
    pending_ = pending_.when(kind == "E", form("E", na("expected_confidence"), na("routing"), na("reason"), F.coalesce(F.col("expected_confidence").cast("string"), F.lit("0.5"))))
    routed = F.when(F.col("routing") == "SELF", form("SELF", na("reason"))).when(F.col("routing") == "ORACLE", form("ORACLE", na("reason"), na("user"))).otherwise(form("HYBRID", na("reason"), na("user")))
    model = written if written is not None else F.lit(None).cast("string")
    sketch = F.when(kind == "E", F.nullif(F.col("sketch"), F.lit("")))
    answer = F.when(kind == "F", F.coalesce(model, routed)).when(kind == "G", F.coalesce(F.nullif(F.col("integrated"), F.lit("")), model, F.lit(""))).otherwise(F.coalesce(sketch, model, pending_))
    return rows.select("row_id", "type", user.alias("user"), answer.alias("assistant"))
