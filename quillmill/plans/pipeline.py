"""Phases of the corpus pipeline as a dependency graph, their checks, and phase specifications."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.functions import lexicon as L
from quillmill.functions import text as X
from quillmill.operators import corpus as C
from quillmill.operators import dedup as D
from quillmill.session import materialize


@dataclass
class Phase:
    name: str
    run: Callable[[dict[str, DataFrame]], DataFrame]
    needs: tuple[str, ...] = ()
    checks: list[Callable[[DataFrame], DataFrame]] = field(default_factory=list)


GROUPS = {"corpus": (1, 4), "training": (5, 8), "inference": (9, 12), "all": (1, 12)}


def parse_phases(spec: str) -> list[int]:
    """'3', '1-4' or the name of a group."""
    spec = spec.strip().lower()
    if spec in GROUPS:
        low, high = GROUPS[spec]
    elif "-" in spec:
        low, high = map(int, spec.split("-", 1))
    else:
        low = high = int(spec)
    if low > high:
        raise ValueError(f"empty range {spec!r}")
    return list(range(low, high + 1))


def check(df: DataFrame, name: str, value, least: float) -> DataFrame:
    """(check, value, threshold, ok): an assertion over one aggregate."""
    return df.agg(value.cast("double").alias("value")).select(F.lit(name).alias("check"), "value", F.lit(float(least)).alias("threshold"), (F.coalesce("value", F.lit(0.0)) >= least).alias("ok"))


def run_phases(phases: list[Phase], inputs: dict[str, DataFrame], wanted: list[str] | None = None) -> tuple[dict[str, DataFrame], dict[str, bool]]:
    """Runs phases after those they need; a phase whose needs failed their checks is not run."""
    by, done, ok = {p.name: p for p in phases}, dict(inputs), {}

    def visit(name: str, path: tuple[str, ...] = ()) -> bool:
        if name in ok or name in inputs:
            return ok.get(name, True)
        if name in path:
            raise ValueError(f"phases depend on each other: {path + (name,)}")
        p = by[name]
        if not all([visit(n, path + (name,)) for n in p.needs]):
            ok[name] = False
            return False
        done[name] = p.run(done)
        ok[name] = all(r.ok for c in p.checks for r in c(done[name]).collect())
        return ok[name]

    for n in wanted or [p.name for p in phases]:
        visit(n)
    return done, ok


def corpus_phases(most_tokens: int = 8192) -> list[Phase]:
    """clean, dedup, filter, split: `raw` has doc_id, text, category and source. Duplicates are removed on cleaned
    text and before the filter, so a short copy can fall to a long one that is filtered later."""
    rows = lambda df: check(df, "rows", F.count("*"), 1)

    def dedup(x: dict[str, DataFrame]) -> DataFrame:
        keep = D.survivors(x["clean"], D.near_duplicates(x["clean"])).select(F.col("doc_id").alias("_keep"))
        return x["clean"].join(keep, F.col("doc_id") == F.col("_keep"), "left_semi")

    return [
        Phase("clean", lambda x: materialize(x["raw"].withColumn("text", X.clean(F.col("text"))), "clean"), ("raw",), [rows]),
        Phase("dedup", dedup, ("clean",), [rows]),
        Phase("filter", lambda x: C.quality_filter(x["dedup"]), ("dedup",), [rows]),
        Phase("split", lambda x: C.train_val(C.split_sequences(x["filter"], most_tokens), ["doc_id", "chunk_idx"]), ("filter",), [rows]),
    ]


def corpus_checks(documents: DataFrame, least_files: int = 50) -> DataFrame:
    """(check, value, threshold, ok) over the corpus: documents, tokens, texts with diacritics, share of texts with content,
    and documents of each wanted category, in one pass."""
    key = C.category_key(F.col("category"))
    text = F.coalesce("text", F.lit(""))
    values = {"documents": (F.count("*"), least_files), "tokens": (F.sum(X.token_estimate(text)), 1), "diacritics": (F.count_if(text.rlike("[éèêëàâùûüîïôöçñ]")), 1), "content": (F.avg((F.length(X.strip(text)) >= 50).cast("double")), 0.9)}
    values |= {f"category {c}": (F.count_if(key == c), 1) for c in L.MIXING_TARGETS}
    row = documents.agg(*[F.coalesce(v.cast("double"), F.lit(0.0)).alias(n) for n, (v, _) in values.items()])
    listed = F.array(*[F.struct(F.lit(n).alias("check"), F.col(f"`{n}`").alias("value"), F.lit(float(t)).alias("threshold")) for n, (_, t) in values.items()])
    return row.select(F.inline(listed)).withColumn("ok", F.col("value") >= F.col("threshold"))


def tree_report(files: DataFrame, categories: list[str] = L.INDEX_CATEGORIES) -> DataFrame:
    """(category, n_files, bytes) for every category, those without files too."""
    dim = files.sparkSession.createDataFrame([(c,) for c in categories], "category string")
    have = files.groupBy("category").agg(F.count("*").alias("n_files"), F.sum("length").alias("bytes"))
    return have.join(F.broadcast(dim), "category", "right").select("category", F.coalesce("n_files", F.lit(0)).alias("n_files"), F.coalesce("bytes", F.lit(0)).alias("bytes"))


def schemes(spark: SparkSession) -> DataFrame:
    """Argument schemes: slots with {names}, conclusion and critical questions, which are kept unfilled."""
    rows = [
        ("analogy", ["{case_1} has property {property}", "{case_1} is similar to {case_2} in respects {respects}"], "{case_2} has property {property}", ["Are there relevant differences between {case_1} and {case_2}?"]),
        ("sign", ["{sign} is present", "{sign} usually means {state}"], "{state} holds", ["Is there another account of {sign}?"]),
    ]
    return spark.createDataFrame(rows, "scheme string, premises array<string>, conclusion string, critical_questions array<string>")


def instantiate(rows: DataFrame, bindings: str = "bindings") -> DataFrame:
    """Premises and conclusion with their slots filled from a map column."""
    fill = lambda c: X.fill_slots(c, F.col(bindings))
    return rows.withColumn("premises", F.transform("premises", fill)).withColumn("conclusion", fill(F.col("conclusion")))
