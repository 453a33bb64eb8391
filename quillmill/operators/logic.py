"""Argument graphs, finite modal frames, vector neighbours, consistent subsets."""

from __future__ import annotations

from functools import reduce
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmill.functions import scalars as S
from quillmill.session import materialize

#: Conditions of the modal systems on their accessibility relation.
SYSTEMS = {"K": (), "T": ("reflexive",), "KB": ("symmetric",), "S4": ("reflexive", "transitive"), "S5": ("reflexive", "symmetric", "transitive")}


def defeated(arguments: DataFrame, attacks: DataFrame, preferences: DataFrame) -> DataFrame:
    """(arg_id, defeated): by an attacker that is preferred, or strict against defeasible where nothing is preferred."""
    p = preferences.select(F.col("preferred").alias("_p"), F.col("over").alias("_o")).distinct()
    a = attacks.select("attacker", "target").distinct()
    for_ = a.join(p, (F.col("attacker") == F.col("_p")) & (F.col("target") == F.col("_o")), "left").select("attacker", "target", F.col("_p").isNotNull().alias("won"))
    both = for_.join(p, (F.col("target") == F.col("_p")) & (F.col("attacker") == F.col("_o")), "left").select("attacker", "target", "won", F.col("_p").isNotNull().alias("lost"))
    strict = arguments.select("arg_id", "is_strict")
    judged = both.join(strict.select(F.col("arg_id").alias("attacker"), F.col("is_strict").alias("_sa")), "attacker", "left").join(strict.select(F.col("arg_id").alias("target"), F.col("is_strict").alias("_st")), "target", "left")
    hit = F.when(F.col("won"), True).when(F.col("lost"), False).otherwise(F.coalesce(F.col("_sa") & ~F.col("_st"), F.lit(False)))
    per = judged.groupBy(F.col("target").alias("arg_id")).agg(F.bool_or(hit).alias("_d"))
    return arguments.select("arg_id").join(per, "arg_id", "left").select("arg_id", F.coalesce("_d", F.lit(False)).alias("defeated"))


def grounded(arguments: DataFrame, attacks: DataFrame) -> DataFrame:
    """arg_ids accepted: no attacker left undefeated; an argument falls once all its undefeated attackers are accepted."""
    edges = materialize(attacks.select("attacker", "target").distinct(), "attacks")
    state = materialize(arguments.select("arg_id", F.lit(None).cast("boolean").alias("accepted")), "state")
    while True:
        live = edges.join(state.select(F.col("arg_id").alias("attacker"), F.col("accepted").alias("_a")), "attacker", "left").filter("_a is null or _a")
        per = live.groupBy(F.col("target").alias("arg_id")).agg(F.bool_and(F.coalesce("_a", F.lit(False))).alias("_all"))
        new = state.join(per, "arg_id", "left").select("arg_id", F.when(F.col("accepted").isNotNull(), F.col("accepted")).when(F.col("_all").isNull(), True).when(F.col("_all"), False).alias("accepted"))
        new = materialize(new, "state")
        if new.filter("accepted is not null").count() == state.filter("accepted is not null").count():
            return new.filter("accepted").select("arg_id")
        state = new


def aif(arguments: DataFrame, attacks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (an I-node per argument, a CA-node per attack) and edges (attacker to CA, CA to target)."""
    name = F.concat(F.lit("CA_"), F.col("attacker"), F.lit("_"), F.col("target"))
    nodes = arguments.select(F.col("arg_id").alias("node_id"), F.lit("I").alias("kind")).unionByName(attacks.select(name.alias("node_id"), F.lit("CA").alias("kind")))
    edges = attacks.select(F.explode(F.array(F.struct(F.col("attacker").alias("source"), name.alias("target")), F.struct(name.alias("source"), F.col("target").alias("target")))).alias("e")).select("e.*")
    return nodes, edges


def frame_closure(worlds: DataFrame, relation: DataFrame, system: str) -> DataFrame:
    """(u, v): the least relation over the worlds that meets the system's conditions."""
    r = relation.select("u", "v").distinct()
    if "reflexive" in SYSTEMS[system]:
        r = r.union(worlds.select(F.col("w").alias("u"), F.col("w").alias("v")))
    if "symmetric" in SYSTEMS[system]:
        r = r.union(r.select(F.col("v").alias("u"), F.col("u").alias("v")))
    r = materialize(r.distinct(), "frame")
    while "transitive" in SYSTEMS[system]:
        step = r.select("u", F.col("v").alias("m")).join(r.select(F.col("u").alias("m"), "v"), "m").select("u", "v")
        new = materialize(r.union(step).distinct(), "frame")
        if new.count() == r.count():
            break
        r = new
    return r


def box_diamond(worlds: DataFrame, relation: DataFrame, holds: DataFrame) -> DataFrame:
    """(w, box, diamond): whether p holds in all / some worlds that w reaches."""
    p = holds.select(F.col("w").alias("v"), F.lit(True).alias("_p"))
    seen = relation.join(p, "v", "left").groupBy(F.col("u").alias("w")).agg(F.bool_and(F.coalesce("_p", F.lit(False))).alias("_all"), F.bool_or(F.coalesce("_p", F.lit(False))).alias("_some"))
    return worlds.join(seen, "w", "left").select("w", F.coalesce("_all", F.lit(True)).alias("box"), F.coalesce("_some", F.lit(False)).alias("diamond"))


def consistent_subsets(conflicts: DataFrame, labels: list[str]) -> list[list[str]]:
    """Leave-one-out subsets without a conflicting pair, largest only; all labels if there is none."""
    pairs = [(r.a, r.b) for r in conflicts.select("a", "b").distinct().collect()]  # over one rule set
    subsets = [[x for j, x in enumerate(labels) if j != i] for i in range(len(labels))]
    fine = [s for s in subsets if not any(a in s and b in s for a, b in pairs)]
    largest = [s for s in fine if not any(set(s) < set(t) for t in fine)]
    return largest or [labels]


#: Queries that go to all executors at once, and those a batch of rows is multiplied with at a time.
QUERY_BLOCK, QUERY_TILE = 50_000, 256


def _first(query: np.ndarray, vec: np.ndarray, distance: np.ndarray, k: int) -> np.ndarray:
    """Places of the k nearest per query, by distance (nine decimals) and id."""
    order = np.lexsort((vec, np.round(distance, 9), query))
    q = query[order]
    start = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.zeros(0, int)
    rank = np.arange(len(q)) - np.repeat(start, np.diff(np.append(start, len(q))))
    return order[rank < k]


def nearest(queries: DataFrame, rows: DataFrame, k: int, block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, distance): exact k nearest of a stated query set against all rows.

    The queries go to all executors, `block` at a time. Each task multiplies its rows with tiles of them and keeps the
    k nearest per query over all its batches, so k rows per query and task are shuffled. Rows without a vector are left out.
    """
    given = queries.filter("embedding is not null").select("query_id", "embedding").toLocalIterator()
    source, parts = rows.filter("embedding is not null").select("vec_id", "embedding"), []
    while few := list(islice(given, block)):
        ids = np.array([r.query_id for r in few], dtype=np.int64)
        sent = rows.sparkSession.sparkContext.broadcast((ids, np.array([r.embedding for r in few], dtype=np.float64).reshape(len(few), -1)))

        def run(batches, sent=sent):
            own, vectors = sent.value
            squares = (vectors**2).sum(1)
            held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]  # place of the query, vec_id, distance
            for b in batches:
                if not len(b):
                    continue
                m, vec = np.array(b["embedding"].tolist(), dtype=np.float64), b["vec_id"].to_numpy()
                size = (m**2).sum(1)
                for t in range(0, len(own), QUERY_TILE):
                    q = vectors[t : t + QUERY_TILE]
                    d = squares[t : t + QUERY_TILE, None] + size[None] - 2 * q @ m.T
                    d[own[t : t + QUERY_TILE, None] == vec[None]] = np.inf
                    kth = np.partition(d, min(k, d.shape[1]) - 1, axis=1)[:, min(k, d.shape[1]) - 1]
                    # what rounding may have moved is judged by its exact distance
                    i, j = np.nonzero((d <= (kth + 1e-6 * (1 + np.abs(kth)))[:, None]) & (d < np.inf))
                    exact = np.sqrt(((q[i] - m[j]) ** 2).sum(1))
                    held = [np.concatenate(x) for x in zip(held, (i + t, vec[j], exact))]
                keep = _first(*held, k)
                held = [x[keep] for x in held]
            yield pd.DataFrame({"query_id": own[held[0]] if len(own) else held[0], "vec_id": held[1], "distance": held[2]})

        parts.append(source.mapInPandas(run, "query_id long, vec_id long, distance double"))
    near = reduce(DataFrame.union, parts) if parts else source.sparkSession.createDataFrame([], "query_id long, vec_id long, distance double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("distance", 9), "vec_id"))
    return near.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "distance")


def theory_table(spark) -> DataFrame:
    from quillmill.functions import lexicon as L

    return spark.createDataFrame([(i, n, v) for i, (n, v) in enumerate(L.THEORIES.items())], "id int, name string, v array<double>")


def theory_pairs(theories: DataFrame) -> DataFrame:
    """(a, b, distance, cosine) for all pairs of the fixed set of theories: each row meets the literal list of the set."""
    all_ = F.array(*[F.struct(F.lit(r.id).alias("id"), F.lit(r.name).alias("name"), F.array(*map(F.lit, r.v)).alias("v")) for r in theories.collect()])
    return theories.select("*", F.explode(all_).alias("o")).filter("id < o.id").select(F.col("name").alias("a"), F.col("o.name").alias("b"), S.distance(F.col("v"), F.col("o.v")).alias("distance"), S.cosine(F.col("v"), F.col("o.v")).alias("cosine"))


def separating_dimensions(pairs_with_vectors: DataFrame, names: list[str], top: int = 3) -> DataFrame:
    """The `top` dimensions with the largest differences, ties by order of the dimensions."""
    gaps = F.array(*[F.struct((-F.abs(F.col("v")[i] - F.col("u")[i])).alias("gap"), F.lit(i).alias("at"), F.lit(n).alias("name")) for i, n in enumerate(names)])
    return pairs_with_vectors.withColumn("dimensions", F.transform(F.slice(F.array_sort(gaps), 1, top), lambda x: x["name"]))


def context_verdicts(claims: DataFrame, theories: DataFrame) -> DataFrame:
    """(theory, entailed, contradicted): per theory the claims it settles, from signed literals.

    claims: (claim, literal), theories: (theory, literal); a literal is a name or its negation with "not ".
    """
    opposite = F.when(F.col("literal").startswith("not "), F.substring("literal", 5, 10_000)).otherwise(F.concat(F.lit("not "), F.col("literal")))
    yes = theories.join(claims, "literal").groupBy("theory").agg(F.array_sort(F.collect_set("claim")).alias("entailed"))
    no = theories.select("theory", opposite.alias("literal")).join(claims, "literal").groupBy("theory").agg(F.array_sort(F.collect_set("claim")).alias("contradicted"))
    return theories.select("theory").distinct().join(yes, "theory", "left").join(no, "theory", "left")


def soft_optimum(assignments: DataFrame, constraints: DataFrame) -> DataFrame:
    """(assignment, weight): the finite assignments that satisfy the greatest weight; ties by name.

    assignments: (assignment, literal) rows, constraints: (literal, weight).
    """
    scored = assignments.join(constraints, "literal", "left").groupBy("assignment").agg(F.sum(F.coalesce("weight", F.lit(0.0))).alias("weight"))
    return scored.orderBy(F.desc("weight"), "assignment").limit(1)


def build_arguments(arguments: DataFrame, rules: DataFrame) -> DataFrame:
    """(arg_id, conclusion, top_rule, is_strict): `arguments` has arg_id, conclusion and rule_ids, `rules` rule_id and is_strict.

    The top rule is the last listed one that exists; an argument without one is strict.
    """
    listed = arguments.select("arg_id", F.posexplode("rule_ids").alias("at", "rule_id")).join(rules.select("rule_id", "is_strict"), "rule_id")
    top = listed.groupBy("arg_id").agg(F.max_by(F.struct("rule_id", "is_strict"), "at").alias("_t"))
    return arguments.join(top, "arg_id", "left").select("arg_id", "conclusion", F.col("_t.rule_id").alias("top_rule"), F.coalesce("_t.is_strict", F.lit(True)).alias("_own"))


def argument_trees(built: DataFrame, parts: DataFrame, premises: DataFrame) -> DataFrame:
    """(arg_id, premises, is_strict): all premises below an argument, and whether all rules there are strict.

    `built` comes from `build_arguments`, `parts` has (arg_id, sub_id), `premises` (arg_id, premise). Arguments that
    an argument reaches over its parts are found by repeated joins; cycles end, as no pair is reached twice.
    """
    edges = parts.select(F.col("arg_id").alias("mid"), F.col("sub_id").alias("below")).distinct()
    seen = materialize(built.select("arg_id", F.col("arg_id").alias("below")).distinct(), "trees")
    front = seen
    while True:
        step = front.withColumnRenamed("below", "mid").join(edges, "mid").select("arg_id", "below").distinct()
        front = materialize(step.join(seen, ["arg_id", "below"], "left_anti"), "trees")
        if front.isEmpty():
            break
        seen = materialize(seen.union(front), "trees")
    own = seen.join(built.select(F.col("arg_id").alias("below"), "_own"), "below", "left").groupBy("arg_id").agg(F.min(F.coalesce("_own", F.lit(True))).alias("is_strict"))
    held = seen.join(premises.select(F.col("arg_id").alias("below"), "premise"), "below").groupBy("arg_id").agg(F.array_sort(F.collect_set("premise")).alias("premises"))
    return own.join(held, "arg_id", "left").select("arg_id", F.coalesce("premises", F.array().cast("array<string>")).alias("premises"), "is_strict")


def structural_mapping(a: DataFrame, b: DataFrame) -> DataFrame:
    """(role, at, source, target): parts of two arguments (role, at, name) that correspond by role and place; a part without its like has null there."""
    left, right = a.select("role", "at", F.col("name").alias("source")), b.select("role", "at", F.col("name").alias("target"))
    return left.join(right, ["role", "at"], "full")


def space_stats(theories: DataFrame, dimensions: list[str]) -> DataFrame:
    return theories.agg(F.count("*").alias("theories")).select("theories", F.lit(len(dimensions)).alias("dimensions"), F.lit(", ".join(dimensions)).alias("names"))
