"""Feedback rows and evaluation measures: labels, recency weights, prefix metrics, accuracy, calibration, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.functions import scalars as S

CHECKPOINTS = (50, 100, 200, 500, 1000)


def outcomes(events: DataFrame) -> DataFrame:
    """Feedback rows made of event rows: outcome and prediction columns by rule from id, type and value; each may be null."""
    k = F.get_json_object("props", "$.k").cast("int")
    i = F.col("event_id")
    third = lambda m, r, c: F.when(i % m != r, c)
    return events.select(
        F.col("event_id").alias("seq"), "ts", third(3, 0, k % 2 == 0).alias("z3"), third(4, 1, k % 5 != 0).alias("oracle"), third(5, 2, F.least(F.col("value") / 20, F.lit(1.5))).alias("magnitude"), third(2, 0, k > 20).alias("accepted"),
        F.least(k / 100.0, F.lit(1.0)).alias("predicted_confidence"), F.when(k < 40, "SELF").when(k < 70, "ORACLE").when(k < 95, "HYBRID").otherwise("?").alias("predicted_routing"),
    )


def labelled(rows: DataFrame) -> DataFrame:
    """Rows with true confidence, routing (0-2) and error (0-4)."""
    c = S.true_confidence(F.col("z3"), F.col("oracle"), F.col("magnitude"), F.col("accepted"))
    return rows.withColumn("true_confidence", c).withColumn("true_routing", S.true_routing(F.col("true_confidence"))).withColumn("true_error", S.true_error(F.col("z3"), F.col("oracle"), F.col("magnitude")))


def _numbered(rows: DataFrame, order: str, buckets: int = 1000) -> DataFrame:
    """Rows with `rn`, their place by an integer order column, without a global sort: counts per range of the
    order column give the offset, ranks are made inside the ranges."""
    ends = rows.agg(F.min(order).alias("lo"), F.max(order).alias("hi")).first()
    if ends.lo is None:
        return rows.withColumn("rn", F.lit(0).cast("bigint"))
    width = max(1, -(-(int(ends.hi) - int(ends.lo) + 1) // buckets))
    cut = rows.withColumn("_b", F.floor((F.col(order) - int(ends.lo)) / width))
    counts = cut.groupBy("_b").agg(F.count("*").alias("_n"))
    before = counts.select("_b", (F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_b")) - F.col("_n")).alias("_before"))
    return cut.join(F.broadcast(before), "_b").withColumn("rn", F.col("_before") + F.row_number().over(Window.partitionBy("_b").orderBy(order))).drop("_b", "_before")


def recency_weights(rows: DataFrame, order: str) -> DataFrame:
    """Rows with weight 1 + i / n, i from 0 in the order."""
    n = rows.count()
    return _numbered(rows, order).withColumn("weight", 1.0 + (F.col("rn") - 1) / F.lit(float(max(n, 1))))


def recency_sample(rows: DataFrame, order: str, k: int = 32, seed: int = 42) -> DataFrame:
    """k rows with replacement in proportion to their weight: hashed draws against the cumulative weight in closed form."""
    n = rows.count()
    if n == 0:
        return _numbered(rows, order).limit(0)
    # the weight of the first m rows is m + m (m - 1) / 2n: solve it for each draw
    total = n + (n - 1) / 2
    draws = rows.sparkSession.range(1, k + 1).select(F.col("id").alias("draw"), (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.col("id").cast("string")).cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0 * total).alias("u"))
    half = 1 - 1 / (2 * n)
    at = F.least(F.floor((-half + F.sqrt(half * half + 2 * F.col("u") / n)) * n) + 1, F.lit(n))
    return F.broadcast(draws.select("draw", at.cast("bigint").alias("rn"))).join(_numbered(rows, order), "rn")


def buffer_tail(rows: DataFrame, order: str, keep: int) -> DataFrame:
    """The last `keep` rows."""
    return rows.orderBy(F.desc(order)).limit(keep)


def convergence(rows: DataFrame, order: str, checkpoints: tuple[int, ...] = CHECKPOINTS) -> DataFrame:
    """Metrics over the first c rows at each checkpoint up to n, and at n.

    Rows get the first checkpoint they count towards; sums per checkpoint are then accumulated, so one
    aggregation over few groups replaces a window over all rows.
    """
    n = rows.count()
    points = sorted({c for c in checkpoints if c <= n} | {n}) if n else []
    if not points:
        points = [0]
    numbered = _numbered(rows, order)
    first = F.lit(points[-1])
    for c in reversed(points[:-1]):
        first = F.when(F.col("rn") <= c, c).otherwise(first)
    code = F.when(F.col("predicted_routing") == "SELF", 0).when(F.col("predicted_routing") == "ORACLE", 1).when(F.col("predicted_routing") == "HYBRID", 2)
    sums = numbered.groupBy(first.alias("checkpoint")).agg(F.count("*").alias("n"), F.sum(F.abs(F.col("predicted_confidence") - F.col("true_confidence"))).alias("gap"), F.count_if(code == F.col("true_routing")).alias("right"), F.count(code).alias("routed"), F.sum("predicted_confidence").alias("conf"))
    w = Window.partitionBy(F.lit(0)).orderBy("checkpoint")
    total = lambda c: F.sum(c).over(w)
    return sums.select(F.col("checkpoint").cast("bigint").alias("checkpoint"), (total("gap") / total("n")).alias("calibration_error"), (total("right") / F.greatest(total("routed"), F.lit(1))).alias("routing_accuracy"), (total("conf") / total("n")).alias("avg_confidence"))


def trend(metrics: DataFrame) -> DataFrame:
    """First against last checkpoint."""
    first, last = (lambda c: F.min_by(c, "checkpoint")), (lambda c: F.max_by(c, "checkpoint"))
    return metrics.agg((first("calibration_error") - last("calibration_error")).alias("calibration_gain"), (last("routing_accuracy") - first("routing_accuracy")).alias("routing_gain"))


def recent_loss(rows: DataFrame, order: str, loss: str, last: int = 1000) -> DataFrame:
    """Mean loss over the last `last` rows."""
    return buffer_tail(rows, order, last).agg(F.avg(loss).alias("mean_loss"))


def accuracy(rows: DataFrame, expected: str, predicted: str) -> DataFrame:
    """(expected, n, correct, accuracy) per class; a null prediction is wrong."""
    right = F.coalesce(F.col(expected) == F.col(predicted), F.lit(False)).cast("bigint")
    return rows.groupBy(F.col(expected).alias("expected")).agg(F.count("*").alias("n"), F.sum(right).alias("correct")).withColumn("accuracy", F.col("correct") / F.col("n"))


def calibration_bins(rows: DataFrame, confidence: str, correct: str, bins: int = 5) -> DataFrame:
    """(bin, n, accuracy, midpoint) over bins of equal width, 1.0 in the last."""
    b = F.least(F.floor(F.col(confidence) * bins), F.lit(bins - 1)).cast("bigint")
    return rows.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(F.col(correct).cast("double")).alias("accuracy")).withColumn("midpoint", (F.col("bin") + 0.5) / bins)


def calibration_error(rows: DataFrame, confidence: str, correct: str, bins: int = 5) -> DataFrame:
    per = calibration_bins(rows, confidence, correct, bins)
    return per.agg((F.sum(F.abs(F.col("accuracy") - F.col("midpoint")) * F.col("n")) / F.sum("n")).alias("ece"), F.sum("n").alias("n"))


def growth(rows: DataFrame, epoch: str) -> DataFrame:
    """Per epoch: rates of store hits, oracle calls and repairs, mean latency."""
    return rows.groupBy(F.col(epoch).alias("epoch")).agg(F.count("*").alias("n"), *[(F.count_if(c) / F.greatest(F.count("*"), F.lit(1))).alias(name) for name, c in (("hit_rate", F.col("method") == "vks_cache"), ("oracle_rate", F.col("method") == "oracle"), ("repair_rate", F.col("repaired")))], F.avg("latency").alias("mean_latency"))


def repair_savings(rows: DataFrame) -> DataFrame:
    """1 - oracle calls with repair / without; 0 where there are none without."""
    calls = lambda on: F.count_if((F.col("repaired") == on) & (F.col("method") == "oracle"))
    return rows.agg(calls(True).alias("with_repair"), calls(False).alias("without_repair")).withColumn("savings", F.when(F.col("without_repair") == 0, 0.0).otherwise(1 - F.col("with_repair") / F.col("without_repair")))


def engine_rates(rows: DataFrame) -> DataFrame:
    """Shares of self, oracle and hybrid routing, and of proofs that hold among those tried (0 without any)."""
    share = lambda r: (F.count_if(F.col("predicted_routing") == r) / F.greatest(F.count("*"), F.lit(1))).alias(f"{r.lower()}_rate")
    return rows.agg(F.count("*").alias("n"), share("SELF"), share("ORACLE"), share("HYBRID"), F.coalesce(F.avg(F.col("z3").cast("double")), F.lit(0.0)).alias("z3_accuracy"))


def gate(metrics: DataFrame) -> DataFrame:
    """(metric, value, threshold, lower_is_better) with `ok` per row and `all_ok` over all."""
    ok = F.when(F.col("lower_is_better"), F.col("value") <= F.col("threshold")).otherwise(F.col("value") >= F.col("threshold"))
    rows = metrics.withColumn("ok", F.coalesce(ok, F.lit(False)))
    return rows.withColumn("all_ok", F.min("ok").over(Window.partitionBy(F.lit(0))))  # over one row per metric


def perplexity(rows: DataFrame, by: list[str]) -> DataFrame:
    """exp(sum loss x tokens / sum tokens)."""
    return rows.groupBy(*by).agg(F.exp(F.sum(F.col("loss") * F.col("tokens")) / F.sum("tokens")).alias("perplexity"))


def nudge_latest(rows: DataFrame, order: str, signal: Column) -> DataFrame:
    """The latest row's confidence moved by a signal: accept +0.1, reject -0.2, solver_ok +0.15 (error 0), solver_fail -0.3 (error 3)."""
    last = rows.agg(F.max(order).alias("_last"))
    step = F.when(signal == "accept", 0.1).when(signal == "reject", -0.2).when(signal == "solver_ok", 0.15).when(signal == "solver_fail", -0.3).otherwise(0.0)
    hit = F.col("_last").isNotNull()
    moved = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("true_confidence") + step))
    error = F.when(signal == "solver_ok", 0).when(signal == "solver_fail", 3).otherwise(F.col("true_error"))
    # one row; rows of a null order stay as they are
    return rows.join(F.broadcast(last), F.col(order) == F.col("_last"), "left").withColumn("true_confidence", F.when(hit, moved).otherwise(F.col("true_confidence"))).withColumn("true_error", F.when(hit, error).otherwise(F.col("true_error"))).drop("_last")


def perplexity_gate(rows: DataFrame, most_rise: float = 0.10) -> DataFrame:
    """(kind, base, tuned, change, ok) from rows (model base or tuned, kind, loss, tokens): the perplexity of the domain must
    fall, that of all other kinds may rise by `most_rise`."""
    per = perplexity(rows, ["model", "kind"])
    both = per.groupBy("kind").agg(F.max(F.when(F.col("model") == "base", F.col("perplexity"))).alias("base"), F.max(F.when(F.col("model") == "tuned", F.col("perplexity"))).alias("tuned"))
    change = F.try_divide(F.col("tuned") - F.col("base"), F.col("base"))
    return both.withColumn("change", change).withColumn("ok", F.coalesce(F.when(F.col("kind") == "domain", change < 0).otherwise(change <= most_rise), F.lit(False)))
