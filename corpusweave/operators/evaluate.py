"""Measuring retrieval: metrics per question, parity of two rankings, verdict summaries, alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CLIFF, LEAST_PRIOR = 0.10, 3
JACCARD_LEAST, LATENCY_RATIO = 0.8, 1.2


def retrieval_metrics(expected: DataFrame, retrieved: DataFrame) -> DataFrame:
    """Per question of expected(question_id, doc) against retrieved(question_id, doc, rank, score).

    Scores count once for each distinct document (the last one listed); num_results and num_correct count repeats.
    """
    truth = expected.select("question_id", "doc").distinct().withColumn("_ok", F.lit(True))
    rows = retrieved.join(truth, ["question_id", "doc"], "left")
    docs = rows.groupBy("question_id", "doc").agg(F.max_by("score", "rank").alias("score"), F.max("_ok").alias("_ok"), F.count("*").alias("n"))
    per = docs.groupBy("question_id").agg(
        F.sum("score").alias("total_score"), F.sum(F.when(F.col("_ok"), F.col("score")).otherwise(0.0)).alias("correct_score"),
        F.sum("n").alias("num_results"), F.sum(F.when(F.col("_ok"), F.col("n")).otherwise(0)).alias("num_correct"),
    )
    n = truth.groupBy("question_id").agg(F.count("*").alias("total_expected"))
    hit = rows.where("_ok").groupBy("question_id").agg(F.count_distinct("doc").alias("expected_retrieved"))
    out = n.join(per, "question_id", "left").join(hit, "question_id", "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("num_results", "num_correct", "expected_retrieved")} | {c: F.coalesce(c, F.lit(0.0)) for c in ("total_score", "correct_score")}
    out = out.withColumns(zero)
    return out.withColumn("query_score", F.coalesce(F.try_divide("correct_score", "total_score"), F.lit(0.0))).withColumn("recall", F.col("expected_retrieved") / F.col("total_expected"))


def summary(metrics: DataFrame) -> DataFrame:
    """Means weigh each question by its expected documents."""
    w = F.col("total_expected")
    return metrics.agg(F.sum("total_expected").alias("n_expected"), (F.sum("expected_retrieved") / F.sum(w)).alias("retrieval_rate"), (F.sum(F.col("query_score") * w) / F.sum(w)).alias("mean_query_score"))


def top_k_jaccard(a: Column, b: Column, k: int) -> Column:
    """Of the first k of two arrays; two empty ones are alike."""
    x, y = F.array_distinct(F.slice(a, 1, k)), F.array_distinct(F.slice(b, 1, k))
    return F.when((F.size(x) == 0) & (F.size(y) == 0), F.lit(1.0)).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def p95(c: str) -> Column:
    """Nearest rank; null of nothing."""
    return F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {c})")


def parity(jaccard: Column, old_p95: Column, new_p95: Column) -> Column:
    return (jaccard >= JACCARD_LEAST) & (new_p95 <= old_p95 * LATENCY_RATIO)


def verdicts(rows: DataFrame, by: list[str]) -> DataFrame:
    """Counts of choice ('NEW', 'OLD', else tie) and grade ('PASS1', 'PASS2', 'FAIL', 'XFAIL', 'INFRA'), and the pass rate."""
    n = lambda c, v: F.count_if(F.col(c) == v)
    ties = F.count_if(F.coalesce(~F.col("choice").isin("NEW", "OLD"), F.lit(True)))
    out = rows.groupBy(*by).agg(
        F.count("*").alias("total_rows"), n("choice", "NEW").alias("new_wins"), n("choice", "OLD").alias("old_wins"), ties.alias("ties"), n("grade", "PASS1").alias("pass_first"),
        n("grade", "PASS2").alias("pass_second"), n("grade", "FAIL").alias("fail"), n("grade", "XFAIL").alias("expected_fail"), n("grade", "INFRA").alias("infra"),
    )
    good = F.col("pass_first") + F.col("pass_second")
    return out.withColumn("pass_rate", F.try_divide(good, good + F.col("fail")))


def alerts(runs: DataFrame, *, at: str, days: int = 7) -> DataFrame:
    """runs with severity: 'red' for a drop under the median of the last days' rates (at least three) or more old than new wins,
    else 'orange' for infrastructure failures."""
    prior = Window.partitionBy(F.lit(0)).orderBy(F.unix_timestamp(at)).rangeBetween(-days * 86_400, -1)  # one row a run: few
    rows = runs.withColumn("_n", F.count("pass_rate").over(prior)).withColumn("prior_median", F.expr("percentile(pass_rate, 0.5)").over(prior))
    cliff = (F.col("_n") >= LEAST_PRIOR) & (F.round(F.col("prior_median") - F.col("pass_rate"), 9) >= CLIFF)
    severity = F.when(cliff | (F.col("old_wins") > F.col("new_wins")), "red").when(F.col("infra") > 0, "orange")
    return rows.withColumn("severity", severity).drop("_n")
