"""Queries that measure: conditional counts, medians and alerts, p95, retrieval metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusweave.catalogue import query, read, rounded
from corpusweave.operators import evaluate as E


@query("""SELECT l.quality, count(*) AS total_rows, count(*) FILTER (WHERE d.lang = 'en') AS new_wins, count(*) FILTER (WHERE d.lang = 'fr') AS old_wins, count(*) FILTER (WHERE d.lang NOT IN ('en', 'fr')) AS ties,
count(*) FILTER (WHERE toxic = 0 AND n_chars >= 1000) AS pass_first, count(*) FILTER (WHERE toxic = 0 AND n_chars < 1000) AS pass_second, count(*) FILTER (WHERE toxic = 1) AS fail, 0::BIGINT AS expected_fail, 0::BIGINT AS infra,
round(count(*) FILTER (WHERE toxic = 0) / nullif(count(*), 0)::DOUBLE, 6) AS pass_rate FROM labels l JOIN documents d USING (doc_id) GROUP BY 1""")
def conditional_counts(spark, sf_dir):
    """Verdict summary, with labels in the part of verdicts."""
    r = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents"), "doc_id")
    r = r.select("quality", F.when(F.col("lang") == "en", "NEW").when(F.col("lang") == "fr", "OLD").alias("choice"), F.when(F.col("toxic") == 1, "FAIL").when(F.col("n_chars") >= 1000, "PASS1").otherwise("PASS2").alias("grade"))
    return E.verdicts(r, ["quality"]).withColumn("pass_rate", F.round("pass_rate", 6))


_DAYS = "SELECT date_trunc('day', ts)::TIMESTAMP AS day, avg(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END)::DOUBLE AS pass_rate, (count(*) FILTER (WHERE event_type = 'view'))::BIGINT AS old_wins, (count(*) FILTER (WHERE event_type <> 'view'))::BIGINT AS new_wins, (count(*) FILTER (WHERE value < 0.5))::BIGINT AS infra FROM events GROUP BY 1"


@query(f"""WITH d AS ({_DAYS}), m AS (SELECT a.*, (SELECT count(b.pass_rate) FROM d b WHERE b.day < a.day AND b.day >= a.day - INTERVAL 7 DAY) AS n, (SELECT quantile_cont(b.pass_rate, 0.5) FROM d b WHERE b.day < a.day AND b.day >= a.day - INTERVAL 7 DAY) AS prior FROM d a)
SELECT day, round(pass_rate, 6) AS pass_rate, round(prior, 6) AS prior_median, CASE WHEN (n >= 3 AND round(prior - pass_rate, 9) >= 0.1) OR old_wins > new_wins THEN 'red' WHEN infra > 0 THEN 'orange' END AS severity FROM m""")
def median_alert(spark, sf_dir):
    """Daily rates against the median of the seven days before."""
    e = read(spark, sf_dir, "events").withColumn("day", F.date_trunc("day", "ts").cast("timestamp"))
    d = e.groupBy("day").agg(
        F.avg(F.when(F.col("value") > 50, 1.0).otherwise(0.0)).alias("pass_rate"), F.count_if(F.col("event_type") == "view").alias("old_wins"),
        F.count_if(F.col("event_type") != "view").alias("new_wins"), F.count_if(F.col("value") < 0.5).alias("infra"),
    )
    a = E.alerts(d, at="day")
    return a.select(F.col("day").cast("timestamp_ntz").alias("day"), rounded("pass_rate", "pass_rate"), rounded("prior_median", "prior_median"), "severity")


@query("SELECT event_type, quantile_disc(value, 0.95) AS p95, count(*) AS n FROM events GROUP BY 1")
def p95_latency(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy("event_type").agg(E.p95("value").alias("p95"), F.count("*").alias("n"))


_TRUTH = "SELECT b.item_id AS question_id, d.doc_id::VARCHAR AS doc FROM benchmark b JOIN documents d ON contains(d.text, b.text)"
_GOT = "SELECT l.quality + 2 * l.toxic AS question_id, (l.doc_id % 50)::VARCHAR AS doc, row_number() OVER (PARTITION BY l.quality + 2 * l.toxic ORDER BY l.doc_id) AS rank, 1.0::DOUBLE / (1 + l.doc_id) AS score FROM labels l"


@query(f"""WITH e AS (SELECT quality + 2 * toxic AS question_id, (doc_id % 70)::VARCHAR AS doc FROM labels GROUP BY 1, 2), g AS ({_GOT}),
s AS (SELECT question_id, doc, arg_max(score, rank) AS score, count(*) AS n FROM g GROUP BY 1, 2), j AS (SELECT s.*, e.doc IS NOT NULL AS ok FROM s LEFT JOIN e USING (question_id, doc)),
q AS (SELECT question_id, sum(score) AS total, sum(CASE WHEN ok THEN score ELSE 0 END) AS correct, sum(n)::BIGINT AS num_results, sum(CASE WHEN ok THEN n ELSE 0 END)::BIGINT AS num_correct, count(*) FILTER (WHERE ok) AS hit FROM j GROUP BY 1),
t AS (SELECT question_id, count(*) AS total_expected FROM e GROUP BY 1)
SELECT t.question_id::INT AS question_id, total_expected, coalesce(num_results, 0) AS num_results, coalesce(num_correct, 0) AS num_correct, round(coalesce(correct / nullif(total, 0), 0), 6) AS query_score, round(coalesce(hit, 0) / total_expected::DOUBLE, 6) AS recall FROM t LEFT JOIN q USING (question_id)""")
def retrieval_metrics(spark, sf_dir):
    """Scores and recall per question, labels' classes standing for questions."""
    from pyspark.sql import Window

    l = read(spark, sf_dir, "labels").withColumn("question_id", F.col("quality") + 2 * F.col("toxic"))
    doc = (F.col("doc_id") % 50).cast("string").alias("doc")
    got = l.select("question_id", doc, F.row_number().over(Window.partitionBy("question_id").orderBy("doc_id")).alias("rank"), (1.0 / (1 + F.col("doc_id"))).alias("score"))
    m = E.retrieval_metrics(l.select("question_id", (F.col("doc_id") % 70).cast("string").alias("doc")), got)
    return m.select("question_id", "total_expected", "num_results", "num_correct", rounded("query_score", "query_score"), rounded("recall", "recall"))


@query(f"""WITH t AS ({_TRUTH}) SELECT question_id, count(DISTINCT doc) AS n_docs FROM t GROUP BY 1""")
def containment_truth(spark, sf_dir):
    """Which documents hold a passage verbatim: passages meet documents by equal words, then the whole is compared."""
    b = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("needle"))
    words = F.filter(F.split("needle", r"\s+"), lambda w: F.length(w) > 0)
    # the longest inner word of a passage stands in every document that holds it
    inner = F.when(F.size(words) > 2, F.slice(words, 2, F.size(words) - 2)).otherwise(words)
    b = b.withColumn("w", F.array_max(F.transform(inner, lambda w: F.struct(F.length(w), w.alias("w"))))["w"])
    d = read(spark, sf_dir, "documents").select("doc_id", "text", F.explode(F.array_distinct(F.split("text", r"\s+"))).alias("w"))
    hit = d.select("doc_id", "w").join(F.broadcast(b.select("w").distinct()), "w", "left_semi").join(b, "w").select("doc_id", "question_id")
    found = read(spark, sf_dir, "documents").join(hit, "doc_id").join(b.select("question_id", "needle"), "question_id").where(F.contains("text", "needle"))
    return found.groupBy("question_id").agg(F.count_distinct("doc_id").alias("n_docs"))
