"""Queries of feeds and metadata: outer joins of listings, lookups with fallbacks, update from a join, look-back windows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusweave.catalogue import query, read, rounded
from corpusweave.functions import text as T
from corpusweave.functions.lexical import PrefixQuery, word_similarity
from corpusweave.operators import results as Y
from corpusweave.operators import retrieve as R


@query("SELECT c_custkey, coalesce(o_orderkey, -1)::BIGINT AS item_id, coalesce(o_orderpriority, '') AS item, row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderdate NULLS FIRST, o_orderkey NULLS FIRST)::INT AS ordinal FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 250000) o ON o_custkey = c_custkey")
def sessions_items(spark, sf_dir):
    """Every session with its items in order; one without items keeps a row."""
    o = read(spark, sf_dir, "orders").where("o_totalprice > 250000")
    rows = read(spark, sf_dir, "customer").join(o, F.col("o_custkey") == F.col("c_custkey"), "left")
    w = Window.partitionBy("c_custkey").orderBy(F.asc_nulls_first("o_orderdate"), F.asc_nulls_first("o_orderkey"))
    return rows.select("c_custkey", F.coalesce("o_orderkey", F.lit(-1)).cast("long").alias("item_id"), F.coalesce("o_orderpriority", F.lit("")).alias("item"), F.row_number().over(w).alias("ordinal"))


@query("""SELECT c_custkey, coalesce(s.s_name, n.n_name, c_name) AS url FROM customer LEFT JOIN (SELECT * FROM supplier WHERE s_suppkey % 3 = 0) s ON s_suppkey = c_custkey LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 2 = 0) n ON n_nationkey = c_nationkey""")
def lookup_chain(spark, sf_dir):
    """Curated value, else derived, else the row's own."""
    s, n = read(spark, sf_dir, "supplier").where("s_suppkey % 3 = 0"), read(spark, sf_dir, "nation").where("n_nationkey % 2 = 0")
    rows = read(spark, sf_dir, "customer").join(s, F.col("s_suppkey") == F.col("c_custkey"), "left").join(n, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return rows.select("c_custkey", F.coalesce("s_name", "n_name", "c_name").alias("url"))


@query("SELECT p_partkey, CASE WHEN p_brand IN (SELECT p_brand FROM part WHERE p_size > 49) THEN trim(split_part(p_type || ' - ' || p_name, ' - ', 1)) ELSE 'none' END AS law_name FROM part")
def metadata_update(spark, sf_dir):
    """A derived value written into the rows of one context only."""
    p = read(spark, sf_dir, "part")
    own = p.where("p_size > 49").select("p_brand").distinct().withColumn("_own", F.lit(True))
    return p.join(own, "p_brand", "left").select("p_partkey", F.when(F.col("_own"), T.base_title(F.concat("p_type", F.lit(" - "), "p_name"))).otherwise("none").alias("law_name"))


@query("SELECT event_type, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events WHERE ts >= TIMESTAMP '2024-01-20 00:00:00' AND ts < TIMESTAMP '2024-01-27 00:00:00') WHERE rn <= 5")
def recent_runs(spark, sf_dir):
    """The newest rows of each kind in a half-open look-back window."""
    e = read(spark, sf_dir, "events").where("ts >= TIMESTAMP_NTZ '2024-01-20 00:00:00' AND ts < TIMESTAMP_NTZ '2024-01-27 00:00:00'")
    w = Window.partitionBy("event_type").orderBy(F.desc("ts"), F.desc("event_id"))
    return e.withColumn("rn", F.row_number().over(w)).where("rn <= 5").select("event_type", "event_id", "ts")


@query("SELECT page_id, url FROM (SELECT *, row_number() OVER (PARTITION BY split_part(url, '/', 3) ORDER BY page_id) AS rn FROM pages) WHERE rn = 1")
def cursor_dedupe(spark, sf_dir):
    """First row of each host, by partial aggregation instead of a window."""
    p = read(spark, sf_dir, "pages").groupBy(F.split_part("url", F.lit("/"), F.lit(3)).alias("h")).agg(F.min_by("url", "page_id").alias("url"), F.min("page_id").alias("page_id"))
    return p.select("page_id", "url")


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, user_id::VARCHAR AS u FROM events WHERE json_extract_string(props, '$.k') = '3'")
def surfaced_fields(spark, sf_dir):
    """Canonical metadata from candidate keys, with containment on the JSON text."""
    e = read(spark, sf_dir, "events").where(Y.contains_all(F.col("props"), {"k": "3"}))
    m = Y.surfaced(F.col("props"), {"k": ("missing", "k"), "none": ("zz",)})
    return e.select("event_id", F.element_at(m, "k").alias("k"), F.col("user_id").cast("string").alias("u"))


_TITLE = "SELECT doc_id AS id, unnest(list_filter(regexp_split_to_array(lower({c}), '[^\\p{{L}}\\p{{N}}_]+'), lambda t: t <> '')) AS term, {w}::DOUBLE AS weight FROM documents"


@query(f"""WITH t AS ({_TITLE.format(c="split_part(text, chr(10), 1)", w="1.0")} UNION ALL {_TITLE.format(c="text", w="0.1")}),
s AS (SELECT id, round(sum(weight), 9) AS s FROM t WHERE starts_with(term, 'the') OR starts_with(term, 'que') GROUP BY id) SELECT id, round(s, 6) AS score, row_number() OVER (ORDER BY s DESC, id) - 1 AS rank FROM s ORDER BY rank LIMIT 40""")
def lexical_weighted(spark, sf_dir):
    """Title words weigh ten times as much as body words."""
    d = read(spark, sf_dir, "documents").withColumn("title", F.split_part("text", F.lit("\n"), F.lit(1)))
    top = R.lexical(R.postings(d, fields={"title": "A", "text": "D"}), PrefixQuery(("the", "que")), 40)
    return top.select("id", rounded("score", "score"), "rank")


@query()
def lexical_trigram(spark, sf_dir):
    """Word similarity of a part name's words to all part names: an ordered scan, so an Arrow function; gate and score are one."""
    @F.pandas_udf("double")
    def sim(names: pd.Series) -> pd.Series:
        return names.map(lambda x: word_similarity(wanted, x or ""))

    p = read(spark, sf_dir, "part")
    wanted = p.orderBy("p_partkey").first()["p_name"]
    scored = p.select(F.col("p_partkey").alias("id"), sim("p_name").alias("score")).where("score >= 0.1").orderBy(F.desc("score"), "id").limit(50)
    return R.ranked(scored).select("id", rounded("score", "score"), "rank")


@query()
def embedded_knn(spark, sf_dir):
    """Documents embedded by the stand-in model in Arrow batches, then the nearest to document 0."""
    from corpusweave.operators.enrich import embed

    d = embed(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content")))
    q = d.where("id = 0").select("embedding").first()[0]
    return R.knn(d, q, 20).select("id", rounded("score", "score"), "rank")
