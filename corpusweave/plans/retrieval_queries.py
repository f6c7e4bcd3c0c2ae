"""Queries of vector, lexical and hybrid retrieval, recency, expansion and similarity."""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusweave.catalogue import query, read, rounded
from corpusweave.functions.lexical import prefix_query
from corpusweave.operators import retrieve as R
from corpusweave.plans.index_queries import LEXICAL, RANKED, WORDS, document_index

_COS = "list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"
_KNN = f"SELECT e.vec_id AS id, {_COS} AS score, row_number() OVER (ORDER BY {_COS} DESC, e.vec_id) - 1 AS rank FROM embeddings e, embeddings q WHERE q.vec_id = 0 ORDER BY rank LIMIT {{k}}"
_TOKENS = r"SELECT doc_id AS id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), lambda t: t <> '')) AS term FROM documents"


def _query_vector(spark, sf_dir, vec_id: int = 0) -> list[float]:
    return list(read(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()[0])


def _query_text(spark, sf_dir, n: int | None) -> str:
    """Text of benchmark passage 0, or its first n admissible words."""
    words = [w for w in read(spark, sf_dir, "benchmark").where("item_id = 0").first()["text"].replace(",", " ").replace(".", " ").split() if len(w) >= 3]
    return " ".join(words[:n] if n else words)


def _words_sql(n: int) -> str:
    return f"(SELECT list_filter(regexp_split_to_array(text, '[^\\p{{L}}\\p{{N}}_]+'), lambda t: length(t) >= 3)[1:{n}] AS w FROM benchmark WHERE item_id = 0)"


_OR_TERMS = f"SELECT DISTINCT lower(p) AS p FROM (SELECT unnest(list_concat(w, list_transform(list_filter(w, lambda t: length(t) >= 5), lambda t: t[:-2]))) AS p FROM {_words_sql(6)})"
_LEX = f"""SELECT id, sum(0.1) AS s0, count(*) AS hits FROM tok WHERE EXISTS (SELECT 1 FROM pre WHERE starts_with(tok.term, pre.p)) GROUP BY id"""


@query(f"SELECT id, round(score, 6) AS score, rank FROM ({_KNN.format(k=20)})")
def knn_topk(spark, sf_dir):
    top = R.knn(read(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir), 20, id_col="vec_id")
    return top.select("id", rounded("score", "score"), "rank")


@query(f"SELECT e.vec_id AS id, round({_COS}, 6) AS score, row_number() OVER (ORDER BY {_COS} DESC, e.vec_id) - 1 AS rank FROM embeddings e, embeddings q WHERE q.vec_id = 0 AND e.label = q.label ORDER BY rank LIMIT 10")
def knn_scoped(spark, sf_dir):
    """Nearest inside one label: the filter comes before the ranking."""
    e = read(spark, sf_dir, "embeddings")
    label = e.where("vec_id = 0").first()["label"]
    return R.knn(e, _query_vector(spark, sf_dir), 10, id_col="vec_id", scope=F.col("label") == label).select("id", rounded("score", "score"), "rank")


@query(f"""SELECT query_id, id, round(score, 6) AS score, rank FROM (SELECT q.vec_id AS query_id, e.vec_id AS id, {_COS} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS} DESC, e.vec_id) - 1 AS rank
FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0) WHERE rank < 10""")
def knn_batch(spark, sf_dir):
    """The ten nearest of every vector whose id is divisible by 20."""
    e = read(spark, sf_dir, "embeddings")
    return R.knn_many(e, e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec")), 10, id_col="vec_id").select("query_id", "id", rounded("score", "score"), "rank")


@query(f"""SELECT query_id, id, round(score, 6) AS score, rank FROM (SELECT q.vec_id AS query_id, e.vec_id AS id, {_COS} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS} DESC, e.vec_id) - 1 AS rank
FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0) WHERE rank < 5""")
def knn_all_batch(spark, sf_dir):
    """Every vector whose id is divisible by 20 against all vectors: queries grow with the table."""
    e = read(spark, sf_dir, "embeddings")
    return R.knn_many(e, e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec")), 5, id_col="vec_id").select("query_id", "id", rounded("score", "score"), "rank")


@query(f"""WITH tok AS ({_TOKENS}), pre AS ({_OR_TERMS}), lex AS ({_LEX}) SELECT id, round(hits * 0.1::DOUBLE, 6) AS score, row_number() OVER (ORDER BY hits DESC, id) - 1 AS rank FROM lex ORDER BY rank LIMIT 75""")
def lexical_prefix_or(spark, sf_dir):
    q = prefix_query(_query_text(spark, sf_dir, 6))
    return document_index(spark, sf_dir).lookup(q, 75).select("id", rounded("score", "score"), "rank")


@query(f"WITH asked AS (SELECT 0 AS query_id, {WORDS.format(c='text')}[1:7] AS w FROM documents WHERE doc_id = 0), {LEXICAL} SELECT id, score, rank FROM ({RANKED.format(k=75)})")
def lexical_prefix_and(spark, sf_dir):
    """Long query (seven words of document 0): every word's prefix must match; ranked by cover density."""
    words = [w for w in re.split(r"\W+", read(spark, sf_dir, "documents").where("doc_id = 0").first()["text"]) if len(w) >= 3][:7]
    return document_index(spark, sf_dir).lookup(prefix_query(" ".join(words)), 75).select("id", rounded("score", "score"), "rank")


@query(f"""WITH tok AS ({_TOKENS}), pre AS ({_OR_TERMS}), lex AS ({_LEX}), l AS (SELECT id, row_number() OVER (ORDER BY hits DESC, id) - 1 AS rank FROM lex ORDER BY rank LIMIT 75), v AS ({_KNN.format(k=75)}),
f AS (SELECT id, 1.0::DOUBLE / (60 + rank + 1) AS s, rank AS vec_rank, NULL::BIGINT AS lex_rank FROM v UNION ALL SELECT id, 3.0::DOUBLE / (60 + rank + 1), NULL, rank FROM l),
g AS (SELECT id, sum(s) AS score, max(vec_rank) AS vec_rank, max(lex_rank) AS lex_rank FROM f GROUP BY id) SELECT id, round(score, 6) AS score, vec_rank, lex_rank FROM g ORDER BY g.score DESC, vec_rank NULLS LAST, lex_rank NULLS LAST LIMIT 15""")
def hybrid_rrf(spark, sf_dir):
    """Flagship: 75 nearest vectors and 75 best lexical documents fused to 15 (vec_id is taken for doc_id)."""
    v = R.knn(read(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir), 75, id_col="vec_id")
    w = document_index(spark, sf_dir).lookup(prefix_query(_query_text(spark, sf_dir, 6)), 75)
    return R.rrf(v, w, 15).select("id", rounded("score", "score"), "vec_rank", "lex_rank")


@query("""WITH f AS (SELECT c_custkey AS id, 1.0::DOUBLE / (60 + r1) AS s FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS r1 FROM customer) WHERE r1 <= 50
UNION ALL SELECT o_custkey, 1.0::DOUBLE / (60 + r2) FROM (SELECT o_custkey, row_number() OVER (ORDER BY n DESC, o_custkey) AS r2 FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)) WHERE r2 <= 50)
SELECT id, round(sum(s), 6) AS score FROM f GROUP BY id""")
def rrf_fuse(spark, sf_dir):
    """Fusion of two rankings of customers with equal weights: by balance and by orders."""
    a = R.ranked(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("score")).orderBy(F.desc("score"), "id").limit(50))
    b = R.ranked(read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("score")).orderBy(F.desc("score"), "id").limit(50))
    return R.rrf(a, b, 100, lexical_weight=1.0).select("id", rounded("score", "score"))


@query("""SELECT o_orderkey, o_custkey, d AS doc_date FROM (SELECT o_orderkey, o_custkey, strftime(o_orderdate, '%Y-%m-%d') AS d, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders) WHERE rn = 1 ORDER BY d DESC, o_orderkey DESC LIMIT 50""")
def recency_browse(spark, sf_dir):
    """The newest customers' first orders: one row per key, then by date string."""
    o = read(spark, sf_dir, "orders").withColumn("d", F.date_format("o_orderdate", "yyyy-MM-dd"))
    return R.recency(o, 50, dates=[F.col("d")], keys=[F.col("o_custkey").cast("string")], id_col="o_orderkey").select("o_orderkey", "o_custkey", "doc_date")


@query("""WITH h AS (SELECT conv_id, row_number() OVER (ORDER BY length(text) DESC, conv_id, turn) - 1 AS rank, text FROM conversations ORDER BY rank LIMIT 30),
d AS (SELECT conv_id, count(*) AS n, string_agg(text, chr(10) || chr(10) ORDER BY turn) FILTER (WHERE text <> '') AS body FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations WHERE turn IS NOT NULL) WHERE p <= 5 GROUP BY 1),
a AS (SELECT conv_id, count(*) AS n_all FROM conversations GROUP BY 1), r AS (SELECT h.*, d.n, d.body, a.n_all, row_number() OVER (PARTITION BY h.conv_id ORDER BY rank) AS seen FROM h JOIN d USING (conv_id) JOIN a USING (conv_id)),
s AS (SELECT *, coalesce(sum(n) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM r WHERE seen = 1)
SELECT conv_id, rank, CASE WHEN used < 40 THEN body ELSE text END AS content, CASE WHEN used < 40 THEN n END AS expanded_chunks, CASE WHEN used < 40 THEN n_all > 5 END AS expanded_truncated FROM s""")
def doc_expand(spark, sf_dir):
    """Thirty long turns, each replaced by its conversation while forty turns last."""
    c = read(spark, sf_dir, "conversations")
    top = c.orderBy(F.desc(F.length("text")), "conv_id", "turn").limit(30)
    hits = top.select("conv_id", F.col("text").alias("content"), (F.row_number().over(Window.orderBy(F.desc(F.length("text")), "conv_id", "turn")) - 1).cast("long").alias("rank"))
    out = R.expand(hits, c.withColumnRenamed("text", "content").withColumn("id", F.col("turn")), title="conv_id", pos="turn", id_col="id", most=5, total=40)
    return out.select("conv_id", "rank", "content", "expanded_chunks", "expanded_truncated")


_GRAMS = r"list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({c}), '[^\p{{L}}\p{{N}}_]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


@query(f"""WITH n AS (SELECT DISTINCT p_name AS name FROM part), m AS (SELECT DISTINCT left(p_name, length(p_name) - 1) || ' x' AS mention FROM part WHERE p_partkey % 20 = 0),
a AS (SELECT mention, unnest({_GRAMS.format(c="mention")}) AS g FROM m), b AS (SELECT name, unnest({_GRAMS.format(c="name")}) AS g FROM n),
na AS (SELECT mention, count(*) AS na FROM a GROUP BY 1), nb AS (SELECT name, count(*) AS nb FROM b GROUP BY 1), o AS (SELECT mention, name, count(*) AS o FROM a JOIN b USING (g) GROUP BY 1, 2),
s AS (SELECT mention, name, o / (na + nb - o)::DOUBLE AS sim FROM o JOIN na USING (mention) JOIN nb USING (name)), r AS (SELECT *, row_number() OVER (PARTITION BY mention ORDER BY sim DESC, name) AS rn FROM s WHERE sim >= 0.45)
SELECT mention, name, round(sim, 6) AS similarity FROM r WHERE rn = 1""")
def similarity_join_trigram(spark, sf_dir):
    """Mentions (every twentieth part, misspelt) against all part names: the most similar one."""
    p = read(spark, sf_dir, "part")
    m = p.where("p_partkey % 20 = 0").select(F.concat(F.expr("left(p_name, length(p_name) - 1)"), F.lit(" x")).alias("mention"))
    return R.similar_names(m, p.select(F.col("p_name").alias("name"))).select("mention", "name", rounded("similarity", "similarity"))


@query("""SELECT o_orderpriority AS group_key, o_orderstatus AS group_label, count(*) AS doc_count, max(o_orderdate)::DATE AS latest_date FROM orders GROUP BY 1, 2""")
def distribution_guarded(spark, sf_dir):
    """Groups with newest date, given only if there are at least two."""
    o = read(spark, sf_dir, "orders")
    return R.distribution(o, F.col("o_orderpriority"), F.col("o_orderstatus"), F.date_format("o_orderdate", "yyyy-MM-dd"))
